"""Hand-computed cases and properties of the engine's own operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import sequences as sq, vectors as vx
from kinfold.operators import embedding as em, features as fs, hdbscan as hd, identity as idn, kmers as km, metrics as mt
from kinfold.operators.components import connected_components
from kinfold.operators.knn import knn, undirected
from kinfold.operators.leiden import communities
from kinfold.sources import formats as fmt
from kinfold.streaming.ingest import ingest


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_sequences(spark):
    r = one(spark, sq.padded_hamming(F.lit("ABCD"), F.lit("ABXDEF")).alias("h"), sq.accession_path(F.lit("NC_001422")).alias("p"), sq.accession_path(F.lit("AB123")).alias("q"), sq.kmers(F.lit("A"), 2).alias("none"), sq.kmers(F.lit("a🙂b\n"), 2).alias("k"), sq.hypothetical(F.lit(None).cast("string")).alias("hyp"), sq.mask_rare_residues(F.lit("muz")).alias("m"))
    assert (r.h, r.p, r.q, r.none, r.k, r.hyp, r.m) == (0.5, "NC/00/NC_001422.gb", "AB/00/AB123.gb", [], ["a🙂", "🙂b", "b\n"], False, "M X X")


def test_kmers(spark):
    d = spark.createDataFrame([(1, "ABABAB"), (2, "A"), (3, None)], "id int, s string")
    got = {(r.id, r.kmer): r.freq for r in km.kmer_counts(d, "id", "s", [2]).collect()}
    assert got == {(1, "AB"): 3 / 5, (1, "BA"): 2 / 5}


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    m = F.create_map(F.lit("10"), F.lit(1.0), F.lit("9"), F.lit(2.0), F.lit("b"), F.lit(3.0))
    r = one(spark, vx.euclidean(a, z).alias("e"), vx.manhattan(a, z).alias("m"), vx.l2_normalize(a).alias("n"), vx.l2_normalize(z).alias("z"), vx.fuse(a, a).alias("f"), vx.map_to_vector(m).alias("v"), vx.cosine_distance(a, a).alias("c"))
    assert (r.e, r.m, r.n, r.z, r.f, r.v) == (5.0, 7.0, [0.6, 0.8], [0.0, 0.0], [0.6, 0.8, 0.6, 0.8], [2.0, 1.0, 3.0]) and abs(r.c) < 1e-12


def test_parsers(spark, tmp_path):
    tsv = spark.createDataFrame([(0, "r1\tr1"), (1, "r1\ta"), (2, "r2\tr2"), (3, "r2\tb"), (4, "bad"), (5, "r2\ta")], "pos int, line string")
    assert {r.member: r.cluster for r in fmt.cluster_tsv(tsv, "pos", "line").collect()} == {"r1": 0, "a": 1, "r2": 1, "b": 1}
    lines = spark.createDataFrame(list(enumerate([">Cluster 0", "0\t10aa, >P1... *", "junk", ">Cluster 1", "0\t9aa, >P2... *"])), "pos int, line string")
    assert {r.member: r.cluster for r in fmt.clstr(lines, "pos", "line").collect()} == {"P1": 0, "P2": 1}
    vog = fmt.ortholog_index(spark.createDataFrame([("#c\ta\tb\tc\td",), ("V1\t1\t1\tx\t2772062.YP_1.1,ABC",)], "value string"), "value")
    assert {r.protein: r.vog for r in vog.collect()} == {"2772062.YP_1.1": "V1", "YP_1.1": "V1", "ABC": "V1"}
    members = spark.createDataFrame([("YP_1.1",), ("ABC.2",), ("Q",)], "p string")
    assert {r.p: r.vog for r in fs.fallback_lookup(members, vog, "p", "protein", "vog").collect()} == {"YP_1.1": "V1", "ABC.2": "V1", "Q": fs.NOVEL}
    genes = fmt.genbank_genes(spark.createDataFrame([("f", "LOCUS X\nVERSION     X.1\nSOURCE      o\nFEATURES\n     source          1..9\n                     /db_xref=\"taxon:7\"\n     CDS             complement(1..3)\n                     /product=\"a\n                     b\"\nORIGIN\n        1 atgccc\n//\n")], "path string, content string")).collect()
    assert [(g.protein_id, g["product"], g.nt_sequence, g.aa_sequence, g.metadata_virus.taxon_id, g.location.strand) for g in genes] == [("no_id", "a b", "CAT", "", "7", -1)]
    fmt.fasta_lines(spark.createDataFrame([(1, "acg")], "id int, s string"), "id", "s").write.text(str(tmp_path / "f"))
    assert [tuple(r) for r in fmt.read_fasta(spark, str(tmp_path / "f")).collect()] == [("1", "ACG")]
    got = fmt.fetch_batches(spark.createDataFrame([("a",), ("b",)], "accession string"), lambda ids: {i: i * 2 for i in ids}, wait=0).collect()
    assert {r.accession: r.content for r in got} == {"a": "aa", "b": "bb"}


def test_features(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = fs.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, fs.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "t")
    assert (fs.write_resumable(old, path, "k"), fs.write_resumable(old, path, "k"), fs.write_resumable(once, path, "k")) == (2, 0, 1)
    new.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        t = ingest(spark, str(tmp_path / "in"), new.schema, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], ["v"])
    assert t.read().count() == 2


def points(spark, n=90, seed=0):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(c, 0.3, (n // 3, 4)) for c in (0, 4, 8)])
    return x, spark.createDataFrame([(i, i // (n // 3), [float(t) for t in v]) for i, v in enumerate(x)], "id bigint, label int, vec array<double>")


@pytest.mark.parametrize("block", [2048, 20])
def test_knn_in_blocks(spark, monkeypatch, block):
    import kinfold.operators.knn as kn

    monkeypatch.setattr(kn.pair_blocks, "__defaults__", ((), block))
    x, d = points(spark)
    D = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    got = {(r.src, r["rank"]): r.dst for r in knn(d, "id", "vec", 5).collect()}
    assert all(got[i, k + 1] == j for i in range(90) for k, j in enumerate(np.argsort(D[i], kind="stable")[:5]))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(i, i + 1) for i in range(2000, 2060)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = connected_components(spark.createDataFrame(edges, "src int, dst int"))
    assert {x.id: x.component for x in got.collect()} == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_metrics(spark):
    d = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "b", 0), (5, "c", 1)], "id int, y string, c int")
    r = {x.cluster_id: x for x in mt.purity_entropy(d, "c", "y").collect()}
    assert (r[0].purity, r[0].entropy, r[0].dominant, r[1].entropy) == (0.5, 1.0, "a", 0.0)
    same = mt.agreement(d.withColumn("z", F.concat(F.lit("q"), "c")), "z", "c").first()
    assert (same.ari, same.nmi, same.v_measure) == (1.0, 1.0, 1.0)
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (1, 4)], "src int, dst int")
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id int, label int")
    c = {x.cluster_id: x.conductance for x in mt.conductance(e, lab).collect()}
    assert c == {0: 0.25, 1: 0.0}


def test_inner_metrics_and_hdbscan(spark):
    x, d = points(spark)
    lab = np.arange(90) // 30
    D = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(90):
        a = D[i][lab == lab[i]].sum() / 29
        b = min(D[i][lab == k].mean() for k in range(3) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(mt.silhouette(d, "id", "label", "vec").first()[0] - np.mean(s)) < 1e-5
    got = {r.id: r.label for r in hd.hdbscan(d, "id", "vec", 10).collect()}
    assert all(len({got[i] for i in range(k, k + 30) if got[i] >= 0}) == 1 for k in (0, 30, 60)) and len(set(got.values()) - {-1}) == 3


def test_leiden_and_umap(spark):
    cliques = [(a + o, b + o, 1.0) for o in (0, 6, 12) for a in range(6) for b in range(a)] + [(0, 6, 1.0), (6, 12, 1.0)]
    for kind, g in (("modularity", 1.0), ("rb", 0.5), ("cpm", 0.3)):
        p = communities(18, cliques, kind, g)
        assert len(set(p)) == 3 and all(len(set(p[o : o + 6])) == 1 for o in (0, 6, 12))
    x, d = points(spark)
    y = np.array([r.vector for r in em.umap(d, "id", "vec", 2, metric="euclidean").orderBy("id").collect()])
    c = [y[k : k + 30].mean(0) for k in (0, 30, 60)]
    assert min(np.linalg.norm(c[0] - c[1]), np.linalg.norm(c[1] - c[2])) > max(y[k : k + 30].std() for k in (0,)) * 0.2


def test_projections(spark):
    cells = [(i, j, float((i * 7 + j * 3) % 5)) for i in range(12) for j in range(6)]
    u = em.truncated_svd(spark.createDataFrame(cells, "id bigint, col int, freq double"), 3).orderBy("id").collect()
    A = np.array([c[2] for c in cells]).reshape(12, 6)
    U, S, _ = np.linalg.svd(A, full_matrices=False)
    assert np.allclose(np.abs(np.array([r.vector for r in u])), np.abs(U[:, :3] * S[:3]), atol=1e-6)
    d = spark.createDataFrame([(1, "ABCD"), (2, "ABXD"), (3, "ZZ"), (4, "")], "id bigint, s string")
    assert all(len(r.vector) == 2 for r in em.landmark_mds(d, "id", "s", 3, 2).collect())
    assert em.budget_batches([3, 3, 5, 9, 1], 6) == [[0, 1], [2], [3], [4]]
    assert em.embed(d, "id", "s", "esm3").count() == 3


def test_identity(spark):
    a = "MKVLAAGIVGLPNVGKSTLFNALTRA"
    d = spark.createDataFrame([(1, a + "Q"), (2, a), (3, "WWWWHHHHYYYYCCCCDDDD"), (4, "")], "id bigint, s string")
    p = {r.id: list(r.profile) for r in idn.identity_profile(d, "id", "s").collect()}
    assert p[1][0] == p[2][0] == 1 and p[2][-1] == 2 and p[3] == [3] * 8 and p[4] == [-1] * 8
    g = {r.id: list(r.profile) for r in idn.greedy_profile(d, "id", "s").collect()}
    assert g[1][0] == g[2][0] and g[1][-1] != g[2][-1] and g[4] == [-1] * 5


def test_undirected(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7), (3, 3, 1.0)], "src int, dst int, weight double")
    assert [tuple(r) for r in undirected(e, "weight").collect()] == [(1, 2, 0.7)]
