"""Readers, stores, approximate neighbours and benchmarks on small inputs."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.sequences import id_from_filename
from kinfold.operators import drivers, embedding, features, hdbscan, store
from kinfold.operators.ivf import approximate_knn, measured_recall
from kinfold.operators.knn import knn
from kinfold.plans.tables import numbered
from kinfold.sources import formats

RECORD = "LOCUS       A 9 bp\nVERSION     A.1\nFEATURES             Location/Qualifiers\n     CDS             {spot}\n                     /protein_id=\"P1\"\nORIGIN\n        1 atgcccgtt\n//\n"


@pytest.mark.parametrize(
    "spot, nt, strand",
    [
        ("1..3", "ATG", 1),
        ("complement(1..3)", "CAT", -1),
        ("join(1..3,7..9)", "ATGGTT", 1),
        ("join(complement(5..7),complement(1..3))", "CGGCAT", -1),
        ("complement(join(1..3,5..7))", "CGGCAT", -1),
        ("join(1..3,complement(7..9))", "ATGAAC", None),
        ("<1..>3", "ATG", 1),
    ],
)
def test_locations(spot, nt, strand):
    gene = next(formats.parse_genbank(RECORD.format(spot=spot)))
    assert (gene["nt_sequence"], gene["location"]["strand"]) == (nt, strand)


def test_files(spark, tmp_path):
    d = tmp_path / "gb" / "A"
    d.mkdir(parents=True)
    (d / "x.1.gb").write_text(RECORD.format(spot="1..3").replace('"P1"', '"no_id"') * 2)
    (d / "bad.GENBANK").write_bytes(RECORD.format(spot="1..99999999999999999999999").encode())
    (d / "other.txt").write_text("x")
    files = formats.scan_files(spark, str(tmp_path / "gb"))
    assert files.count() == 2
    genes, errors = formats.split_errors(formats.genbank_genes(files))
    assert genes.count() == 2 and ["bad.GENBANK" in r["path"] and "32 bits" in r["message"] for r in errors.collect()] == [True]
    assert [tuple(r) for r in formats.collapsed_ids(genes).collect()] == [("A.1", 1)]
    have = spark.createDataFrame([("x.1",), ("x",), ("y.2",)], "accession string")
    assert [r["accession"] for r in formats.missing_files(have, files).collect()] == ["y.2"]
    r = tmp_path / "reports"
    r.mkdir()
    (r / "reporte_cluster_12.txt").write_text("A\nDETALLE\nprotein_id product\nP1 x\n")
    (r / "reporte_cluster_ab.txt").write_text("B")
    (r / "note.txt").write_text("C")
    got = formats.read_reports(spark, str(r)).collect()
    assert {(x["cluster"], x["cluster_number"]) for x in got} == {("12", 12), ("ab", None)}
    text, number = id_from_filename(F.lit("/a/reporte_cluster_7.txt"))
    assert tuple(spark.range(1).select(text, number).first()) == ("7", 7)
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write("#id\nV1\ta\tb\tc\t10.P1,P2\n")
    assert {tuple(x) for x in formats.read_ortholog_index(spark, str(tmp_path / "m.tsv.gz")).collect()} == {("10.P1", "V1"), ("P1", "V1"), ("P2", "V1")}
    formats.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "rep"), "Title")
    assert spark.read.text(str(tmp_path / "rep")).count() >= 4
    for _ in range(2):
        formats.write_csv(spark.range(2), str(tmp_path / "csv"), "append")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 4
    assert spark.range(1).select(features.first_candidate(spark.range(1), ["nothing", "id"]).alias("x")).first()["x"] == 0
    calls = formats.fetch_batches(spark.createDataFrame([("a",), ("b",)], "accession string"), lambda ids: {i: i.upper() for i in ids}, wait=0, pause=0)
    assert {r["content"] for r in calls.collect()} == {"A", "B"}


def test_lines_in_ranges(spark):
    rows = [(i, ">Cluster %d" % (i // 10) if i % 10 == 3 else f"0 10aa, >P{i}... *") for i in range(60)]
    d = spark.createDataFrame(rows, "pos int, line string").repartition(5)
    want = {(f"P{i}", (i if i % 10 > 3 else i - 10) // 10) for i in range(4, 60) if i % 10 != 3}
    assert {tuple(r) for r in formats.clstr(d, "pos", "line").collect()} == want
    assert {tuple(r) for r in formats.clstr(d.withColumn("f", F.lit(1)), "pos", "line", "f").collect()} == want
    n = numbered(d, F.desc("pos")).collect()
    assert {(r["pos"], r["number"]) for r in n} == {(i, 59 - i) for i in range(60)}


def test_stores(spark, tmp_path):
    at = str(tmp_path / "t")
    store.append(spark.range(5), at)
    assert store.append(spark.range(5), at).count() == 10
    assert store.replace(spark.read.parquet(at).where("id > 2"), at).count() == 4
    assert store.append(spark.range(3), at, replacing=True).count() == 3
    by = store.laid_out(spark.range(100).withColumn("k", F.lit(100) - F.col("id")), str(tmp_path / "l"), ["k"])
    assert by.count() == 100
    calls = []
    for n in (1, 1, 2):
        got = store.memoized(spark, "m", {"n": n}, lambda n=n: calls.append(n) or spark.range(n), str(tmp_path))
        assert got.count() == n
    assert calls == [1, 2]
    labels, edges = store.save_partition(spark.range(2), spark.range(3), str(tmp_path / "p"))
    assert (labels.count(), edges.count()) == (2, 3)
    keys, seen = spark.range(7).withColumnRenamed("id", "c"), []

    def measure(part):
        seen.append(part.count())
        return part.withColumn("x", F.col("c") * 2)

    path = str(tmp_path / "c")
    assert store.resumable_clusters(keys.where("c < 3"), "c", measure, path, "a", 2).count() == 3
    seen.clear()
    assert store.resumable_clusters(keys, "c", measure, path, "a", 2).count() == 7 and sum(seen) == 4
    assert store.resumable_clusters(keys, "c", measure, path, "b", 100).count() == 7


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_approximate_neighbours(spark, metric):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8)) * 3
    x = np.concatenate([centres[r.integers(0, 12, 700)] + r.normal(size=(700, 8)), np.repeat(centres[:1], 150, axis=0)])
    d = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id bigint, vec array<double>")
    got = approximate_knn(d, "id", "vec", 10, metric, lists=12)
    exact = knn(d.where("id < 700"), "id", "vec", 10, metric)
    assert got.groupBy("src").count().where("count <> 10").count() == 0
    near = got.where("src < 700 and dst < 700")
    other = exact.join(got.where("dst >= 700").select("src").distinct(), "src", "left_anti")
    assert measured_recall(near, other).first()["recall"] >= 0.9


def test_benchmark_skips_what_fails(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(30, 6)), r.normal(size=(30, 6)) + 9])
    d = spark.createDataFrame([(i, str(i // 30), [float(t) for t in v]) for i, v in enumerate(x)], "id bigint, truth string, vec array<double>")
    fail = lambda: (_ for _ in ()).throw(ValueError("no such table"))
    spaces = {"first": (fail, "cosine"), "dense": (lambda: (d, 6), "euclidean"), "empty": (lambda: (d.limit(0), 6), "cosine")}
    got = drivers.benchmark(spark, spaces).collect()
    assert [(x["strategy"], x["algorithm"], x["error"] is None) for x in got] == [("first", None, False), ("dense", "UMAP+HDBSCAN", True), ("dense", "kNN+Leiden", True), ("empty", None, False)]
    assert got[1]["clusters"] == 2 and got[1]["ari"] == 1.0 and got[1]["silhouette"] > 0.5
    assert len(drivers.fusions("abcd")) == 11


def test_tree_of_blocks_equals_that_of_one_block(spark):
    r = np.random.default_rng(3)
    d = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(r.normal(size=(80, 4)))], "id bigint, vec array<double>")
    small = hdbscan.spanning_tree(d, "id", "vec", 5).agg(F.count("*"), F.round(F.sum("w"), 9)).first()
    assert hdbscan.spanning_tree(d, "id", "vec", 5, block=16).agg(F.count("*"), F.round(F.sum("w"), 9)).first() == small


def test_prepared_residues(spark):
    seen = spark.createDataFrame([(1, "muzob"), (2, "")], "id bigint, s string")
    model = lambda: lambda batch: [np.array([[float(s == "M X X X X")]] * 3) for s in batch]
    assert [r["vector"] for r in embedding.embed(seen, "id", "s", "prott5", model).collect()] == [[1.0]]

    def breaks():
        def run(batch):
            if len(batch) > 1:
                raise MemoryError
            return [np.ones((3, 1))]

        return run

    two = spark.createDataFrame([(1, "AB"), (2, "CD")], "id bigint, s string").coalesce(1)
    assert embedding.embed(two, "id", "s", "esm2", breaks).count() == 2

    def device(message):
        def build():
            def run(batch):
                if len(batch) > 1:
                    raise RuntimeError(message)
                return [np.ones((3, 1))]

            return run

        return build

    for message in ("CUDA error: device-side assert", "INTERNAL ASSERT FAILED at x.cpp", "CUDA Out Of Memory"):
        assert embedding.embed(two, "id", "s", "esm2", device(message)).count() == 2
    with pytest.raises(Exception, match="wrong shape"):
        embedding.embed(two, "id", "s", "esm2", device("wrong shape")).count()


def test_inner_measures_are_null_where_they_mean_nothing(spark):
    rows = [(i, [float(i), 1.0], "a" if i % 2 else "b") for i in range(6)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, truth string")
    label = lambda f: df.select("id", F.lit(0).alias("label")).rdd.map(lambda r: (r["id"], f(r["id"]))).toDF("id bigint, label int")
    one = drivers.score(df, label(lambda i: 0), "s", "a", 2).first()
    none = drivers.score(df, label(lambda i: -1), "s", "a", 2).first()
    few = drivers.score(df, label(lambda i: i if i < 3 else -1), "s", "a", 2).first()  # as many rows as clusters
    two = drivers.score(df, label(lambda i: i // 3), "s", "a", 2).first()
    for r in (one, none, few):
        assert r["silhouette"] is r["davies_bouldin"] is r["calinski_harabasz"] is None
    assert two["silhouette"] is not None and two["clusters"] == 2
    alone = drivers.score(df, label(lambda i: i if i < 3 else -1), "s", "a", 2, "fusion").first()
    assert alone["silhouette"] == 0 and alone["calinski_harabasz"] is None
