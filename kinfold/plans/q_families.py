"""Queries of vectors, graphs, clusterings and their measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import vectors as vx
from kinfold.operators import curation as cur, embedding as em, identity as idn, metrics as mt
from kinfold.operators.hdbscan import core_distances, hdbscan, spanning_tree
from kinfold.operators.ivf import approximate_knn, measured_recall
from kinfold.operators.knn import BLOCK, knn, knn_graph, mutual
from kinfold.operators.leiden import PRESETS as LEIDEN, leiden
from kinfold.plans.registry import query
from kinfold.plans.tables import materialize, table as T

_ED = "(SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_KNN = f"""(SELECT src, dst, d, rank FROM (SELECT a.id AS src, b.id AS dst, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY round({_DIST}, 12), b.id) AS rank
    FROM {_ED} a JOIN {_ED} b ON a.id <> b.id) WHERE rank <= %d)"""
_EDGES = f"(SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(1 / (1 + d)) AS weight FROM {_KNN % 15} GROUP BY 1, 2)"


def E(spark, d):
    return T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


@query(f"SELECT id, i AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x FROM {_ED}, range(1, 65) AS r(i)")
def vec_l2_normalize(spark, d):
    return E(spark, d).select("id", F.posexplode(vx.l2_normalize(F.col("vec"))).alias("pos", "x")).select("id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""SELECT id, i AS pos, round(CASE WHEN i <= 64 THEN v[i] / sqrt(list_dot_product(v, v)) ELSE (CASE WHEN label > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END, 6) AS x FROM {_ED}, range(1, 66) AS r(i)""")
def vec_fuse_concat(spark, d):
    f = vx.fuse(F.col("vec"), F.array(F.col("label").cast("double")))
    return E(spark, d).select("id", F.posexplode(f).alias("pos", "x")).select("id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def _to_centroid(name: str, spark_fn, sql: str):
    """Distances of every vector to its cluster's centroid."""

    def run(spark, d):
        e = E(spark, d)
        c = mt.centroids(e, "label", "vec")
        return e.join(F.broadcast(c), "label").select("id", F.round(spark_fn(F.col("vec"), F.col("centroid")), 6).alias("d"))

    run.__name__ = name
    cent = f"(SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(v[i]) AS m FROM {_ED}, range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY 1)"
    query(f"SELECT a.id, round({sql}, 6) AS d FROM {_ED} a JOIN {cent} b USING (label)")(run)


_to_centroid("vec_euclidean", vx.euclidean, _DIST)
_to_centroid("vec_cosine", vx.cosine_distance, "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))")
_to_centroid("vec_manhattan", vx.manhattan, "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))")


@query(f"SELECT id, CAST(1 AS BIGINT) AS tokens, round(list_sum(list_transform(v, lambda x: x)) / 64, 6) AS mean FROM {_ED}")
def masked_mean_pool(spark, d):
    """Each vector as 64 token states of one number, all unmasked but for a masked one in front."""
    hidden = F.concat(F.array(F.array(F.lit(9.0))), F.transform("vec", lambda x: F.array(x.cast("double"))))
    mask = F.concat(F.array(F.lit(0)), F.transform("vec", lambda _: F.lit(1)))
    return E(spark, d).select("id", F.lit(1).cast("bigint").alias("tokens"), F.round(F.element_at(vx.mean_pool(hidden, mask), 1), 6).alias("mean"))


_LAND = f"""(SELECT d.doc_id AS id, l.doc_id AS landmark, list_sum(list_transform(range(1, least(length(d.t), length(l.t)) + 1), lambda i: CASE WHEN d.t[i] <> l.t[i] THEN 1 ELSE 0 END)) AS wrong, d.t AS x, l.t AS y
    FROM (SELECT doc_id, text AS t FROM documents WHERE n_chars BETWEEN 30 AND 1175) d, (SELECT doc_id, text AS t FROM documents WHERE n_chars BETWEEN 30 AND 1175 ORDER BY doc_id LIMIT 20) l)"""


def _curated(spark, d):
    return cur.curate(T(spark, d, "documents"), "n_chars")


@query(f"SELECT id, landmark, round((wrong + abs(length(x) - length(y))) / greatest(length(x), length(y)), 6) AS d FROM {_LAND}")
def padded_hamming_landmarks(spark, d):
    c = _curated(spark, d)
    return em.landmark_distances(c, em.landmarks(c, "doc_id", "text", 20), "doc_id", "text").withColumn("d", F.round("d", 6))


@query(f"SELECT id, landmark, round(d - avg(d) OVER (PARTITION BY id), 6) AS d FROM (SELECT id, landmark, (wrong + abs(length(x) - length(y))) / greatest(length(x), length(y)) AS d FROM {_LAND})")
def landmark_row_centered(spark, d):
    from pyspark.sql import Window

    c = _curated(spark, d)
    x = em.landmark_distances(c, em.landmarks(c, "doc_id", "text", 20), "doc_id", "text")
    return x.select("id", "landmark", F.round(F.col("d") - F.avg("d").over(Window.partitionBy("id")), 6).alias("d"))


@query(f"SELECT src, dst, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM {_KNN % 15}")
def knn_15(spark, d):
    return knn(E(spark, d), "id", "vec", 15).select("src", "dst", F.round("d", 6).alias("d"), "rank")


@query(f"SELECT src, dst, round(weight, 6) AS weight FROM {_EDGES}")
def knn_edges_symmetric(spark, d):
    return knn_graph(E(spark, d), "id", "vec", 15).withColumn("weight", F.round("weight", 6))


@query(f"SELECT src, dst, round(1 / (1 + d), 6) AS weight FROM {_KNN % 14}")
def similarity_weights(spark, d):
    return knn(E(spark, d), "id", "vec", 14).select("src", "dst", F.round(vx.similarity(F.col("d")), 6).alias("weight"))


@query(f"SELECT a.src, a.dst FROM {_KNN % 15} a JOIN {_KNN % 15} b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_knn(spark, d):
    return mutual(knn(E(spark, d), "id", "vec", 15))


@query("""WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS size, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rn FROM g)
    SELECT lang AS cluster_id, CAST(max(size) AS BIGINT) AS size, max(source) FILTER (rn = 1) AS dominant, max(n) AS dominant_n, round(max(n / size), 4) AS purity, round(-sum(n / size * log2(n / size)), 4) AS entropy, count(*) AS distinct_values FROM s GROUP BY 1""")
def cluster_purity_entropy(spark, d):
    return mt.purity_entropy(T(spark, d, "documents"), "lang", "source")


@query(f"SELECT label, i AS pos, round(avg(v[i]), 6) AS x FROM {_ED}, range(1, 65) AS r(i) GROUP BY 1, 2")
def cluster_centroid(spark, d):
    c = mt.centroids(E(spark, d), "label", "vec").select("label", F.posexplode("centroid").alias("pos", "x"))
    return c.select("label", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


_CENT = f"(SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(v[i]) AS m FROM {_ED}, range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH d AS (SELECT a.label, {_DIST} AS d FROM {_ED} a JOIN {_CENT} b USING (label)),
    v AS (SELECT label, sum(x) AS variance FROM (SELECT label, i, var_pop(v[i]) AS x FROM {_ED}, range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY 1)
    SELECT label AS cluster_id, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS radius, round(max(variance), 6) AS variance FROM d JOIN v USING (label) GROUP BY 1""")
def cluster_radius_variance(spark, d):
    return mt.radius_variance(E(spark, d), "label", "vec")


@query(f"""WITH e AS (SELECT x.label AS ls, y.label AS ld FROM {_EDGES} g JOIN embeddings x ON x.vec_id = g.src JOIN embeddings y ON y.vec_id = g.dst),
    c AS (SELECT ls AS label, CASE WHEN ls = ld THEN 1 ELSE 0 END AS i, CASE WHEN ls <> ld THEN 1 ELSE 0 END AS o FROM e UNION ALL SELECT ld, 0, 1 FROM e WHERE ls <> ld),
    s AS (SELECT label, CAST(sum(i) AS BIGINT) AS internal, CAST(sum(o) AS BIGINT) AS boundary FROM c GROUP BY 1), z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1)
    SELECT label AS cluster_id, size, coalesce(internal, 0) AS internal, coalesce(boundary, 0) AS boundary,
    round(CASE WHEN size > 1 AND 2 * internal + boundary > 0 THEN boundary / (2 * internal + boundary) ELSE 0 END, 6) AS conductance FROM z LEFT JOIN s USING (label)""")
def cluster_conductance(spark, d):
    e = E(spark, d)
    return mt.conductance(knn_graph(e, "id", "vec", 15), e.select("id", "label"))


@query(f"""SELECT a.id AS member, CAST(a.id % 7 AS VARCHAR) || ' unknown' AS product, round({_DIST}, 6) AS distance, true AS hypothetical FROM {_ED} a JOIN {_CENT} b USING (label) WHERE a.label = 3""")
def cluster_drilldown(spark, d):
    e = E(spark, d).withColumn("product", F.concat(F.pmod("id", F.lit(7)).cast("string"), F.lit(" unknown")))
    return mt.drill_down(e, "label", 3, "id", "vec", "product").orderBy("distance", "member")


@query("""WITH t AS (SELECT source AS y, lang AS c, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), r AS (SELECT sum(n) AS a FROM t GROUP BY y), k AS (SELECT sum(n) AS b FROM t GROUP BY c),
    s AS (SELECT (SELECT sum(a) FROM r) AS m, (SELECT sum(a * (a - 1) / 2) FROM r) AS pa, (SELECT sum(b * (b - 1) / 2) FROM k) AS pb, (SELECT sum(n * (n - 1) / 2) FROM t) AS pn,
      (SELECT sum(a * ln(a)) FROM r) AS la, (SELECT sum(b * ln(b)) FROM k) AS lb, (SELECT sum(n * ln(n)) FROM t) AS l),
    x AS (SELECT *, ln(m) - la / m AS hy, ln(m) - lb / m AS hc, (l - la - lb) / m + ln(m) AS mi, pa * pb / (m * (m - 1) / 2) AS ex FROM s)
    SELECT round((pn - ex) / ((pa + pb) / 2 - ex), 6) AS ari, round(2 * mi / (hy + hc), 6) AS nmi, round(mi / hy, 6) AS homogeneity, round(mi / hc, 6) AS completeness, round(2 * (mi / hy) * (mi / hc) / (mi / hy + mi / hc), 6) AS v_measure FROM x""")
def ext_ari_nmi_hcv(spark, d):
    return mt.agreement(T(spark, d, "documents"), "source", "lang")


@query("SELECT count(DISTINCT CASE WHEN label - 1 <> -1 THEN label - 1 END) AS clusters, round(avg(CASE WHEN label - 1 = -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS noise_ratio FROM embeddings")
def noise_ratio(spark, d):
    return mt.noise_report(E(spark, d).withColumn("label", F.col("label") - 1), "label")


@query(f"""WITH s AS (SELECT a.id, a.label AS own, b.label, sum({_DIST}) AS s FROM {_ED} a JOIN {_ED} b ON true GROUP BY 1, 2, 3), z AS (SELECT label, count(*) AS m FROM embeddings GROUP BY 1),
    p AS (SELECT id, max(CASE WHEN label = own THEN m END) AS m, max(CASE WHEN label = own AND m > 1 THEN s / (m - 1) END) AS a, min(CASE WHEN label <> own THEN s / m END) AS b FROM s JOIN z USING (label) GROUP BY 1)
    SELECT round(avg(CASE WHEN m = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM p""")
def silhouette_exact(spark, d):
    return mt.silhouette(E(spark, d), "id", "label", "vec")


@query(f"""WITH s AS (SELECT a.label, avg({_DIST}) AS s FROM {_ED} a JOIN {_CENT} b USING (label) GROUP BY 1), c AS (SELECT label, s, v FROM s JOIN {_CENT} USING (label)),
    w AS (SELECT a.label, max((a.s + b.s) / {_DIST}) AS w FROM c a JOIN c b ON a.label <> b.label GROUP BY 1) SELECT round(avg(w), 6) AS davies_bouldin FROM w""")
def davies_bouldin(spark, d):
    return mt.davies_bouldin(E(spark, d), "label", "vec")


@query(f"""WITH x AS (SELECT label, i, v[i] AS x FROM {_ED}, range(1, 65) AS r(i)), g AS (SELECT label, i, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM x GROUP BY 1, 2),
    p AS (SELECT i, sum(n) AS n, sum(w) AS w, count(*) AS k, sum(n * m * m) - sum(n * m) ^ 2 / sum(n) AS b FROM g GROUP BY 1)
    SELECT round((sum(b) / (max(k) - 1)) / (sum(w) / (max(n) - max(k))), 4) AS calinski_harabasz FROM p""")
def calinski_harabasz(spark, d):
    return mt.calinski_harabasz(E(spark, d), "label", "vec")


@query(f"SELECT src AS id, round(d, 6) AS core FROM {_KNN % 20} WHERE rank = 20")
def core_distance(spark, d):
    return core_distances(E(spark, d), "id", "vec", 20).withColumn("core", F.round("core", 6))


@query(f"""WITH e AS MATERIALIZED {_ED}, k AS MATERIALIZED (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY round(d, 12), dst) AS rank
      FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id <> b.id) QUALIFY rank <= 20),
    c AS (SELECT src AS id, d AS core FROM k WHERE rank = 20) SELECT src, dst, round(greatest(x.core, y.core, d), 6) AS reach FROM k JOIN c x ON x.id = src JOIN c y ON y.id = dst""")
def mutual_reachability(spark, d):
    k = knn(E(spark, d), "id", "vec", 20)
    core = k.where("rank = 20").select(F.col("src").alias("id"), F.col("d").alias("core"))
    a, b = core.toDF("src", "ca"), core.toDF("dst", "cb")
    return k.join(a, "src").join(b, "dst").select("src", "dst", F.round(F.greatest("ca", "cb", "d"), 6).alias("reach"))


@query()
def mst_weight(spark, d):
    return spanning_tree(E(spark, d), "id", "vec", 20).agg(F.count("*").alias("edges"), F.round(F.sum("w"), 6).alias("weight"))


_GQ = f"WITH g AS {_EDGES}, e AS (SELECT g.weight AS w, x.label AS ls, y.label AS ld FROM g JOIN embeddings x ON x.vec_id = src JOIN embeddings y ON y.vec_id = dst)"


@query(f"{_GQ} SELECT round(sum(CASE WHEN ls = ld THEN w ELSE 0 END) - 0.05::DOUBLE * (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)), 6) AS quality FROM e")
def cpm_quality(spark, d):
    e = E(spark, d)
    return mt.partition_quality(knn_graph(e, "id", "vec", 15), e.select("id", "label"), "cpm", 0.05)


_K2 = "(SELECT sum(k * k) FROM (SELECT sum(w) AS k FROM (SELECT ls AS c, w FROM e UNION ALL SELECT ld, w FROM e) GROUP BY c))"


@query(f"{_GQ} SELECT round((sum(CASE WHEN ls = ld THEN w ELSE 0 END) - {_K2} / (4 * sum(w))) / sum(w), 6) AS quality FROM e")
def modularity_quality(spark, d):
    e = E(spark, d)
    return mt.partition_quality(knn_graph(e, "id", "vec", 15), e.select("id", "label"), "modularity")


@query(f"{_GQ} SELECT round(sum(CASE WHEN ls = ld THEN w ELSE 0 END) - 0.5::DOUBLE * {_K2} / (4 * sum(w)), 6) AS quality FROM e")
def rb_quality(spark, d):
    e = E(spark, d)
    return mt.partition_quality(knn_graph(e, "id", "vec", 15), e.select("id", "label"), "rb", 0.5)


def _leiden(preset):
    def run(spark, d):
        e = E(spark, d)
        weighted = preset.startswith("cpm")
        return leiden(knn_graph(e, "id", "vec", 14, weighted=weighted), e.select("id"), *LEIDEN[preset])

    run.__name__ = f"leiden_{preset}"
    query()(run)


for _p in LEIDEN:
    _leiden(_p)


@query(f"{_GQ} SELECT round(sum(CASE WHEN ls = ld THEN w ELSE 0 END) - 0.05::DOUBLE * (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)), 6) AS of_labels, true AS reached FROM e")
def leiden_in_blocks(spark, d):
    """The quality of the given labels, and whether communities found in blocks of a quarter of the graph reach it."""
    e = E(spark, d)
    g = materialize(knn_graph(e, "id", "vec", 15), "knn-graph")
    found = leiden(g, e.select("id"), *LEIDEN["cpm_raw"], block=max(2, e.count() // 4), rounds=2, passes=1)
    of = mt.partition_quality(g, e.select("id", "label"), *LEIDEN["cpm_raw"]).withColumnRenamed("quality", "of_labels")
    best = mt.partition_quality(g, found, *LEIDEN["cpm_raw"])
    return of.join(F.broadcast(best)).select("of_labels", (F.col("quality") >= F.col("of_labels")).alias("reached"))  # one row each


@query()
def hdbscan_labels(spark, d):
    return hdbscan(E(spark, d), "id", "vec")


@query("SELECT count(*) AS points, count(*) AS agree FROM embeddings")
def hdbscan_in_blocks(spark, d):
    """On how many points the labels found by joins, over blocks of a quarter of the rows (BLOCK at most), agree with those of the list form."""
    e = E(spark, d)
    one, many = hdbscan(e, "id", "vec"), hdbscan(e, "id", "vec", block=min(BLOCK, max(64, e.count() // 4)), whole=0)
    return one.join(many.withColumnRenamed("label", "other"), "id", "full").agg(F.count("*").alias("points"), F.count_if(F.col("label") == F.col("other")).alias("agree"))


@query()
def umap_2d(spark, d):
    return em.umap(E(spark, d), "id", "vec", 2)


@query()
def svd_50(spark, d):
    from kinfold.operators import kmers as km

    return em.truncated_svd(km.bounded_columns(km.kmer_counts(_curated(spark, d), "doc_id", "text", [6])), 50)


@query()
def lmds_project(spark, d):
    return em.landmark_mds(_curated(spark, d), "doc_id", "text")


@query()
def linclust_profile(spark, d):
    return idn.identity_profile(_curated(spark, d), "doc_id", "text")


@query()
def cdhit_profile(spark, d):
    return idn.greedy_profile(_curated(spark, d), "doc_id", "text")


def _embed(model):
    def run(spark, d):
        return em.embed(_curated(spark, d), "doc_id", "text", model)

    run.__name__ = f"embed_{model}"
    query()(run)


for _m in em.MODELS:
    _embed(_m)


@query(f"""SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY 1 ORDER BY 2 DESC, 1""")
def cluster_sizes(spark, d):
    return E(spark, d).groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster_id")


def _flag_sql() -> str:
    from kinfold.plans.registry import ORACLE_SQL as S

    return f"""WITH p AS (SELECT label AS c, CAST(vec_id % 5 AS VARCHAR) AS y, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY c) AS size, row_number() OVER (PARTITION BY c ORDER BY n DESC, y) AS rn FROM p),
    t AS (SELECT c AS cluster_id, CAST(max(size) AS BIGINT) AS size, max(y) FILTER (rn = 1) AS dominant, max(n) AS dominant_n, round(max(n / size), 4) AS purity, round(-sum(n / size * log2(n / size)), 4) AS entropy, count(*) AS distinct_values FROM s GROUP BY 1)
    SELECT * FROM t JOIN ({S['cluster_radius_variance']}) USING (cluster_id) JOIN (SELECT cluster_id, internal, boundary, conductance FROM ({S['cluster_conductance']})) USING (cluster_id)"""


@query(_flag_sql())
def cluster_table(spark, d):
    e = E(spark, d).withColumn("product", F.pmod("id", F.lit(5)).cast("string"))
    return mt.cluster_table(e, knn_graph(e, "id", "vec", 15), "id", "label", "vec", "product")


_COS = "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


def _graph_sql(name: str, k: int, dist: str, weighted: bool, extra: str = "") -> str:
    """The edges of one preset, counted and added up."""
    w = "1 / (1 + d)" if weighted else "1.0::DOUBLE"
    return f"""SELECT '{name}' AS preset, count(*) AS edges, round(sum(w), 6) AS weight FROM (SELECT least(src, dst) AS x, greatest(src, dst) AS y, max({w}) AS w FROM
        (SELECT a.id AS src, b.id AS dst, {dist} AS d, row_number() OVER (PARTITION BY a.id ORDER BY round({dist}, 12), b.id) AS rank FROM {_ED} a JOIN {_ED} b ON a.id <> b.id) WHERE rank <= {k} {extra} GROUP BY 1, 2)"""


@query(" UNION ALL ".join([_graph_sql("reduced", 15, _DIST, True, "AND d > 0"), _graph_sql("fused", 15, _COS, False), _graph_sql("raw", 14, _DIST, True), _graph_sql("plots", 14, _DIST, False)]))
def undirected_presets(spark, d):
    """Edges of the four neighbour graphs, counted."""
    from kinfold.operators.knn import PRESETS

    out = None
    for name, p in PRESETS.items():
        g = knn_graph(E(spark, d), "id", "vec", **p).agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight")).select(F.lit(name).alias("preset"), "edges", "weight")
        out = g if out is None else out.unionByName(g)
    return out


@query()
def knn_approximate(spark, d):
    """The 15 nearest by cosine, from inverted lists of 64 rows on average, so that small tables are probed too."""
    e = E(spark, d)
    return approximate_knn(e, "id", "vec", 15, "cosine", lists=max(2, e.count() // 64)).select("src", "dst", F.round("d", 6).alias("d"), "rank")


@query()
def knn_approximate_recall(spark, d):
    """What part of the exact neighbours of all rows the approximate ones hold."""
    return measured_recall(knn_approximate(spark, d), knn(E(spark, d), "id", "vec", 15, "cosine"))


_DRILL = f"SELECT CAST(a.id % 7 AS VARCHAR) || CASE WHEN a.id % 3 = 0 THEN ' unknown' ELSE ' kinase' END AS product, a.id % 3 = 0 AS hypothetical, {_DIST} AS distance FROM {_ED} a JOIN {_CENT} b USING (label) WHERE a.label = 3"


def _members(spark, d):
    kind = F.when(F.col("id") % 3 == 0, " unknown").otherwise(" kinase")
    e = E(spark, d).withColumn("product", F.concat(F.pmod("id", F.lit(7)).cast("string"), kind))
    return mt.drill_down(e, "label", 3, "id", "vec", "product")


@query(f"SELECT count(*) AS members, round(avg(distance), 6) AS mean_distance, round(max(distance), 6) AS max_distance, round(100 * avg(CASE WHEN hypothetical THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS percent_hypothetical FROM ({_DRILL})")
def drill_summary(spark, d):
    return mt.drill_summary(_members(spark, d))


@query(f"SELECT product, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM ({_DRILL})), 2) AS percent FROM ({_DRILL}) GROUP BY 1")
def drill_products(spark, d):
    return mt.product_shares(_members(spark, d))


_SUB = f"(SELECT * FROM {_ED} ORDER BY md5('42:' || id), id LIMIT 300)"


@query(f"""WITH e AS MATERIALIZED {_SUB}, s AS (SELECT a.id, a.label AS own, b.label, sum({_COS}) AS s FROM e a JOIN e b ON true GROUP BY 1, 2, 3), z AS (SELECT label, count(*) AS m FROM e GROUP BY 1),
    p AS (SELECT id, max(CASE WHEN label = own THEN m END) AS m, max(CASE WHEN label = own AND m > 1 THEN s / (m - 1) END) AS a, min(CASE WHEN label <> own THEN s / m END) AS b FROM s JOIN z USING (label) GROUP BY 1)
    SELECT round(avg(CASE WHEN m = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM p""")
def silhouette_sampled(spark, d):
    """By cosine, over a seeded sample of 300 rows."""
    return mt.silhouette(E(spark, d), "id", "label", "vec", "cosine", sample=300).select(F.round("silhouette", 5).alias("silhouette"))
