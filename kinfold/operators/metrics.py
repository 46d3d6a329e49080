"""Agreement with known classes, inner quality of clusterings, and per-cluster tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.functions.sequences import hypothetical
from kinfold.functions.vectors import euclidean
from kinfold.operators.curation import sample_rows
from kinfold.operators.knn import block_arrays, exact_distances, fast_distances, packed, pair_blocks, query_groups
from kinfold.plans.tables import materialize

_PAIRS = lambda c: c * (c - 1) / 2


def contingency(df: DataFrame, truth: str, label: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("y"), F.col(label).alias("c")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, truth: str, label: str) -> DataFrame:
    """ARI, NMI (arithmetic mean), homogeneity, completeness and V measure; noise is a class.

    One pass makes the table of counts; the rest are sums over it. Degenerate cases: no
    entropy gives homogeneity and completeness 1, a single cluster on both sides ARI 1.
    """
    t = contingency(df, truth, label).select("y", "c", F.col("n").cast("double").alias("n"))
    rows = t.groupBy("y").agg(F.sum("n").alias("a"))
    cols = t.groupBy("c").agg(F.sum("n").alias("b"))
    tot = rows.agg(F.sum("a").alias("m"), F.sum(_PAIRS(F.col("a"))).alias("pa"), F.sum(F.col("a") * F.ln("a")).alias("la"))
    tot = tot.join(cols.agg(F.sum(_PAIRS(F.col("b"))).alias("pb"), F.sum(F.col("b") * F.ln("b")).alias("lb")))
    tot = tot.join(t.agg(F.sum(_PAIRS(F.col("n"))).alias("pn"), F.sum(F.col("n") * F.ln("n")).alias("ln")))
    m = F.col("m")
    hy, hc = F.ln(m) - F.col("la") / m, F.ln(m) - F.col("lb") / m
    mi = (F.col("ln") - F.col("la") - F.col("lb")) / m + F.ln(m)
    hom, com = F.when(hy > 1e-12, mi / hy).otherwise(1.0), F.when(hc > 1e-12, mi / hc).otherwise(1.0)
    expected = F.col("pa") * F.col("pb") / F.greatest(_PAIRS(m), F.lit(1.0))
    spread = (F.col("pa") + F.col("pb")) / 2 - expected
    ari = F.when(F.abs(spread) > 1e-12, (F.col("pn") - expected) / spread).otherwise(1.0)
    nmi = F.when(hy + hc > 1e-12, 2 * mi / (hy + hc)).otherwise(1.0)
    v = F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0)
    return tot.select(*[F.round(x, 6).alias(k) for k, x in (("ari", ari), ("nmi", nmi), ("homogeneity", hom), ("completeness", com), ("v_measure", v))])


def noise_report(df: DataFrame, label: str) -> DataFrame:
    """Clusters without noise (-1), and the part of rows that are noise."""
    return df.agg(F.countDistinct(F.when(F.col(label) != -1, F.col(label))).alias("clusters"), F.round(F.avg((F.col(label) == -1).cast("double")), 4).alias("noise_ratio"))


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Element-wise means, as arrays."""
    x = df.select(F.col(label).alias("label"), F.posexplode(vec).alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("centroid"))


def silhouette(df: DataFrame, id_col: str, label: str, vec: str, metric: str = "euclidean", noise: int = -1, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Mean silhouette without noise; a cluster of one scores 0. Null unless there are 2 clusters.

    Exact over all rows, or over a seeded ``sample`` of them, as the benchmarks do.

    Points are dealt to groups as in ``knn``, and all points stream past each group in the order of clusters, so that a
    point holds the sum of distances to one cluster at a time, and is shuffled once and once for each group.
    """
    rows = df.where(F.col(label) != noise).select(F.col(id_col).cast("bigint").alias("i"), F.transform(vec, lambda x: x.cast("double")).alias("vec"), F.col(label).cast("bigint").alias("label"))
    if sample:
        rows = materialize(sample_rows(rows, "i", sample, seed), "silhouette-sample")
    groups, parts = query_groups(rows.count()), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        queries, sums = [], None
        for b in batches:
            for query, ids, v, lab in zip(*(b.column(c).to_pylist() for c in ("query", "ids", "v", "lists"))):
                ids, lab = np.frombuffer(ids, np.int64), np.frombuffer(lab, np.int64)
                v = np.frombuffer(v, float).reshape(len(ids), -1)
                if query:
                    if sums:  # the next group of this task
                        yield from sums.batches()
                        queries, sums = [], None
                    queries.append((ids, v, lab))
                elif queries:
                    sums = sums or _Sums(*(np.concatenate(x) for x in zip(*queries)), metric)
                    sums.see(ids, v, lab)
        if sums:
            yield from sums.batches()

    dealt = packed(rows.repartitionByRange(parts, "label").sortWithinPartitions("label"), groups)
    dealt = dealt.repartitionById(groups, F.col("part")).sortWithinPartitions("part", F.desc("query"), "place")
    per = dealt.mapInArrow(run, "i bigint, m bigint, a double, b double")
    score = F.when(F.col("m") == 1, 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.when(F.col("b").isNotNull(), 0.0)))
    return per.agg(F.round(F.avg(score), 6).alias("silhouette"))


class _Sums:
    """Of each point of a group: the size of its own cluster, the mean distance to its other points, and the least mean distance to another cluster.

    Points of a cluster follow each other.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, own: np.ndarray, metric: str):
        self.ids, self.v, self.own, self.metric = ids, v, own, metric
        self.label, self.count, self.sum = None, 0, np.zeros(len(ids))
        self.m, self.a, self.b = np.zeros(len(ids), np.int64), np.full(len(ids), np.nan), np.full(len(ids), np.inf)

    def _close(self, at: slice, labels: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        mine = self.own[at][:, None] == labels[None]
        self.b[at] = np.minimum(self.b[at], np.where(mine, np.inf, sums / counts).min(axis=1, initial=np.inf))
        i, j = np.nonzero(mine)
        n = counts[j]
        self.m[at][i], self.a[at][i] = n, np.where(n > 1, sums[i, j] / np.maximum(n - 1, 1), np.nan)

    def see(self, rid: np.ndarray, r: np.ndarray, lab: np.ndarray) -> None:
        start = np.flatnonzero(np.r_[True, lab[1:] != lab[:-1]])
        labels, counts = lab[start], np.diff(np.r_[start, len(lab)])
        goes_on = self.label == labels[0]
        counts[0] += self.count if goes_on else 0
        step = max(1, (1 << 21) // (len(rid) * (r.shape[1] if self.metric == "manhattan" else 1)))
        for k in range(0, len(self.ids), step):
            at = slice(k, min(k + step, len(self.ids)))
            d = fast_distances(self.v[at], r, self.metric)
            d[self.ids[at][:, None] == rid[None]] = 0
            sums = np.add.reduceat(d, start, axis=1)
            if goes_on:
                sums[:, 0] += self.sum[at]
            elif self.label is not None:
                self._close(at, np.array([self.label]), np.array([self.count]), self.sum[at][:, None])
            self._close(at, labels[:-1], counts[:-1], sums[:, :-1])
            self.sum[at] = sums[:, -1]
        self.label, self.count = labels[-1], int(counts[-1])

    def batches(self):
        if self.label is not None:
            self._close(slice(None), np.array([self.label]), np.array([self.count]), self.sum[:, None])
        for k in range(0, len(self.ids), 1 << 15):
            a, b = self.a[k : k + (1 << 15)], self.b[k : k + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[k : k + (1 << 15)]), pa.array(self.m[k : k + (1 << 15)]), pa.array(a, mask=np.isnan(a)), pa.array(b, mask=np.isinf(b))], names=["i", "m", "a", "b"])


def davies_bouldin(df: DataFrame, label: str, vec: str, noise: int = -1) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij, s being mean distances to the centroid."""
    rows = df.where(F.col(label) != noise).withColumn("label", F.col(label))
    c = centroids(rows, "label", vec)
    s = rows.join(c, "label").groupBy("label").agg(F.avg(euclidean(F.col(vec), F.col("centroid"))).alias("s"), F.first("centroid").alias("centroid"))
    s = materialize(s.withColumn("label", F.col("label").cast("bigint")), "davies-bouldin")

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        ids, v, query = block_arrays(table)
        spread = table.column("s").to_numpy()
        q, r = np.flatnonzero(query), np.flatnonzero(~query)
        w = np.full(len(q), -np.inf)
        for n, i in enumerate(q):
            d = exact_distances(v[r], v[i][None], "euclidean")
            other = (ids[r] != ids[i]) & (d > 0)
            w[n] = ((spread[i] + spread[r[other]]) / d[other]).max(initial=-np.inf)
        return pa.table({"i": ids[q], "w": w})

    worst = pair_blocks(s, "label", "centroid", ("s",)).groupBy("qb", "rb").applyInArrow(run, "i bigint, w double").where("w > double('-infinity')").groupBy("i").agg(F.max("w").alias("w"))
    return worst.agg(F.round(F.avg("w"), 6).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, label: str, vec: str, noise: int = -1) -> DataFrame:
    """[B / (k - 1)] / [W / (n - k)] from sums of squares by position; 1 where all rows lie on their centroids, null
    with one cluster or with no more rows than clusters."""
    x = df.where(F.col(label) != noise).select(F.col(label).alias("label"), F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    g = x.groupBy("label", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("w"))
    p = g.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("b"))
    t = p.agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.max("k").alias("k"), F.max("n").alias("n"))
    value = F.try_divide(F.try_divide("b", F.col("k") - 1), F.try_divide("w", F.col("n") - F.col("k")))
    defined = (F.col("k") > 1) & (F.col("n") > F.col("k"))
    return t.select(F.round(F.when(defined, F.when(F.col("w") == 0, 1.0).otherwise(value)), 4).alias("calinski_harabasz"))


def purity_entropy(df: DataFrame, label: str, value: str) -> DataFrame:
    """For each cluster: size, dominant value and its count, purity, entropy in bits, distinct values.

    Ties of the dominant value go to the first in order.
    """
    g = df.groupBy(F.col(label).alias("cluster_id"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster_id")
    g = g.withColumn("size", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "value")))
    p = F.col("n") / F.col("size")
    return g.groupBy("cluster_id").agg(F.max("size").alias("size"), F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("dominant"), F.max("n").alias("dominant_n"), F.round(F.max(p), 4).alias("purity"), F.round(-F.sum(p * F.log2(p)), 4).alias("entropy"), F.count("*").alias("distinct_values"))


def radius_variance(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean and greatest distance to the centroid, and population variance summed over positions."""
    c = centroids(df, label, vec).withColumnRenamed("label", "cluster_id")
    d = df.join(c, F.col(label) == F.col("cluster_id")).select("cluster_id", euclidean(F.col(vec), F.col("centroid")).alias("d"))
    d = d.groupBy("cluster_id").agg(F.round(F.avg("d"), 6).alias("mean_distance"), F.round(F.max("d"), 6).alias("radius"))
    v = df.select(F.col(label).alias("cluster_id"), F.posexplode(vec).alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return d.join(v.groupBy("cluster_id").agg(F.round(F.sum("v"), 6).alias("variance")), "cluster_id")


def conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Boundary edges over (2 * internal + boundary) of each cluster; 0 without edges.

    One join of edges and labels serves all clusters. ``labels`` has (id, label).
    """
    a, b = labels.toDF("src", "ls"), labels.toDF("dst", "ld")
    e = edges.select("src", "dst").join(a, "src").join(b, "dst")
    ends = e.select(F.explode(F.when(F.col("ls") == F.col("ld"), F.array(F.struct(F.col("ls").alias("c"), F.lit(1).alias("i"), F.lit(0).alias("o")))).otherwise(F.array(F.struct(F.col("ls").alias("c"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("ld").alias("c"), F.lit(0).alias("i"), F.lit(1).alias("o"))))).alias("x"))
    s = ends.groupBy(F.col("x.c").alias("label")).agg(F.sum("x.i").alias("internal"), F.sum("x.o").alias("boundary"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    out = sizes.join(s, "label", "left").select(F.col("label").alias("cluster_id"), "size", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("boundary", F.lit(0)).alias("boundary"))
    v = 2 * F.col("internal") + F.col("boundary")
    return out.withColumn("conductance", F.round(F.when((F.col("size") > 1) & (v > 0), F.col("boundary") / v).otherwise(0.0), 6))


def cluster_table(df: DataFrame, edges: DataFrame, id_col: str, label: str, vec: str, value: str) -> DataFrame:
    """All measures of all clusters, in one pass each, with no loop over clusters."""
    lab = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    out = purity_entropy(df, label, value).join(radius_variance(df, label, vec), "cluster_id")
    return out.join(conductance(edges, lab).drop("size"), "cluster_id")


def drill_down(df: DataFrame, label: str, cluster, id_col: str, vec: str, product: str) -> DataFrame:
    """Members of one cluster with their distance to its centroid, nearest first; none if it has no rows."""
    own = df.where(F.col(label) == cluster)
    c = centroids(own, label, vec).withColumnRenamed("label", "cluster_id")
    rows = own.join(F.broadcast(c), F.col(label) == F.col("cluster_id"))
    return rows.select(F.col(id_col).alias("member"), F.col(product).alias("product"), F.round(euclidean(F.col(vec), F.col("centroid")), 6).alias("distance"), hypothetical(F.col(product)).alias("hypothetical"))


def drill_summary(members: DataFrame) -> DataFrame:
    """Of a cluster's members (``drill_down``): size, mean and greatest distance, share of unknown products."""
    share = F.round(F.avg(F.col("hypothetical").cast("double")) * 100, 2)
    return members.agg(F.count("*").alias("members"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.max("distance"), 6).alias("max_distance"), F.coalesce(share, F.lit(0.0)).alias("percent_hypothetical"))


def product_shares(members: DataFrame) -> DataFrame:
    """The products of a cluster's members, the most frequent first, with their percentage."""
    g = members.groupBy("product").agg(F.count("*").alias("n"))
    total = members.agg(F.count("*").alias("members"))
    return g.join(F.broadcast(total)).select("product", "n", F.round(F.col("n") * 100 / F.col("members"), 2).alias("percent")).orderBy(F.desc("n"), "product")


def partition_quality(edges: DataFrame, labels: DataFrame, kind: str = "modularity", gamma: float = 1.0) -> DataFrame:
    """Quality of a given partition: CPM, modularity or Reichardt-Bornholdt with resolution ``gamma``."""
    a, b = labels.toDF("src", "ls"), labels.toDF("dst", "ld")
    e = edges.join(a, "src").join(b, "dst")
    inner = e.agg(F.sum(F.when(F.col("ls") == F.col("ld"), F.col("weight")).otherwise(0.0)).alias("e"), F.sum("weight").alias("m"))
    if kind == "cpm":
        n = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("x"))
        return inner.join(n).select(F.round(F.col("e") - gamma * F.col("x"), 6).alias("quality"))
    deg = e.select(F.explode(F.array(F.struct(F.col("ls").alias("c"), F.col("weight").alias("w")), F.struct(F.col("ld").alias("c"), F.col("weight").alias("w")))).alias("x"))
    k = deg.groupBy("x.c").agg(F.sum("x.w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("x"))
    q = F.col("e") - gamma * F.col("x") / (4 * F.col("m"))
    return inner.join(k).select(F.round(q / F.col("m") if kind == "modularity" else q, 6).alias("quality"))
