"""Exact nearest neighbours in blocks, and graphs made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.functions.vectors import similarity
from kinfold.plans.tables import materialize

BLOCK = 2048


def exact_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of corresponding rows."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(-1))
    if metric == "manhattan":
        return np.abs(a - b).sum(-1)
    n = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    return np.where(n > 0, 1 - (a * b).sum(-1) / np.where(n > 0, n, 1), 1.0)


def fast_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks, by a matrix product where the metric allows."""
    if metric == "manhattan":
        return np.abs(a[:, None] - b[None]).sum(-1)
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return 1 - (a / np.where(na > 0, na, 1)[:, None]) @ (b / np.where(nb > 0, nb, 1)[:, None]).T
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def slack(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """For every row of ``a``, twice what rounding can make of a fast distance to a row of ``b``
    (of a squared one for the Euclidean metric)."""
    n = 8 * (a.shape[1] + 8) * np.finfo(float).eps
    if metric == "cosine":
        return np.full(len(a), n)
    if metric == "manhattan":
        return n * (np.abs(a).sum(1) + np.abs(b).sum(1).max())
    return n * ((a * a).sum(1) + (b * b).sum(1).max())


def pair_blocks(df: DataFrame, id_col: str, vec_col: str, extra: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Every row once as a query and once as a reference in each pair of blocks (qb, rb)."""
    n = max(1, -(-df.count() // block))
    own = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"), *extra, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    q = base.select(F.col("own").alias("qb"), F.col("other").alias("rb"), F.lit(True).alias("query"), "id", "v", *extra)
    r = base.select(F.col("other").alias("qb"), F.col("own").alias("rb"), F.lit(False).alias("query"), "id", "v", *extra)
    return q.unionByName(r)


def block_arrays(table: pa.Table):
    ids = table.column("id").to_numpy()
    v = np.array(table.column("v").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
    return ids, v, table.column("query").to_numpy(zero_copy_only=False)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(src, dst, d, rank): the k nearest of what all blocks found."""
    w = Window.partitionBy("src").orderBy(F.round("d", 12), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Groups of queries, each of which sees all references in one task; the most queries of a group; numbers in a packed row (1 MB).
GROUPS, MOST_QUERIES, PACKED = 24, 1 << 16, 1 << 17


def packed(rows: DataFrame, groups: int, most: int = PACKED) -> DataFrame:
    """(part, query, ids, v, lists, place) of rows (id, v[, list]): vectors packed into few rows, each query in the one of ``groups`` parts
    that its identifier falls into, and each reference in all of them. ``place`` keeps the order of the partitions and of their rows."""

    def run(batches):
        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            v = np.array(b.column(1).flatten().to_numpy()).reshape(len(ids), -1)
            own = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(groups)
            step, lists = max(1, min(PACKED // max(1, v.shape[1]), most)), b.column(2).to_numpy() if b.num_columns > 2 else np.zeros(len(ids), np.int64)
            out = [(int(p), np.flatnonzero(own == p)) for p in np.unique(own)] + [(-1, np.arange(a, min(a + step, len(ids)))) for a in range(0, len(ids), step)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([ids[i].tobytes() for _, i in out]), pa.array([v[i].tobytes() for _, i in out]), pa.array([lists[i].tobytes() for _, i in out]), pa.array(range(place, place + len(out)))], names=["part", "ids", "v", "lists", "place"])
            place += len(out)

    rows = rows.mapInArrow(run, "part int, ids binary, v binary, lists binary, place bigint")
    query = F.col("part") >= 0
    part = F.when(query, F.array("part")).otherwise(F.sequence(F.lit(0), F.lit(groups - 1)))
    return rows.select(F.explode(part).alias("part"), query.alias("query"), "ids", "v", "lists", "place")


class Nearest:
    """The ``k`` nearest of the references seen so far, for each query of a group.

    A block of references is compared by a matrix product; what rounding or a tie may put among the k nearest is ranked
    by exact distances, ties by identifiers.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, metric: str, include_self: bool):
        self.ids, self.v, self.k, self.metric, self.include_self = ids, v, k, metric, include_self
        self.n, self.d, self.near = np.zeros(len(ids), int), np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)

    def _most(self, kth: np.ndarray, wide: np.ndarray) -> np.ndarray:
        tie = 2e-12  # distances that are equal after rounding
        return (np.sqrt(kth * kth + wide) + tie) ** 2 if self.metric == "euclidean" else kth + wide + tie

    def see(self, rid: np.ndarray, r: np.ndarray) -> None:
        each = len(rid) * (r.shape[1] if self.metric == "manhattan" else 1)
        step = max(1, (1 << 21) // each)
        for a in range(0, len(self.ids), step):
            self._see(slice(a, min(a + step, len(self.ids))), rid, r)

    def see_some(self, which: np.ndarray, asked: np.ndarray, rid: np.ndarray, r: np.ndarray) -> None:
        """The same for the queries ``which``, each of which meets the references that it has ``asked`` for."""
        step = max(1, (1 << 21) // (len(rid) * (r.shape[1] if self.metric == "manhattan" else 1)))
        for a in range(0, len(which), step):
            w = which[a : a + step]
            some = Nearest(self.ids[w], self.v[w], self.k, self.metric, self.include_self)
            some.n, some.d, some.near = self.n[w], self.d[w], self.near[w]
            some._see(slice(0, len(w)), rid, r, asked[a : a + step])
            self.n[w], self.d[w], self.near[w] = some.n, some.d, some.near

    def _see(self, at: slice, rid: np.ndarray, r: np.ndarray, asked: np.ndarray | None = None) -> None:
        ids, q, full = self.ids[at], self.v[at], self.n[at] == self.k
        wide = slack(q, r, self.metric)
        if self.metric == "euclidean":  # squared
            d = q @ (-2 * r).T
            d += (r * r).sum(1)[None]
            d += (q * q).sum(1)[:, None]
        else:
            d = fast_distances(q, r, self.metric)
        if asked is not None:
            d[~asked] = np.inf
        most = self._most(np.where(full, self.d[at, -1], np.inf), wide)
        if not full.all() and self.k < len(rid):
            if not self.include_self:
                d[ids[:, None] == rid[None]] = np.inf
            kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
            most = np.fmin(most, self._most(np.sqrt(np.maximum(kth, 0)) if self.metric == "euclidean" else kth, wide))
        close = ~(d > most[:, None])
        i, j = np.nonzero(close if asked is None else close & asked)
        if not self.include_self:
            other = ids[i] != rid[j]
            i, j = i[other], j[other]
        if not len(i):
            return
        step = max(1, (1 << 21) // max(1, r.shape[1]))
        e = np.concatenate([exact_distances(r[j[a : a + step]], q[i[a : a + step]], self.metric) for a in range(0, len(i), step)])
        touched = np.unique(i)
        n, d, near = self.n[at], self.d[at], self.near[at]  # views
        had = np.arange(self.k)[None] < n[touched][:, None]
        i = np.concatenate([np.repeat(touched, self.k)[had.ravel()], i])
        e, to = np.concatenate([d[touched][had], e]), np.concatenate([near[touched][had], rid[j]])
        order = np.lexsort((to, np.round(e, 12), i))
        i, e, to = i[order], e[order], to[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < self.k
        d[i[best], rank[best]], near[i[best], rank[best]] = e[best], to[best]
        n[touched] = np.minimum(np.bincount(i, minlength=len(n))[touched], self.k)

    def batches(self):
        for a in range(0, len(self.ids), 4096):
            n = self.n[a : a + 4096]
            had = np.arange(self.k)[None] < n[:, None]
            rank = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32)[None], had.shape)[had]
            cols = np.repeat(self.ids[a : a + 4096], n), self.near[a : a + 4096][had], self.d[a : a + 4096][had], rank
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["src", "dst", "d", "rank"])


def query_groups(n: int) -> int:
    return max(min(GROUPS, -(-n // 256)), -(-n // MOST_QUERIES), 1)


def knn(df: DataFrame, id_col: str, vec_col: str, k: int, metric: str = "euclidean", include_self: bool = False, drop_zero: bool = False) -> DataFrame:
    """Rows (src, dst, d, rank): the k nearest rows of every row; ties go to the smaller identifier.

    Queries are dealt to GROUPS tasks (more where one would hold above MOST_QUERIES), and all references stream past each of them in packed
    blocks, so that a row is shuffled GROUPS + 1 times however large the table is, and only k rows a query leave. ``drop_zero`` leaves out
    those of the k that are duplicates at distance zero. All pairs are compared: for large tables there is ``approximate_knn``.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    groups = query_groups(df.count())

    def run(batches):
        queries, found = [], None
        for b in batches:
            for query, ids, v in zip(*(b.column(c).to_pylist() for c in ("query", "ids", "v"))):
                ids = np.frombuffer(ids, np.int64)
                v = np.frombuffer(v, float).reshape(len(ids), -1)
                if query:
                    if found:  # the next group of this task
                        yield from found.batches()
                        queries, found = [], None
                    queries.append((ids, v))
                elif queries:
                    found = found or Nearest(*(np.concatenate(x) for x in zip(*queries)), k, metric, include_self)
                    found.see(ids, v)
        if found:
            yield from found.batches()

    dealt = packed(rows, groups).repartitionById(groups, F.col("part")).sortWithinPartitions("part", F.desc("query"))
    # a graph reads the neighbours more than once, and they are not to be looked for again
    out = materialize(dealt.mapInArrow(run, "src bigint, dst bigint, d double, rank int"), "knn-neighbours")
    return out.where("d > 0") if drop_zero else out


def undirected(edges: DataFrame, weight: str | Column | None = None) -> DataFrame:
    """Simple undirected edges (src < dst, weight): loops go, repeats keep the greatest weight."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("weight"))
    return e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs that are neighbours of each other."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.where("src < dst").select("src", "dst").join(back, ["src", "dst"])


def knn_graph(df: DataFrame, id_col: str, vec_col: str, k: int = 15, metric: str = "euclidean", weighted: bool = True, drop_zero: bool = False) -> DataFrame:
    """Undirected neighbour graph, weighted by 1 / (1 + d)."""
    return undirected(knn(df, id_col, vec_col, k, metric, drop_zero=drop_zero), similarity(F.col("d")) if weighted else None)


#: Neighbour graphs as the reference's scripts parametrise them.
PRESETS = {
    "reduced": dict(k=15, metric="euclidean", weighted=True, drop_zero=True),
    "fused": dict(k=15, metric="cosine", weighted=False),
    "raw": dict(k=14, metric="euclidean", weighted=True),
    "plots": dict(k=14, metric="euclidean", weighted=False),
}
