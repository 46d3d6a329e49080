"""Feature store: joins, deduplication, write modes and resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.functions.sequences import nonempty, strip

UNKNOWN = "Desconocido"
NOVEL = "Desconocido/Novel"


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the last in the given order, in which null comes first.

    Where the order is given by columns, the last one is found on the map side, before anything is shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    if rest and all(isinstance(c, str) for c in order):
        last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns])
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both; applying it twice changes nothing."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return last_wins(both, keys, ["_new"]).drop("_new")


def unified_features(base: DataFrame, spaces: Sequence[DataFrame], key: str, label: str) -> DataFrame:
    """Labelled rows that have a vector in every space. A space counts a key once, with its greatest
    row in the order of its columns, so that reruns agree."""
    out = base.where(nonempty(F.col(label)))
    for s in spaces:
        v = [c for c in s.columns if c != key]
        out = out.join(last_wins(s.dropna(subset=v), [key], v), key)
    return out


def with_annotation(vectors: DataFrame, notes: DataFrame, key: str, value: str, default: str = UNKNOWN) -> DataFrame:
    """Left join on trimmed keys; rows without a note get the default. The last note (by value) of a key counts."""
    n = notes.select(strip(F.col(key).cast("string")).alias("_k"), F.col(value)).groupBy("_k").agg(F.max(value).alias(value))
    v = vectors.withColumn("_k", strip(F.col(key).cast("string")))
    return v.join(n, "_k", "left").drop("_k").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(default)))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(key), key, "left_anti")


def lookup(base: DataFrame, table: DataFrame, key: str, value: str, default=-1) -> DataFrame:
    """Left lookup with a default; of several values of a key the greatest counts."""
    one = table.groupBy(key).agg(F.max(value).alias(value))
    return base.join(one, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def fallback_lookup(members: DataFrame, index: DataFrame, key: str, index_key: str, value: str, default: str = NOVEL) -> DataFrame:
    """By the exact key, else by the key up to its first dot, else the default."""
    one = index.groupBy(index_key).agg(F.max(value).alias("_exact"))
    two = index.groupBy(F.col(index_key).alias("_base")).agg(F.max(value).alias("_other"))
    out = members.join(one.withColumnRenamed(index_key, key), key, "left").withColumn("_base", F.substring_index(key, ".", 1)).join(two, "_base", "left")
    return out.withColumn(value, F.coalesce("_exact", "_other", F.lit(default))).drop("_exact", "_other", "_base")


def first_candidate(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first non-null of those columns that exist."""
    found = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


def write_resumable(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at ``path`` lacks; returns how many."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path)
        df = pending(df, done, key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    return n
