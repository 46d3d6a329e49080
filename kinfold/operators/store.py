"""How results are kept: write modes, layout, memoised results, and tables that grow cluster by cluster."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from kinfold.plans.tables import discard, materialize, shared_dir


def replace(df: DataFrame, path: str) -> DataFrame:
    """Overwrite the table at ``path`` with ``df``, which may read it.

    The new table is written whole beside the old one, which gives way in two renamings; should a run end between them, the
    old table lies at ``path``-old and the new one at ``path``-new.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}-new")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at, new, old = hadoop(path), hadoop(f"{path}-new"), hadoop(f"{path}-old")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old) or not fs.rename(new, at):
        raise OSError(f"can't replace {path}")
    fs.delete(old, True)
    return spark.read.parquet(path)


def append(df: DataFrame, path: str, replacing: bool = False) -> DataFrame:
    """Add rows to the table at ``path``: a rerun repeats them, unless ``replacing`` it."""
    df.write.mode("overwrite" if replacing else "append").parquet(path)
    return df.sparkSession.read.parquet(path)


def laid_out(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The table ordered by ``keys`` over its files, so that a look-up by them skips files and row groups by their extremes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _mark(df: DataFrame, key: str) -> Column:
    """What a key is ordered by: numbers themselves, texts by a hash."""
    return F.xxhash64(key) if dict(df.dtypes)[key] == "string" else F.col(key)


def _position(value: Column, cuts: list) -> Column:
    """How many of a few hundred cuts lie below a value; null comes first."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)), F.lit(0)) if cuts else F.lit(0)


def indexed(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None) -> DataFrame:
    """Write ``df`` at ``path`` for look-ups by any of ``keys``, with an index of its files at ``path``-index.

    Rows are ordered by interleaved bits of the keys' positions, so that a file covers a narrow range of every key and not of the
    first alone; positions are those among quantiles of a sample. The index has each file's extremes of every key.
    """
    spark = df.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = []
    for k in keys:
        value = _mark(df, k)
        cuts = df.where(F.col(k).isNotNull()).agg(F.percentile_approx(value, [i / 256 for i in range(1, 256)], 10_000)).first()[0] or []
        place.append(_position(value, sorted(set(cuts))))
    z = F.lit(0).cast("bigint")
    for b in range(8):
        for i, p in enumerate(place):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(p, b).bitwiseAND(F.lit(1)).cast("bigint"), b * len(keys) + i))
    df.withColumn("_z", z).repartitionByRange(n, "_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    marks = [f(_mark(df, k)).alias(f"{w}_{k}") for k in keys for w, f in (("low", F.min), ("high", F.max))]
    stored = spark.read.parquet(path)
    stored.groupBy(name).agg(*marks).write.mode("overwrite").parquet(f"{path}-index")
    return stored


def find(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of an indexed table whose ``key`` is ``value``, from the files that may hold it; others are not opened."""
    index = spark.read.parquet(f"{path}-index")
    mark = F.xxhash64(F.lit(value)) if isinstance(value, str) else F.lit(value)
    files = [r["file"] for r in index.where((F.col(f"low_{key}") <= mark) & (F.col(f"high_{key}") >= mark)).select("file").collect()]
    schema = spark.read.parquet(path).schema
    found = spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in files]) if files else spark.createDataFrame([], schema)
    return found.where(F.col(key) == value)


def save_partition(labels: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The labels and edges of a partition as tables below ``path``."""
    return append(labels, f"{path}/labels", replacing=True), append(edges, f"{path}/edges", replacing=True)


def _read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """A table, or None where there is none that can be read to its end."""
    try:
        found = (spark.read.schema(schema) if schema else spark.read).parquet(path)
        found.write.format("noop").mode("overwrite").save()
        return found
    except Exception as e:  # noqa: BLE001
        if not any(k in str(e) for k in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE", "FAILED_READ_FILE", "is not a Parquet file")):
            raise
        return None


def memoized(spark: SparkSession, name: str, params: dict, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """The result of ``build()``, kept under a hash of its name and parameters: computed once, then read."""
    key = hashlib.sha256(json.dumps([name, params], sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{root or shared_dir(spark) + '/kinfold/memo'}/{name}-{key}"
    found = _read(spark, path)
    return found if found is not None else append(build(), path, replacing=True)


def resumable_clusters(clusters: DataFrame, key: str, measure: Callable[[DataFrame], DataFrame], path: str, run_id: str, every: int = 100) -> DataFrame:
    """``measure`` of all clusters, ``every`` at a time, each part kept at once; a rerun goes on where the last one ended.

    ``measure`` takes a frame of cluster keys and returns one row for each. Rows carry the
    ``run_id``, so that those of another clustering don't count as done. A table that can't be
    read is begun anew.
    """
    spark, ids = clusters.sparkSession, materialize(clusters.select(key).distinct(), "cluster-ids")
    done = _read(spark, path)
    if done is None:
        append(measure(ids.limit(0)).withColumn("run_id", F.lit(run_id)), path, replacing=True)
    while True:
        done = spark.read.parquet(path).where(F.col("run_id") == run_id)
        part = materialize(ids.join(done.select(key), key, "left_anti").orderBy(key).limit(every), "cluster-part")
        if not part.limit(1).count():
            return done
        append(measure(part).withColumn("run_id", F.lit(run_id)), path)
        discard(part)
