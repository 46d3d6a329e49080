"""Materialised intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a local one, but on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


#: Whether Spark removes a statement's shuffle files at its end, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: How many writes are under way in the driver's threads, and what the setting was before the first of them.
_lock, _writes = threading.Lock(), {"n": 0, "before": None}


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return a frame over the written files.

    Cuts lineage and keeps the rows in the shared store, so that a lost executor costs
    a retried task and not a recomputation. Later plans see real sizes. The shuffle files of
    the write go with its end; ``discard`` removes the written files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"
    with _lock:
        if not _writes["n"]:
            _writes["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writes["n"] += 1
    try:
        df.write.parquet(path)
    finally:
        with _lock:
            _writes["n"] -= 1
            if not _writes["n"]:
                spark.conf.set(CLEANUP, _writes["before"]) if _writes["before"] else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of materialised frames that nothing lazy reads any more."""
    for df in frames:
        path = getattr(df, "written_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number``, the position of each row from 0 in the order, which must be total.

    Rows are dealt by ranges of the order and numbered within each; only one count a
    range is summed in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = dealt.withColumn("number", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    out = within.join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")  # one row a shuffle partition
    return out.withColumn("number", (F.col("number") + F.col("_before")).cast("bigint")).drop("_range", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
