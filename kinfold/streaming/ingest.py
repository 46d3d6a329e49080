"""Incremental ingestion: new files are upserted once, whatever is run again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from kinfold.operators.features import last_wins, upsert


class VersionedTable:
    """A Parquet table as numbered versions: readers see a whole version, and a batch that is
    replayed writes the same number again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if n.startswith("v"))

    def read(self, before: int | None = None) -> DataFrame | None:
        v = [x for x in self._versions() if before is None or x < before]
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}") if v else None

    def write(self, df: DataFrame, version: int, keep: int = 3) -> None:
        """Write a version and remove all but the last ``keep``, which readers may still hold."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        jvm = self.spark.sparkContext._jvm
        for old in self._versions()[:-keep]:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> VersionedTable:
    """Upsert the files that have come to ``source`` since the last call; the last row of a key wins."""
    table = VersionedTable(spark, target)

    def batch(df: DataFrame, number: int) -> None:
        new = last_wins(df, keys, list(order))
        old = table.read(before=number)
        table.write(new if old is None else upsert(old, new, keys), number)

    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return table


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows with a watermark, for streams and tables alike."""
    from pyspark.sql import functions as F

    w = events.withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(F.window(ts, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")
