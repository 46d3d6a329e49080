"""Incremental k-mer vectors: new files of records are vectorised once, whatever is run again.

    python -m jobs.kmer_ingest --records IN --out OUT --checkpoint DIR [--config jobs/kmer_ingest.json]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from jobs.common import command_line, log, settings
from kinfold.operators.features import last_wins, pending
from kinfold.operators.kmers import kmer_vectors
from kinfold.plans.tables import discard, materialize

#: ``ks``: the lengths of k-mers. ``files_per_batch``: how many files a batch takes at most; null takes all that are new.
DEFAULTS = {"ks": [5], "files_per_batch": None}
VECTORS = "doc_id bigint, length int, n_distinct bigint, n_kmers bigint, vector string, batch bigint, k int"


def run(spark: SparkSession, records: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Vectorise the records of the files that have come to ``records`` since the last run; return the whole table.

    A file stream with a checkpoint takes new files only, and ends when it has them all. A sequence is what
    letters A to Z a text has, in upper case. Of rows that share an identifier within a batch the one with the greatest text counts;
    identifiers that earlier batches have vectorised are left alone, as a resumed run of the original does; rows without
    an identifier are left out. A sequence shorter than k has an empty vector.

    ``out`` is Parquet in partitions of batch and k. A batch that is replayed after a failure replaces its own partitions and
    doesn't look at them, so nothing is written twice. The work is in proportion to what is new, but for the
    identifiers of earlier batches, a narrow column.
    """
    s = settings(config, DEFAULTS)
    names = [c.split()[0] for c in VECTORS.split(", ")]
    spark.createDataFrame([], VECTORS).write.mode("append").partitionBy("batch", "k").parquet(out)

    def take(batch: DataFrame, number: int) -> None:
        seen = Observation()
        rows = batch.observe(seen, F.count("*").alias("n")).where("doc_id is not null")
        rows = rows.select("doc_id", "text", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("seq"))
        done = spark.read.schema(VECTORS).parquet(out).where(F.col("batch") != number)
        new = materialize(pending(last_wins(rows, ["doc_id"], ["text"]).select("doc_id", "seq"), done, "doc_id"), "kmer-ingest")
        vectors = kmer_vectors(new, "doc_id", "seq", s["ks"]).withColumnRenamed("id", "doc_id").withColumn("batch", F.lit(number).cast("bigint")).select(names)
        vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "k").parquet(out)
        log.info("kmer_ingest: batch %d read %d rows of %s, wrote %d new records to %s", number, seen.get["n"], records, new.count(), out)
        discard(new)

    stream = spark.readStream.schema(spark.read.parquet(records).select("doc_id", "text").schema)
    if s["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", s["files_per_batch"])
    q = stream.parquet(records).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(VECTORS).parquet(out)


if __name__ == "__main__":
    command_line("kmer_ingest", {"records": "folder or glob of Parquet files", "out": "folder of the vectors", "checkpoint": "folder of the stream's state"}, run)
