"""A curated release of sequence records, with the reasons why records are left out and a report on each group.

    python -m jobs.curate_release --records IN --families IN --out OUT [--config jobs/curate_release.json]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs.common import command_line, log, settings
from kinfold.functions.sequences import nonempty
from kinfold.operators.curation import curate
from kinfold.operators.features import lookup
from kinfold.sources.formats import fasta_lines

#: ``low`` and ``high`` bound a sequence's length; ``annotation`` must not be empty; the report has a row for each ``group``.
DEFAULTS = {"low": 30, "high": 1175, "group": "lang", "annotation": "source"}
RECORDS = "doc_id bigint, text string, lang string, source string, n_clean int, keep_id bigint, family int, status string"


def _judged(docs: DataFrame, low: int, high: int, annotation: str) -> DataFrame:
    """Every record with its cleaned length and digest, and what rules it out by itself."""
    blank = r"[\x20\x09-\x0D]+"
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), blank, " "))
    rows = docs.withColumn("_clean", clean).withColumn("n_clean", F.length("_clean"))
    annotated = nonempty(F.trim(F.col(annotation)))
    why = (
        F.when(F.col("doc_id").isNull(), "unnamed").when(F.col("n_clean") == 0, "empty").when(~annotated, "unannotated")
        .when(F.col("n_clean") < low, "short").when(F.col("n_clean") > high, "long")
    )
    return rows.withColumn("why", why).withColumn("digest", F.sha2("_clean", 256)).drop("_clean")


def _report(records: DataFrame, group: str) -> DataFrame:
    """Counts before and after, the part removed, and quartiles of the kept lengths, for each group."""
    kept = F.col("status") == "kept"
    at = lambda p: F.percentile(F.when(kept, F.col("n_clean")), F.lit(p))
    n, m = F.count("*"), F.count_if(kept)
    return records.groupBy(group).agg(
        n.alias("original"), m.alias("curated"), F.count_if(F.col("status") == "copy").alias("copies"), F.round((n - m) * 100.0 / n, 2).alias("percent_removed"),
        at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"), F.max(F.when(kept, F.col("n_clean"))).alias("longest"),
    )


def run(spark: SparkSession, records: str, families: str, out: str, config: dict | None = None) -> DataFrame:
    """Curate the records at ``records`` into ``out`` and return the written records.

    A record is ``kept`` if it has an identifier, a sequence whose length without surplus white space is within bounds,
    and an annotation, and is the one of least identifier among equal sequences that pass; others are written too, with
    what rules them out first: unnamed, empty, unannotated, short, long, copy. ``keep_id`` names the kept one of equal sequences, or a record that is ruled out itself;
    ``family`` comes from the labels at ``families`` (-1 without one). ``out/records`` is Parquet in a partition for each
    status, so that readers of the release open only what is kept; ``out/fasta`` has the kept sequences as the clustering tools read
    them; ``out/report`` is JSON with a row for each group.

    All are replaced whole, so a rerun gives the same, also after a failure. Equal sequences meet in a partial minimum, and in a join of two
    plain exchanges, so thousands of copies are no hot group. Rows that repeat an identifier are judged one by one.
    """
    s = settings(config, DEFAULTS)
    docs = spark.read.parquet(records).select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(families).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("family"))
    rows = _judged(docs, s["low"], s["high"], s["annotation"])
    firsts = curate(rows.where("why is null"), "n_clean", s["low"], s["high"]).groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    rows = rows.join(firsts, "digest", "left").withColumn("keep_id", F.when(F.col("why").isNull(), F.col("keep_id")).otherwise(F.col("doc_id")))
    status = F.coalesce("why", F.when(F.col("doc_id") == F.col("keep_id"), "kept").otherwise("copy"))
    rows = lookup(rows, labels, "doc_id", "family").withColumn("status", status)
    rows.select([c.split()[0] for c in RECORDS.split(", ")]).write.mode("overwrite").partitionBy("status").parquet(f"{out}/records")
    written = spark.read.schema(RECORDS).parquet(f"{out}/records")
    fasta_lines(written.where("status = 'kept'"), "doc_id", "text").write.mode("overwrite").text(f"{out}/fasta")
    _report(written, s["group"]).coalesce(1).write.mode("overwrite").json(f"{out}/report")
    counts = {r["status"]: r["count"] for r in written.groupBy("status").count().collect()}  # seven statuses at most
    log.info("curate_release: read %d records of %s, wrote %s to %s", sum(counts.values()), records, dict(sorted(counts.items())), out)
    return written


if __name__ == "__main__":
    command_line("curate_release", {"records": "Parquet of records", "families": "Parquet of family labels", "out": "folder of the release"}, run)
