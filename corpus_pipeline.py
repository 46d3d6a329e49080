"""The corpus pipeline: five stages from raw documents to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm.bpe import bpe_digests
from kinfold.llm.exact_dedup import patricia_owners
from kinfold.llm.mixing import mix_sources
from kinfold.llm.near_texts import near_firsts
from kinfold.llm.quality_mil import filter_quality, fit_quality
from kinfold.llm.queries import remainder, tokenizer_spec
from kinfold.plans.tables import discard, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, whole rows, repeats alike; an empty table stays empty."""
    return filter_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), remainder(3) != 1))


def _one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each pair ``(doc_id, sha)`` of identifier and text digest in ``kept``.

    Of rows that share both, the first in the order of all columns stays; maps have no order.
    """
    key = [F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("key_null")]
    ordered = [c for c, kind in docs.dtypes if "map<" not in kind]
    first = F.min(F.struct(*docs.columns)) if len(ordered) == len(docs.columns) else F.min_by(F.struct(*docs.columns), F.struct(*ordered))
    rows = docs.groupBy(*key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(first.alias("row"))
    return rows.join(kept.select(*key, "sha").distinct(), ["key_id", "key_null", "sha"], "left_semi").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest identifier (null below all others).

    Rows go by identifier and text, so that a row never takes others of its identifier with
    it; of repeats of a whole row one stays.
    """
    return _one_of_each(docs, patricia_owners(docs, largest=True).where("kept").select("doc_id", F.col("text_sha256").alias("sha")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles of Jaccard similarity 0.8), one row with the smallest
    identifier (null last).

    Rows go by identifier and text, as in ``exact_dedup``.
    """
    return _one_of_each(docs, near_firsts(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A document on which a source's share ends comes with its first words up to there,
    joined by spaces. Decisions go by identifier and text; repeats of both share the least one.
    """
    mark = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    plan = mix_sources(docs.select("doc_id", "text", "source", mark.alias("_mix_sha")), keep=("_mix_sha",))
    plan = plan.groupBy(F.col("doc_id").alias("_mix_id"), "_mix_sha").agg(*(F.min(c).alias(f"_mix_{c}") for c in ("whole", "extra", "size")))
    joined = docs.withColumn("_mix_of", mark).join(plan, F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_of") == F.col("_mix_sha")))
    whole, extra, words = F.col("_mix_whole"), F.col("_mix_extra"), F.col("_mix_words")
    rest = F.when(extra > 0, F.array(F.when(extra < F.col("_mix_size"), extra))).otherwise(F.array().cast("array<bigint>"))
    copies = joined.withColumn("_mix_words", F.explode(F.concat(F.array_repeat(F.lit(None).cast("bigint"), whole.cast("int")), rest)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), F.lit(1), words.cast("int")), " ")
    copies = copies.withColumn("text", F.when(words.isNotNull(), cut).otherwise(F.col("text")))
    return copies.withColumn("n_chars", F.when(words.isNotNull(), F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the tokens and of the text decoded from them, for each row alone."""
    return bpe_digests(docs, tokenizer_spec())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: Training a classifier, hashing by XXH64 and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        old, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(old)
    return STAGES[-1][1](spark, docs, sf_dir)
