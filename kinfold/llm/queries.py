"""The queries of the operators in this folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm.bpe import bpe_digests
from kinfold.llm.exact_dedup import patricia_owners
from kinfold.llm.language_id import fit_filters, identify_languages
from kinfold.llm.line_dedup import dedup_lines
from kinfold.llm.mixing import mix_sources
from kinfold.llm.packing import pack_documents
from kinfold.llm.pii import pseudonymize
from kinfold.llm.quality_mil import fit_quality, score_quality
from kinfold.llm.quality_rules import ledger, passes
from kinfold.llm.simhash import simhash_components
from kinfold.llm.substring_dedup import remove_repeats
from kinfold.llm.whitening import whitened_components
from kinfold.plans.tables import table


def remainder(modulus: int):
    """crc32 of an identifier's decimal text, modulo ``modulus``: the fold it belongs to."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def tokenizer_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_languages(docs, fit_filters(docs, remainder(5) != 0))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_grams")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_spec())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return score_quality(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    base = ~passes(F.col("failures"), "base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes(F.col("failures"), "v2").alias("kept"), "failures")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a run that matters sets a key of its own
    return pseudonymize(table(spark, sf_dir, "documents"), spark.conf.get("spark.kinfold.pii.key", "no secret"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia_owners(table(spark, sf_dir, "documents"), largest=True)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_spec())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_quality, op4_simhash, op5_line_dedup, op6_quality_rules, op7_pii, op8_mixing, op9_exact_dedup, op10_substring_dedup, op11_packing, op12_whitening)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_mixing": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
                 CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS u FROM documents),
        s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
        s AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
                 source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s0),
        lv AS (SELECT 0 AS i, max(total) / sum(w) AS level FROM s
               UNION ALL
               SELECT i + 1, (SELECT (max(total) - sum(CASE WHEN w * lv.level >= cap THEN cap ELSE 0 END)) / nullif(sum(CASE WHEN w * lv.level >= cap THEN 0 ELSE w END), 0) FROM s)
               FROM lv WHERE i < 1000 AND level IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE i < (SELECT count(*) FROM s))),
        fin AS (SELECT level FROM lv WHERE level IS NOT NULL ORDER BY i DESC LIMIT 1),
        t AS (SELECT source, source_size, n, least(cap, w * level) AS target FROM s, fin),
        e AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(round(target) / source_size), 2) ELSE 0 END AS BIGINT) AS whole,
                 CAST(greatest(ceil(n / 64.0), 1) AS BIGINT) AS cells FROM t),
        p AS (SELECT d.*, source_size, target, whole, CAST(round(target) AS BIGINT) - whole * source_size AS rest, floor(u / 4503599627370496.0 * cells) AS cell
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
        q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY cell, u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
        SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM q""",
    "op6_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, row_number() OVER () AS r FROM documents),
        win AS (SELECT r, i, list_slice(ws, i, i + 7) AS w FROM d, unnest(range(1, len(ws) - 6)) AS x(i)),
        rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win) WHERE c > 1),
        cov AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM rep, range(0, 8) AS y(o) GROUP BY r),
        lines AS (SELECT r, l, count(*) AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r, l),
        dup AS (SELECT r, CAST(sum(c - 1) AS BIGINT) AS n_dup_lines, CAST(sum(c) AS BIGINT) AS n_lines FROM lines GROUP BY r),
        m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
                length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
              FROM d LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
        f AS (SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > word_chars AS BIGINT)
                + 8 * CAST(n_dup_lines > 3 AND 100 * n_dup_lines > 40 * n_lines AS BIGINT) + 16 * CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS BIGINT)
                + 32 * CAST(100 * n_upper > 50 * word_chars AS BIGINT) + 64 * CAST(10 * n_exclaims > 3 * n_words AND n_exclaims > 10 AS BIGINT) AS failures FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f""",
    "op10_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws, row_number() OVER () AS r FROM documents),
        win AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS w FROM d, unnest(range(1, len(ws) - 48)) AS x(i)),
        hit AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY w) AS lo FROM win) WHERE lo < doc_id),
        gone AS (SELECT DISTINCT r, i + o AS p FROM hit, range(0, 50) AS y(o)),
        words AS (SELECT r, p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) AS x(p)),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
}
