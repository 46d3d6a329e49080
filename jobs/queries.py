"""The jobs as queries: each runs twice into a folder of its own, and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import curate_release, kmer_ingest
from kinfold.plans.tables import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"


def job1_curate_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet", _folder(spark, "release")
    curate_release.run(spark, *args)
    return curate_release.run(spark, *args)


def job2_kmer_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, for a stream takes no single file
    at = _folder(spark, "vectors")
    args = f"{sf_dir}/documents*.parquet", f"{at}/vectors", f"{at}/checkpoint"
    kmer_ingest.run(spark, *args)
    return kmer_ingest.run(spark, *args)


QUERIES = {f.__name__: f for f in (job1_curate_release, job2_kmer_ingest)}

ORACLE_SQL = {
    "job1_curate_release": r"""
        WITH c AS (SELECT doc_id, text, lang, source, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS clean FROM documents),
        w AS (SELECT *, CAST(length(clean) AS INT) AS n_clean, CASE WHEN doc_id IS NULL THEN 'unnamed' WHEN clean = '' THEN 'empty' WHEN coalesce(trim(source), '') = '' THEN 'unannotated'
                WHEN length(clean) < 30 THEN 'short' WHEN length(clean) > 1175 THEN 'long' END AS why FROM c),
        f AS (SELECT clean, min(doc_id) AS keep_id FROM w WHERE why IS NULL GROUP BY 1),
        l AS (SELECT vec_id, max(label) AS family FROM embeddings GROUP BY 1)
        SELECT doc_id, text, lang, source, n_clean, CASE WHEN why IS NULL THEN keep_id ELSE doc_id END AS keep_id, CAST(coalesce(family, -1) AS INT) AS family,
               coalesce(why, CASE WHEN doc_id = keep_id THEN 'kept' ELSE 'copy' END) AS status
        FROM w LEFT JOIN f USING (clean) LEFT JOIN l ON vec_id = doc_id""",
    "job2_kmer_ingest": """
        WITH d AS (SELECT doc_id, upper(regexp_replace(coalesce(max(text), ''), '[^A-Za-z]', '', 'g')) AS seq FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
        c AS (SELECT doc_id, substr(seq, i, 5) AS kmer, count(*) AS n FROM d, unnest(range(1, length(seq) - 3)) AS x(i) GROUP BY 1, 2),
        v AS (SELECT doc_id, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_kmers, string_agg(kmer || ':' || n, ' ' ORDER BY kmer) AS vector FROM c GROUP BY 1)
        SELECT doc_id, CAST(length(seq) AS INT) AS length, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_kmers, 0) AS n_kmers, coalesce(vector, '') AS vector,
               CAST(0 AS BIGINT) AS batch, CAST(5 AS INT) AS k FROM d LEFT JOIN v USING (doc_id)""",
}
