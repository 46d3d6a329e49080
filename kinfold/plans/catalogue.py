"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.plans import q_drivers, q_families, q_tables  # noqa: F401
from kinfold.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour graph, then purity, entropy, spread and conductance of every family."""
    return q_families.cluster_table(spark, sf_dir)
