"""A graph that a task can hold is one block, without rounds of joins."""

from pyspark.sql import functions as F

from kinfold.operators import leiden as le


def test_no_rounds_of_joins(spark, monkeypatch):
    monkeypatch.setattr(le, "near_blocks", lambda *a: 1 / 0)
    v = spark.range(12_000)  # rings of six
    e = v.select(F.col("id").alias("src"), F.when(F.col("id") % 6 == 5, F.col("id") - 5).otherwise(F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    out = le.leiden(e, v, "modularity", 1.0, passes=1)
    assert out.count() == 12_000
    assert out.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct(F.expr("id div 6")).alias("rings")).where("n = 6 and rings = 1").count() == 2_000
