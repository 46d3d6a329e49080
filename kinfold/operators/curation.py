"""Curation and exploratory profiles of sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def curate(df: DataFrame, length: str, low: int = 30, high: int = 1175) -> DataFrame:
    """Rows whose length lies in [low, high]."""
    return df.where(F.col(length).between(low, high))


def removal_report(df: DataFrame, length: str, low: int = 30, high: int = 1175) -> DataFrame:
    """Counts before and after curation, and the percentage removed (0 for an empty table)."""
    kept = F.count_if(F.col(length).between(low, high))
    n = F.count("*")
    return df.agg(n.alias("original"), kept.alias("curated"), (n - kept).alias("removed"), F.round(F.when(n > 0, (n - kept) * 100.0 / n).otherwise(0.0), 2).alias("percent_removed"))


def group_counts(df: DataFrame, key: str | Column) -> DataFrame:
    """Rows of each value; null is a value of its own."""
    return df.groupBy(F.col(key).alias("key") if isinstance(key, str) else key.alias("key")).agg(F.count("*").alias("n"))


def top_k(df: DataFrame, key: str | Column, k: int) -> DataFrame:
    """The k most frequent values; ties go to the smaller value."""
    return group_counts(df, key).orderBy(F.desc("n"), F.asc_nulls_last("key")).limit(k)


def shares_of_top(df: DataFrame, key: str | Column, k: int = 10) -> DataFrame:
    """The top values with their part of what the top values make up together."""
    top = top_k(df, key, k)
    return top.select("key", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles."""
    q = lambda p: F.percentile(col, F.lit(p))
    return df.agg(F.count(col).alias("n"), F.round(F.avg(col), 6).alias("mean"), F.round(F.stddev_samp(col), 6).alias("std"), F.min(col).alias("min"), F.round(q(0.25), 6).alias("q25"), F.round(q(0.5), 6).alias("q50"), F.round(q(0.75), 6).alias("q75"), F.max(col).alias("max"))


def quantile(df: DataFrame, col: str, p: float = 0.95) -> DataFrame:
    return df.agg(F.round(F.percentile(col, F.lit(p)), 6).alias("quantile"))


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, which falls into the last one."""
    span = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.where(F.col(col).isNotNull()).join(F.broadcast(span)).groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def clipped_histogram(df: DataFrame, col: str, bins: int = 100, p: float = 0.95) -> DataFrame:
    """The bins that a figure shows whose axis ends at a quantile: (bin, n, start), counted over all rows."""
    q = quantile(df, col, p).select(F.col("quantile").alias("most"))
    span = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    start = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    shown = histogram(df, col, bins).join(F.broadcast(span.join(q))).withColumn("start", F.round(start, 6))  # one row
    return shown.where("start <= most").select("bin", "n", "start")


def kernel_density(df: DataFrame, col: str, points: int = 50) -> DataFrame:
    """Gaussian density with Scott's bandwidth, from the bins of a fine histogram."""
    stats = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"), F.stddev_samp(col).alias("sd"), F.count(col).alias("m"))
    bins = histogram(df, col, 400)
    grid = stats.select("lo", "hi", "sd", "m", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    mid = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 0.5) / 400
    h = F.col("sd") * F.pow(F.col("m"), F.lit(-0.2))
    z = (x - mid) / h
    k = F.exp(-z * z / 2) / (h * F.sqrt(F.lit(2 * 3.141592653589793)))
    return grid.join(F.broadcast(bins)).groupBy("i").agg(F.round(F.sum(F.col("n") * k / F.col("m")), 9).alias("density"), F.round(F.first(x), 6).alias("x"))


def boxplot(df: DataFrame, col: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and outliers."""
    q = df.agg(F.percentile(col, F.lit(0.25)).alias("q1"), F.percentile(col, F.lit(0.5)).alias("q2"), F.percentile(col, F.lit(0.75)).alias("q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(col).between(low, high)
    r = df.join(F.broadcast(q)).agg(F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("q3").alias("q3"), F.min(F.when(inside, F.col(col))).alias("whisker_low"), F.max(F.when(inside, F.col(col))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    return r.select(*[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")], "whisker_low", "whisker_high", "outliers")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A fixed-size sample that reruns repeat: the rows of least keyed hash."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
