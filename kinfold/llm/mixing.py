"""Operator 8, mixing sources to target weights: capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.plans.tables import materialize, numbered

#: Rows of one source that share a cell of the seeded order, on average.
CELL_ROWS = 64
#: Cells of one source that are summed in order by one task.
STRIP = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs without space, tab, LF, VT, FF and CR; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def water_level(sources: DataFrame, total: float) -> float:
    """The level L with sum(least(cap, L * weight)) = total, by clamping and resharing.

    ``sources`` has ``weight`` and ``cap``. Every pass clamps the sources that the level
    puts above their cap and shares the rest by weight over the others, until none is
    above. One aggregate row a pass comes back to the driver.
    """
    level = None
    clamped = -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        r = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(over.cast("int")).alias("n")).first()
        if not r["free"]:
            return float("inf")
        if r["n"] == clamped:
            return level
        clamped, level = r["n"], max(0.0, total - r["held"]) / r["free"]


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(doc_id, source, size, source_size, target, epochs, taken)`` for each row, and ``keep``.

    Size is a text's number of words (null: 0). The sources in code-point order, null
    last and a source of its own, weigh ``weights``, repeating; together they get
    ``share`` times all words. Targets stop at ``max_epochs`` times a source's size and
    the excess is shared anew by weight until none is above.

    A source takes every document ``floor(target / size)`` times whole. The remainder
    is sampled: documents in the order of a hash of (seed, id) come once more, until
    the remainder is used up; the document on which it ends comes with the missing
    words only. So a source takes its target to the nearest word, and reruns agree.
    Empty tables give empty tables, empty sources a target of 0; rows that repeat an
    identifier and a size tie, and share what they get in any order.

    The order never meets in one task: a source's rows fall into cells of about
    ``CELL_ROWS`` by the hash, cells are summed in order within strips of ``STRIP``, and only
    strips within a source, so that a source with a third of all rows is no hot group. Other
    columns are not read, but for ``keep``.
    """
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("u"), *keep)
    rows = materialize(rows, "mix-rows")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = numbered(per, F.col("source").asc_nulls_last())  # there may be as many sources as web sites
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    per = materialize(per.select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")), "mix-sources")
    all_words = per.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(per, share * all_words)
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level)) if level != float("inf") else F.col("cap")
    words = F.round(target).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(words / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("bigint")
    per = per.select("source", "source_size", target.alias("target"), whole.alias("whole"), (words - whole * F.col("source_size")).alias("rest"), F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)).cast("bigint").alias("cells"))
    per = materialize(per, "mix-targets")
    same = lambda a, b: a.source.eqNullSafe(b.source)
    placed = rows.join(per, same(rows, per)).drop(per.source)
    placed = placed.withColumn("cell", F.floor(F.col("u") / F.lit(float(1 << 52)) * F.col("cells")).cast("bigint"))
    cells = placed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    cells = materialize(cells.withColumn("strip", F.floor(F.col("cell") / STRIP)), "mix-cells")
    ahead = lambda col, *by: F.coalesce(F.sum(col).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strips = cells.groupBy("source", "strip").agg(F.sum("cell_size").alias("strip_size"))
    strips = strips.select(F.col("source").alias("s"), F.col("strip").alias("t"), ahead("strip_size", "source", "strip").alias("ahead"))
    cells = cells.withColumn("before", ahead("cell_size", "source", "strip", "cell"))
    cells = cells.join(strips, cells.source.eqNullSafe(strips.s) & (cells.strip == strips.t))
    cells = materialize(cells.select("s", F.col("cell").alias("c"), (F.col("before") + F.col("ahead")).alias("before")), "mix-starts")
    within = Window.partitionBy("source", "cell").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = placed.join(cells, placed.source.eqNullSafe(cells.s) & (placed.cell == cells.c))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), "whole", extra.cast("bigint").alias("extra"), (F.col("whole") * F.col("size") + extra).cast("bigint").alias("taken"), *keep)
