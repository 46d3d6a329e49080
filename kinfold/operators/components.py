"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.plans.tables import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows ``(id, component)`` for every endpoint; a component is its smallest id.

    Each round contracts: every vertex points at the least neighbour, pointers jump to
    their roots, and the edges are rewritten between roots. The edges left shrink at
    least by half, so the rounds are logarithmic. Hubs meet partial aggregates
    (``min``) or joins whose two sides are plain exchanges, which the adaptive planner
    splits. Null endpoints are left out; loops give a component of one.
    """
    e = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct(), "cc-edges")
    both = lambda x: x.select("a", "b").union(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both(e).groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("p")).select("id", "p"), "cc-labels")
    while True:
        # pointers lead to smaller ids only, so that they form a forest; jump to the roots
        while True:
            parent = labels.select(F.col("id").alias("p"), F.col("p").alias("g"))
            old, labels = labels, materialize(labels.join(parent, "p").select("id", F.col("g").alias("p"), (F.col("p") != F.col("g")).alias("moved")), "cc-labels")
            discard(old)
            if not labels.where("moved").limit(1).count():
                break
        la, lb = labels.select(F.col("id").alias("a"), F.col("p").alias("ra")), labels.select(F.col("id").alias("b"), F.col("p").alias("rb"))
        old, e = e, materialize(e.join(la, "a").join(lb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "cc-edges")
        discard(old)
        if not e.limit(1).count():
            return labels.select("id", F.col("p").alias("component"))
        hooks = materialize(both(e).groupBy(F.col("a").alias("p")).agg(F.least("a", F.min("b")).alias("h")).select("p", "h"), "cc-hooks")
        old, labels = labels, materialize(labels.join(hooks, "p", "left").select("id", F.coalesce("h", "p").alias("p")), "cc-labels")
        discard(old, hooks)
