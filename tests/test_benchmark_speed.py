"""Spaces are scored beside each other, and the decomposition's small side is the smaller one."""

import threading

import numpy as np
from pyspark.sql import functions as F

from kinfold.operators import drivers as dr, embedding as em
from kinfold.plans.tables import CLEANUP


def test_runs_of_spaces_overlap(spark):
    d = spark.range(40).select("id", F.lit("a").alias("truth"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vec"))
    meet = threading.Barrier(2, timeout=60)

    def runs(df, metric):
        meet.wait()  # breaks where one space waits for the other
        yield "parity", df.select("id", (F.col("id") % 2).cast("int").alias("label")), df

    before = spark.conf.get(CLEANUP, None)
    bad = lambda: (_ for _ in ()).throw(ValueError("no table"))
    out = dr.benchmark(spark, {"x": (lambda: (d, 2), "cosine"), "no": (bad, "cosine"), "y": (lambda: (d, 2), "cosine")}, runs).collect()
    assert [(r["strategy"], r["clusters"]) for r in out] == [("x", 2), ("no", None), ("y", 2)] and "no table" in out[1]["error"]
    assert spark.conf.get(CLEANUP, None) == before


def test_few_rows_are_the_small_side(spark, monkeypatch):
    A = np.random.default_rng(2).standard_normal((30, 500)) * (1.5 ** -np.arange(30))[:, None]
    cells = spark.createDataFrame([(3 * i, j, float(A[i, j])) for i in range(30) for j in range(500)], "id bigint, col bigint, freq double")
    sent, context = [], type(spark.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda self, x, g=context.broadcast: sent.append(np.shape(x)) or g(self, x))
    got = {x["id"]: x["vector"] for x in em.truncated_svd(cells, 4, rounds=30).collect()}
    assert sent and max(s[0] for s in sent) == 30  # and not the 500 columns
    U, S, _ = np.linalg.svd(A, full_matrices=False)
    assert np.allclose(np.abs([got[3 * i] for i in range(30)]), np.abs(U[:, :4] * S[:4]), atol=1e-6)
    wide = em.truncated_svd(cells.where("id < 9"), 5).collect()  # fewer rows than vectors
    assert sorted(x["id"] for x in wide) == [0, 3, 6] and all(len(x["vector"]) == 5 and x["vector"][3:] == [0.0, 0.0] for x in wide)
