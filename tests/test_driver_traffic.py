"""Rounds of layouts and communities send no table of vertices to the driver."""

import pytest
import kinfold.operators.embedding as em
import kinfold.operators.leiden as ld


@pytest.mark.parametrize("module", [em, ld])
def test_rounds_broadcast_nothing(spark, monkeypatch, module):
    plans = []
    monkeypatch.setattr(module, "materialize", lambda df, name="table", f=module.materialize: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or f(df, name))
    d = spark.range(120).selectExpr("id", "array(cast(id % 7 as double), cast(id % 11 as double), cast(id as double)) as vec")
    em.umap(d, "id", "vec", 2, 5, block=40, rounds=2, epochs=4)
    seen = {"umap-places"} if module is em else {"leiden-across", "leiden-cells", "leiden-dealt"}
    assert seen <= {n for n, _ in plans} and not [n for n, p in plans if n in seen and "Broadcast" in p]
