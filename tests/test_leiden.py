"""Communities in blocks against the sequential loop over the whole graph."""

import random

import pytest

from kinfold.operators.leiden import communities, leiden
from kinfold.operators.metrics import partition_quality

EDGE = "src bigint, dst bigint, weight double"


def planted(n, sizes, inner, outer, seed):
    """A graph whose communities have sizes drawn from ``sizes``."""
    r, of = random.Random(seed), []
    while len(of) < n:
        of += [len(set(of))] * r.choice(sizes)
    of = of[:n]
    by = {}
    for i, c in enumerate(of):
        by.setdefault(c, []).append(i)
    edges = {}
    for i in range(n):
        for _ in range(inner):
            j = r.choice(by[of[i]])
            if i != j:
                edges[min(i, j), max(i, j)] = round(r.uniform(0.4, 1), 3)
        for _ in range(outer):
            j = r.randrange(n)
            if i != j:
                edges[min(i, j), max(i, j)] = round(r.uniform(0.1, 0.5), 3)
    return [(a, b, w) for (a, b), w in sorted(edges.items())]


def quality(spark, edges, labels, kind, gamma):
    return partition_quality(edges, labels, kind, gamma).first()["quality"]


@pytest.mark.parametrize("kind,gamma", [("cpm", 0.05), ("modularity", 1.0), ("rb", 0.5)])
def test_quality_of_blocks(spark, kind, gamma):
    block = 120
    rows = planted(500, (8, 15, 30), 4, 1, 3)
    edges = spark.createDataFrame(rows, EDGE)
    vertices = spark.range(500)
    got = leiden(edges, vertices, kind, gamma, block=block)
    assert got.count() == got.select("id").distinct().count() == 500
    whole = communities(500, rows, kind, gamma)
    want = quality(spark, edges, spark.createDataFrame(list(enumerate(whole)), "id bigint, label int"), kind, gamma)
    assert quality(spark, edges, got, kind, gamma) >= want - 0.02 * abs(want)


def test_labels_by_size_and_reruns(spark):
    cliques = [(o + i, o + j, 1.0) for o, n in ((0, 4), (10, 7), (20, 7)) for j in range(n) for i in range(j)]
    edges = spark.createDataFrame([*cliques, (3, 10, 0.1), (5, 5, 2.0), (None, 1, 1.0), (1, 0, 0.5)], EDGE)
    vertices = spark.createDataFrame([(i,) for i in [*range(4), 5, *range(10, 17), *range(20, 27), 99, 99]], "id bigint")
    for block in (5, 10_000):
        got = {r["id"]: r["label"] for r in leiden(edges, vertices, "modularity", block=block).collect()}
        assert got == {**dict.fromkeys(range(10, 17), 0), **dict.fromkeys(range(20, 27), 1), **dict.fromkeys(range(4), 2), 5: 3, 99: 4}
        assert got == {r["id"]: r["label"] for r in leiden(edges.repartition(3), vertices, "modularity", block=block).collect()}


def test_no_edges(spark):
    assert sorted(tuple(r) for r in leiden(spark.createDataFrame([], EDGE), spark.range(3)).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert leiden(spark.createDataFrame([], EDGE), spark.range(0)).count() == 0


def test_a_community_larger_than_a_block(spark):
    r = random.Random(1)
    rows = sorted({(min(a, b), max(a, b), 1.0) for a in range(120) for b in (r.randrange(120) for _ in range(8)) if a != b})
    edges = spark.createDataFrame(rows, EDGE)
    got = leiden(edges, spark.range(120), "cpm", 0.005, block=30)
    assert got.select("label").distinct().count() == 1
