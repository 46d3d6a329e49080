"""Vector expressions over array columns; arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; a zero vector is at distance 1 from everything."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(1.0)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def fuse(*spaces: Column) -> Column:
    """Early fusion: every space at unit length, then concatenated."""
    return F.concat(*[l2_normalize(v) for v in spaces])


def similarity(distance: Column) -> Column:
    """1 / (1 + d)."""
    return 1 / (1 + distance)


def map_to_vector(m: Column) -> Column:
    """Values of a map in the order of its keys, numeric keys by value before the others."""
    entries = F.map_entries(m)
    keyed = F.transform(entries, lambda e: F.struct(e["key"].try_cast("bigint").isNull().alias("word"), e["key"].try_cast("bigint").alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.transform(F.array_sort(keyed), lambda e: e["v"].cast("double"))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Masked mean of token vectors: sum(h * m) / max(sum(m), 1e-9), by position."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(1e-9))
    width = F.size(F.element_at(hidden, 1))
    zero = F.array_repeat(F.lit(0.0), width)
    rows = F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m.cast("double")))
    return F.transform(F.aggregate(rows, zero, lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b)), lambda x: x / weight)
