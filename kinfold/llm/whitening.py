"""Operator 12, embedding whitening: an exact integer scatter matrix, decomposed in double precision."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm.arrow import schema_of, spark_ddl
from kinfold.plans.tables import materialize

SCALE, SHIFT = 1024, 100_000
#: Bits of a limb: sums of that many bits over up to 2^23 partitions fit a long.
LIMB = 40
#: The driver holds one matrix of this many dimensions, squared.
MOST_DIMS = 4096

_PARTS = [("i", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())]
_ROWS = [("vec_id", pa.int64()), ("deviation", pa.string()), ("w", pa.list_(pa.float64()))]


@dataclass
class Whitening:
    """What a fit found: exact sums, and the leading components of the covariance."""

    n: int
    sums: list[int]  # of x, exact
    shift: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, in columns
    trace: float


def usable(vec: Column, dims: int | None = None) -> Column:
    """Whether a vector is there with finite entries only, and of the fit's dimension."""
    ok = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ok = vec.isNotNull() & F.coalesce(ok, F.lit(False))
    return ok if dims is None else ok & (F.size(vec) == dims)


def integers(entries: np.ndarray, dims: int) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry as long, or as Python's integers where a long is too small."""
    x = np.floor(SCALE * entries.reshape(-1, dims))
    if not x.size or np.abs(x).max() < 2.0**61:
        return x.astype(np.int64) + SHIFT
    return np.array([[int(c) + SHIFT for c in row] for row in x], object)


def shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x less the shift, as long where that is safe."""
    if x.dtype != object and all(abs(s) < 1 << 61 for s in shift):
        return x - np.array(shift, np.int64)
    return x.astype(object) - np.array(shift, object)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y in Python's integers; blocks are small enough that no sum within one is rounded or overflows."""
    d = y.shape[1]
    most = max(1, int(np.abs(y).max())) if y.size else 1
    total = np.zeros((d, d), object)
    if y.dtype != object and (rows := (1 << 53) // (most * most)) >= 64:
        for a in range(0, len(y), min(rows, 1 << 16)):
            b = y[a : a + min(rows, 1 << 16)].astype(float)
            total += (b.T @ b).astype(np.int64).astype(object)
    elif y.dtype != object and (rows := (1 << 62) // (most * most)) >= 1:
        for a in range(0, len(y), min(rows, 1 << 16)):
            b = y[a : a + min(rows, 1 << 16)]
            total += (b.T @ b).astype(object)
    else:
        y = y.astype(object)
        for row in y:
            total += np.outer(row, row)
    return total


def limbs(value: int) -> list[int]:
    """A value in base 2^40, every limb with its sign."""
    out, sign, value = [], -1 if value < 0 else 1, abs(value)
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _entries(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float)


def fit_whitening(df: DataFrame, vec_col: str = "embedding", components: int | None = None) -> Whitening | None:
    """Fit on all usable vectors; None where there is none or all are equal.

    The entries become long integers (``integers``). A shift, one vector of the table, is
    subtracted; sums and cross-products are accumulated without bound, as limbs whose
    sums Spark adds up; n Q - S S^T is formed exactly and only then divided by n^2 in double precision and decomposed.
    The result doesn't depend on the shift. Vectors of another dimension than the most frequent one (of several, the
    larger) are left out, here and in ``whiten``. The driver gets one matrix of ``dims``^2 entries, whatever the number of
    rows, and refuses more than ``MOST_DIMS``. Components are those with an eigenvalue above rounding.
    """
    spark = df.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    good = df.select(vec.alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    top = good.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.any_value("v").alias("v")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not top:
        return None
    dims = top[0]["dims"]
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions; the driver decomposes at most {MOST_DIMS}")
    shift = [int(c) for c in integers(np.array(top[0]["v"], float), dims)[0]]

    def run(batches):
        n, total, sums = 0, np.zeros((dims, dims), object), np.zeros(dims, object)
        for b in batches:
            y = shifted(integers(_entries(b, 0), dims), shift)
            n += len(y)
            total = total + exact_products(y)
            for a in range(0, len(y), 1 << 12):
                part = y[a : a + (1 << 12)]
                small = part.dtype != object and (not part.size or int(np.abs(part).max()) < 1 << 50)
                sums = sums + (part.sum(0) if small else part.astype(object).sum(0)).astype(object)
        rows = [(i, j, k, v) for i in range(dims) for j in range(i, dims) for k, v in enumerate(limbs(int(total[i, j])))]
        rows += [(i, -1, k, v) for i in range(dims) for k, v in enumerate(limbs(int(sums[i])))] + [(-1, -1, 0, n)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PARTS)], schema=schema_of(_PARTS))

    found = good.where(F.size("v") == dims).mapInArrow(run, spark_ddl(_PARTS)).groupBy("i", "j", "limb").agg(F.sum("v").alias("v"))
    products, sums, n = np.zeros((dims, dims), object), np.zeros(dims, object), 0
    for i, j, k, v in (tuple(r) for r in found.collect()):  # dims^2 entries of a few limbs
        if i < 0:
            n = v
        elif j < 0:
            sums[i] += v << LIMB * k
        else:
            products[i, j] += v << LIMB * k
            if i != j:
                products[j, i] += v << LIMB * k
    exact = n * products - np.outer(sums, sums)
    cov = np.array([[int(v) / (n * n) for v in row] for row in exact])
    trace = float(Fraction(sum(int(exact[i, i]) for i in range(dims)), n * n))
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > dims * np.finfo(float).eps * max(values[0], 0)).sum())
    if not rank:
        return None
    keep = min(rank, components or rank)
    total = [int(s) + n * c for s, c in zip(sums, shift)]
    return Whitening(n, total, shift, values[:keep].copy(), vectors[:, :keep].copy(), trace)


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows ``(vec_id, deviation, w)`` of the usable vectors of the fit's dimension.

    ``w`` holds the centred vector projected on each component, over the root of its eigenvalue;
    ``deviation``, the exact sum over dimensions of (n x - S)^2, is a decimal text, for it may exceed any number type.
    Null and repeated identifiers pass through, other columns are not read.
    """
    n, dims = model.n, len(model.sums)
    sums = [s - n * c for s, c in zip(model.sums, model.shift)]
    mean = np.array([s / n for s in sums])
    to = model.vectors / np.sqrt(model.values)

    def run(batches):
        constant = sum(s * s for s in sums)
        for b in batches:
            y = shifted(integers(_entries(b, 1), dims), model.shift)
            most = max(1, int(np.abs(y).max())) if y.size else 1
            small = y.dtype != object and most * most * dims < 1 << 62 and most * max(map(abs, sums)) * dims < 1 << 62
            z = y if small else y.astype(object)
            squares, cross = (z * z).sum(1), (z * np.array(sums, z.dtype)).sum(1)
            deviation = [str(n * n * int(a) - 2 * n * int(c) + constant) for a, c in zip(squares, cross)]
            w = (y.astype(float) - mean) @ to
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.string()), flat], schema=schema_of(_ROWS))

    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(usable(F.col("v"), dims)).mapInArrow(run, spark_ddl(_ROWS))


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``w``, centred anew, minus the identity."""
    w = [F.get("w", F.lit(k)) for k in range(components)]
    means = whitened.agg(*(F.avg(c) for c in w)).first()
    centred = [c - F.lit(m) for c, m in zip(w, means)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = whitened.agg(*(F.avg(centred[i] * centred[j]) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whitened_components(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows ``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)``.

    One row for each usable vector and each of up to ``components`` components, by falling eigenvalue from
    1; the sign of a component is the same in all rows. ``deviation`` is null where a long can't hold it, ``deviation_exact``
    has it as text. An empty table, one without usable vectors, and one whose vectors are all equal give no
    rows; see ``fit_whitening`` and ``whiten`` for other cases.
    """
    model = fit_whitening(df, vec_col, components)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = materialize(whiten(df, model, id_col, vec_col), "whitened")
    k = len(model.values)
    error = identity_error(rows, k)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    out = rows.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.col("deviation").alias("deviation_exact"), F.posexplode("w").alias("i", "whitened"))
    return out.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )
