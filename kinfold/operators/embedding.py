"""Projections: landmark distances, truncated SVD, UMAP; and providers of sequence embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.functions.sequences import mask_rare_residues, padded_hamming
from kinfold.functions.vectors import l2_normalize
from kinfold.operators.curation import sample_rows
from kinfold.operators.ivf import approximate_knn
from kinfold.operators.leiden import near_blocks, unsent
from kinfold.plans.tables import discard, materialize


def landmarks(df: DataFrame, id_col: str, seq_col: str, n: int) -> DataFrame:
    """The first n rows by identifier (all, if there are fewer)."""
    return df.orderBy(id_col).limit(n).select(F.col(id_col).alias("landmark"), F.col(seq_col).alias("landmark_seq"))


def landmark_distances(df: DataFrame, marks: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """(id, landmark, d): padded Hamming distance of every sequence to a bounded set of landmarks."""
    rows = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"))
    return rows.join(F.broadcast(marks)).select("id", "landmark", padded_hamming(F.col("seq"), F.col("landmark_seq")).alias("d"))


def _letters(seqs: list[str]) -> np.ndarray:
    """Code points, a row a sequence, in the least type that holds them; positions past an end differ from letters and equal each other."""
    points = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in seqs]
    most = max((int(x.max(initial=0)) for x in points), default=0)
    out = np.zeros((len(points), max((len(x) for x in points), default=0)), np.min_scalar_type(most))
    for i, x in enumerate(points):
        out[i, : len(x)] = x
    return out


#: Rows that are compared with one sequence at a time.
HAMMING_ROWS = 512


def _hamming_counts(a: list[str], b: list[str]) -> np.ndarray:
    """Positions in which the sequences of two lists differ, in the least type that holds a length."""
    own, other = _letters(a), _letters(b)
    wide = -(-max(own.shape[1], other.shape[1], 1) // 64) * 64  # whole words of the bits of a comparison
    kind = np.promote_types(own.dtype, other.dtype)
    own, other = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))).astype(kind, copy=False) for x in (own, other))
    out = np.zeros((len(a), len(b)), np.min_scalar_type(wide))
    for i in range(0, len(a), HAMMING_ROWS):
        some = own[i : i + HAMMING_ROWS]
        for j, m in enumerate(other):
            out[i : i + HAMMING_ROWS, j] = np.bitwise_count(np.packbits(some != m, axis=1).view(np.uint64)).sum(axis=1)
    return out


def _hamming_block(a: list[str], b: list[str]) -> np.ndarray:
    """Padded Hamming distances of two lists, by code points."""
    la, lb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    return _hamming_counts(a, b) / np.maximum(np.maximum(la[:, None], lb[None]), 1)


#: Rows of the landmarks' matrices that the fit holds at a time; columns and steps of the Krylov space of a large matrix's vectors.
FIT_ROWS, KRYLOV, STEPS = 256, 64, 24


def _leading(n: int, times: Callable[[np.ndarray], np.ndarray], d: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``d`` greatest eigenvalues and their vectors of a symmetric matrix known by its products.

    Exact where the Krylov space would be as large as the matrix.
    """
    if n <= KRYLOV * STEPS:
        w, v = np.linalg.eigh(times(np.eye(n)))
    else:
        Q = np.zeros((n, KRYLOV * STEPS))
        AQ = np.zeros_like(Q)
        x = np.random.default_rng(seed).standard_normal((n, KRYLOV))
        for a in range(0, Q.shape[1], KRYLOV):
            for _ in range(2):
                x = np.linalg.qr(x - Q[:, :a] @ (Q[:, :a].T @ x))[0]
            Q[:, a : a + KRYLOV] = x
            AQ[:, a : a + KRYLOV] = x = times(x)
        w, u = np.linalg.eigh(Q.T @ AQ)
        v = Q @ u[:, -d:]
        w = w[-d:]
    top = np.argsort(w)[::-1][:d]
    return w[top], v[:, top]


def mds_basis(marks: list[str], d: int, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """Pseudo-inverse of the landmarks' coordinates: classical scaling, then SMACOF rounds.

    Of the landmarks' distances only the counts of differing positions are kept whole; all else is made for FIT_ROWS rows at a time.
    """
    n = len(marks)
    counts, size = _hamming_counts(marks, marks), np.array([len(s) for s in marks])
    spans = [slice(a, min(a + FIT_ROWS, n)) for a in range(0, n, FIT_ROWS)]

    def distances(s: slice) -> np.ndarray:
        return counts[s] / np.maximum(np.maximum(size[s, None], size[None]), 1)

    mean = np.concatenate([(distances(s) ** 2).mean(axis=1) for s in spans])

    def times(x: np.ndarray) -> np.ndarray:
        """The squares of the distances, centred in rows and columns, times ``x``."""
        x = x - x.mean(axis=0)
        y = np.concatenate([(distances(s) ** 2 - mean[s, None]) @ x for s in spans])
        return -0.5 * (y - y.mean(axis=0))

    w, v = _leading(n, times, min(d, n), seed)
    X = v * np.sqrt(np.maximum(w, 0))
    last = np.inf

    def moved(X: np.ndarray) -> tuple[float, np.ndarray]:
        """The stress of coordinates, and where a round moves them."""
        square, stress, out = (X * X).sum(1), 0.0, np.empty_like(X)
        for s in spans:
            own = np.arange(s.start, s.stop)
            E = np.sqrt(np.maximum(square[s, None] + square[None] - 2 * X[s] @ X.T, 0))
            E[own - s.start, own] = 0
            D = distances(s)
            stress += ((E - D) ** 2).sum() / 2
            near = E <= 1e-12
            E[near] = 1
            D /= E
            D[near] = 0
            out[s] = (D.sum(1)[:, None] * X[s] - D @ X) / n
        return stress, out

    for _ in range(rounds):
        stress, to = moved(X)
        if last - stress < 1e-6 * max(last, 1e-12):
            break
        last, X = stress, to
    if X.shape[1] < d:
        X = np.pad(X, ((0, 0), (0, d - X.shape[1])))
    return np.linalg.pinv(X)


#: Rows whose distances to the landmarks a task holds at a time.
MDS_ROWS = 256


def landmark_mds(df: DataFrame, id_col: str, seq_col: str, n_landmarks: int = 5000, d: int = 50) -> DataFrame:
    """(id, vector, dimensions): distances to landmarks, centred by row, times the basis.

    The landmarks are a parameter-bounded set, fitted on the driver and broadcast.
    """
    marks = [r["landmark_seq"] for r in landmarks(df, id_col, seq_col, n_landmarks).collect()]
    basis = df.sparkSession.sparkContext.broadcast((marks, mds_basis(marks, d).T if marks else np.zeros((0, d))))

    def run(batches):
        own, P = basis.value
        for b in batches:
            seqs, Y = [s or "" for s in b.column(1).to_pylist()], np.zeros((b.num_rows, d if own else 0), np.float32)
            for a in range(0, len(seqs) if own else 0, MDS_ROWS):  # distances to all landmarks of a few rows at a time
                D = _hamming_block(seqs[a : a + MDS_ROWS], own)
                Y[a : a + MDS_ROWS] = (D - D.mean(axis=1, keepdims=True)) @ P
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(Y), pa.list_(pa.float32())), pa.array([d] * b.num_rows, pa.int32())], names=["id", "vector", "dimensions"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(seq_col)).mapInArrow(run, "id bigint, vector array<float>, dimensions int")


#: Tasks that multiply the sparse rows, each of which returns a sum as large as the small side; cells of a packed row, of a step, and columns of a block of sums.
SVD_TASKS, SVD_CELLS, SVD_STEP, SVD_COLUMNS = 24, 1 << 18, 1 << 14, 1 << 12


def packed_rows(cells: DataFrame, columns: np.ndarray) -> DataFrame:
    """(ids, size, at, freq) of cells (id, col, freq): sparse rows packed as binaries, each row whole in one of them.

    ``size`` has the number of cells of each row, ``at`` the place of each cell's column among the sorted ``columns``.
    """
    shared = cells.sparkSession.sparkContext.broadcast(columns)

    def pack(ids: np.ndarray, at: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        size = np.diff(np.r_[start, len(ids)])
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (ids[start], size.astype(np.int64), at.astype(np.int32), freq)], names=["ids", "size", "at", "freq"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list = []  # cells whose last row may go on
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), np.searchsorted(shared.value, b.column(1).to_numpy()), b.column(2).to_numpy()))
            if sum(len(x[0]) for x in held) < SVD_CELLS:
                continue
            ids, at, freq = (np.concatenate(x) for x in zip(*held))
            end = int(np.searchsorted(ids, ids[-1]))
            if end:
                yield pack(ids[:end], at[:end], freq[:end])
            held = [(ids[end:], at[end:], freq[end:])]
        if held:
            yield pack(*(np.concatenate(x) for x in zip(*held)))

    rows = cells.select(F.col("id").cast("bigint").alias("id"), F.col("col").cast("bigint").alias("col"), F.col("freq").cast("double").alias("freq"))
    rows = rows.where("id is not null and col is not null").repartition("id").sortWithinPartitions("id")
    out = materialize(rows.mapInArrow(run, "ids binary, size binary, at binary, freq binary"), "svd-rows")
    shared.destroy()
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]):
    """(ids, first cell of each row, cells' columns, frequencies) of each packed row."""
    for b in batches:
        for i in range(b.num_rows):
            ids, size, at, freq = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in zip(("ids", "size", "at", "freq"), (np.int64, np.int64, np.int32, float)))
            yield ids, np.r_[0, np.cumsum(size)], at, freq


def _added_up(key: np.ndarray, freq: np.ndarray, other: np.ndarray, M: np.ndarray, out: np.ndarray) -> None:
    """``out[key] += freq * M[other]`` over cells in the order of ``key``, a step of them at a time."""
    for a in range(0, len(key), SVD_STEP):
        k = key[a : a + SVD_STEP]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        x = M[other[a : a + SVD_STEP]]
        x *= freq[a : a + SVD_STEP, None]
        out[k[start]] += np.add.reduceat(x, start, axis=0)


def orthonormal(G: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """``G`` with its columns made orthonormal in place, by decompositions of blocks of rows and one of their small factors."""
    parts = np.array_split(G, max(1, len(G) // max(step, G.shape[1])))  # views
    small = []
    for x in parts:
        x[:], r = np.linalg.qr(x)
        small.append(r)
    q = np.linalg.qr(np.concatenate(small))[0]
    for i, x in enumerate(parts):
        x[:] = x @ q[i * G.shape[1] : (i + 1) * G.shape[1]]
    return G


def truncated_svd(cells: DataFrame, k: int = 50, rounds: int = 4, seed: int = 42) -> DataFrame:
    """(id, vector): U*S of a sparse matrix in long form (id, col, freq), by randomised subspace iteration.

    Cells are written once. Where rows are fewer than columns, columns change places with them: the smaller of the two is the small side, packed rows are of the
    other one. They are multiplied by at most SVD_TASKS tasks, which return sums in blocks of the small side. That side (times k) is once on the
    driver and twice in a task, so the columns are to be bounded (``bounded_columns``); what is broadcast goes at the end of each pass.
    """
    spark = cells.sparkSession
    cells = cells.select(F.col("id").cast("bigint").alias("id"), F.col("col").cast("bigint").alias("col"), F.col("freq").cast("double").alias("freq"))
    cells = written = materialize(cells.where("id is not null and col is not null"), "svd-cells")
    n, m = (cells.select(x).distinct().count() for x in ("id", "col"))
    turned = n < m
    if turned:
        cells = cells.select(F.col("col").alias("id"), F.col("id").alias("col"), "freq")
    columns = np.sort(cells.select("col").distinct().toArrow().column("col").to_numpy())
    sc, c, rank = spark.sparkContext, len(columns), min(k, m)
    width = min(c, rank + 8)
    packed = packed_rows(cells, columns)
    by_row = packed.coalesce(SVD_TASKS)

    def products(shared) -> DataFrame:
        """Rows (first, sums) of A'AM, one row a column of A, in blocks; M is broadcast."""

        def run(batches: Iterator[pa.RecordBatch]):
            B = shared.value
            G = np.zeros(B.shape)
            for ids, first, at, freq in _unpacked(batches):
                row = np.repeat(np.arange(len(ids)), np.diff(first))
                Y = np.zeros((len(ids), B.shape[1]))
                _added_up(row, freq, at, B, Y)
                order = np.argsort(at, kind="stable")
                _added_up(at[order], freq[order], row[order], Y, G)
            for a in range(0, len(G), SVD_COLUMNS):
                some = G[a : a + SVD_COLUMNS]
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([some.tobytes()])], names=["first", "sums"])

        def add(key, table):
            total = sum(np.frombuffer(x.as_py(), float) for x in table.column("sums"))
            return pa.table({"first": pa.array([key[0].as_py()]), "sums": pa.array([total.tobytes()])})

        return by_row.mapInArrow(run, "first bigint, sums binary").groupBy("first").applyInArrow(add, "first bigint, sums binary")

    def gram_times(M: np.ndarray) -> np.ndarray:
        """A'AM."""
        shared = sc.broadcast(M)
        parts = products(shared).toArrow()
        shared.destroy()
        out = np.zeros((c, M.shape[1]))
        for first, sums in zip(parts.column("first").to_pylist(), parts.column("sums")):
            x = np.frombuffer(sums.as_buffer(), float).reshape(-1, M.shape[1])
            out[first : first + len(x)] = x
        return out

    def columns_of(M: np.ndarray) -> DataFrame:
        """(id, vector) of A'AM: what belongs to the columns, zeros after it up to the rank."""
        shared, names = sc.broadcast(M), sc.broadcast(columns)

        def run(batches: Iterator[pa.RecordBatch]):
            wide = shared.value.shape[1]
            for b in batches:
                for first, sums in zip(b.column(0).to_pylist(), b.column(1)):
                    x = np.frombuffer(sums.as_buffer(), float).reshape(-1, wide)
                    x = np.pad(x, ((0, 0), (0, rank - wide)))
                    vector = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * rank, pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(names.value[first : first + len(x)]), vector], names=["id", "vector"])

        out = materialize(products(shared).mapInArrow(run, "id bigint, vector array<double>"), "svd-vectors")
        shared.destroy()
        names.destroy()
        return out

    def rows_times(M: np.ndarray) -> DataFrame:
        shared = sc.broadcast(M)

        def run(batches: Iterator[pa.RecordBatch]):
            B = shared.value
            for ids, first, at, freq in _unpacked(batches):
                Y = np.zeros((len(ids), B.shape[1]))
                _added_up(np.repeat(np.arange(len(ids)), np.diff(first)), freq, at, B, Y)
                for a in range(0, len(ids), 1 << 12):
                    some = Y[a : a + (1 << 12)]
                    vector = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * B.shape[1], pa.int32()), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + (1 << 12)]), vector], names=["id", "vector"])

        out = materialize(by_row.mapInArrow(run, "id bigint, vector array<double>"), "svd-vectors")
        shared.destroy()
        return out

    Q = orthonormal(np.random.default_rng(seed).standard_normal((c, width)))
    for _ in range(rounds if c else 0):
        Q = orthonormal(gram_times(Q))
    w, v = np.linalg.eigh(Q.T @ gram_times(Q)) if c else (np.zeros(0), np.zeros((0, 0)))
    top = np.argsort(w)[::-1][:rank]
    if not turned:
        out = rows_times(Q @ v[:, top])
    else:  # U is known; U * S is AA'U / S
        s = np.sqrt(np.maximum(w[top], 0))
        out = columns_of(Q @ (v[:, top] / np.where(s > 1e-12 * s.max(initial=0), s, np.inf)))
    discard(written, packed)
    return out


def fuzzy_graph(edges: DataFrame, k: int) -> DataFrame:
    """Symmetric membership strengths of a neighbour table (src, dst, d): each row's scale makes
    its strengths sum to log2(k), and the two directions join as a + b - ab."""

    def run(key, table):
        d = table.column("d").to_numpy()
        pos = d[d > 0]
        rho = pos.min() if len(pos) else 0.0
        lo, hi, sigma = 0.0, np.inf, 1.0
        for _ in range(64):
            s = np.exp(-np.maximum(0, d - rho) / sigma).sum()
            if abs(s - np.log2(k)) < 1e-7:
                break
            if s > np.log2(k):
                hi = sigma
                sigma = (lo + hi) / 2
            else:
                lo = sigma
                sigma = sigma * 2 if hi == np.inf else (lo + hi) / 2
        sigma = max(sigma, 1e-3 * max(d.mean(), 1e-12))
        return pa.table({"src": table.column("src"), "dst": table.column("dst"), "w": np.exp(-np.maximum(0, d - rho) / sigma)})

    one = edges.select("src", "dst", "d").groupBy("src").applyInArrow(run, "src bigint, dst bigint, w double")
    pair = one.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return pair.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0)).alias("weight"))


def fit_curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a x^2b) nearest to the offset exponential, by Gauss-Newton."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.5, 0.9
    for _ in range(200):
        t = x ** (2 * b)
        f = 1 / (1 + a * t)
        J = np.stack([-t * f * f, -a * t * 2 * np.log(x) * f * f], 1)
        step = np.linalg.lstsq(J, y - f, rcond=None)[0]
        a, b = max(0.05, a + 0.5 * step[0]), min(3.0, max(0.2, b + 0.5 * step[1]))
    return float(a), float(b)


def _added(Y: np.ndarray, u: np.ndarray, x: np.ndarray) -> None:
    """``Y[u] += x`` for sorted rows ``u``, which may repeat."""
    if len(u):
        start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        Y[u[start]] += np.add.reduceat(x, start, axis=0)


def _both_ways(i: np.ndarray, j: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges from each of their ends, in the order of it."""
    src = np.concatenate([i, j])
    order = np.argsort(src, kind="stable")
    return src[order], np.concatenate([j, i])[order], np.concatenate([p, p])[order]


def _spectral(n: int, d: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The leading vectors of the normalised adjacency, the first being trivial, within 10 of the origin."""
    deg = np.bincount(i, w, n) + np.bincount(j, w, n)
    s = 1 / np.sqrt(np.maximum(deg, 1e-12))
    Y = np.linalg.qr(rng.standard_normal((n, d + 1)))[0]
    i, j, x = _both_ways(i, j, w * s[i] * s[j])
    for _ in range(100):
        Z = Y.copy()
        _added(Z, i, x[:, None] * Y[j])
        Y = np.linalg.qr(Z)[0]
    Y = Y[:, 1 : d + 1]
    return 10 * Y / max(np.abs(Y).max(), 1e-12) + rng.normal(0, 1e-4, Y.shape)


def _descend(Y: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray, curve: tuple[float, float], epochs: range, total: int, rng: np.random.Generator, pool: np.ndarray | None = None) -> np.ndarray:
    """Epochs of the layout's gradient: edges pull as often as their strength ``p`` says, five random points push each
    time. These come from all rows, or from ``pool``, points that stay where they are."""
    (a, b), (src, dst, p) = curve, _both_ways(i, j, p)
    for epoch in epochs:
        lr = 1 - epoch / total
        m = rng.random(len(p)) < p
        u, v = src[m], dst[m]
        if not len(u):
            continue
        delta = Y[u] - Y[v]
        q = np.einsum("ij,ij->i", delta, delta)
        power = q**b
        g = np.where(q > 0, -2 * a * b * power / np.maximum(q, 1e-12) / (1 + a * power), 0)
        delta *= g[:, None]
        np.clip(delta, -4, 4, out=delta)
        delta *= lr
        _added(Y, u, delta)
        others = Y if pool is None else pool
        for _ in range(5):
            delta = Y[u] - others[rng.integers(0, len(others), len(u))]
            q = np.einsum("ij,ij->i", delta, delta)
            g = np.where(q > 0, 2 * b / ((0.001 + q) * (1 + a * q**b)), 0)
            delta *= g[:, None]
            np.clip(delta, -4, 4, out=delta)
            delta *= lr
            _added(Y, u, delta)
    return Y


def principal_axes(df: DataFrame, id_col: str, vec_col: str, d: int) -> DataFrame:
    """(id, vector): rows on the first ``d`` principal axes, within 10 of the origin; missing axes are 0.

    Tasks return sums and products of their rows; the driver decomposes one matrix of the columns squared.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)

    def gram(batches):
        for b in batches:
            if b.num_rows:
                X = np.column_stack([np.ones(b.num_rows), matrix(b)])
                G = X.T @ X
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(G))), pa.array(list(G), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.mapInArrow(gram, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    m = max((r["i"] for r in parts), default=0) + 1
    G = np.zeros((m, m))
    for r in parts:
        G[r["i"], r["j"]] = r["x"]
    mean = G[0, 1:] / max(G[0, 0], 1)
    axes = np.linalg.eigh(G[1:, 1:] / max(G[0, 0], 1) - np.outer(mean, mean))[1][:, ::-1][:, :d] if m > 1 else np.zeros((0, 0))
    axes = np.pad(axes, ((0, 0), (0, d - axes.shape[1])))

    def project(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list((matrix(b) - mean) @ axes if b.num_rows else []), pa.list_(pa.float64()))], names=["id", "vector"])

    out = materialize(rows.mapInArrow(project, "id bigint, vector array<double>"), "principal-axes")
    most = out.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    return out.select("id", F.transform("vector", lambda x: x * F.lit(10 / (most or 1.0))).alias("vector"))


#: Points of the whole layout that push the points of every block.
POOL = 4096


def umap(df: DataFrame, id_col: str, vec_col: str, d: int = 2, k: int = 15, min_dist: float = 0.1, metric: str = "cosine", seed: int = 42, epochs: int = 200, block: int = 20_000, rounds: int = 20) -> DataFrame:
    """(id, vector): a layout of the fuzzy graph of the ``k`` (approximately) nearest neighbours.

    A table that fits one block is laid out in that block's task, from a spectral start. A larger one starts from its principal axes, and
    its epochs are dealt over rounds: in each, vertices near each other form blocks (``near_blocks``, drawn anew every time), a task
    moves the points of a block along the edges within it, and a bounded sample of all points pushes them; coordinates go from round to
    round as a table. No task holds more than a block, and nothing but the sample and one small matrix comes to the driver.
    """
    ids = df.select(F.col(id_col).cast("bigint").alias("id"))
    n = ids.count()
    near = approximate_knn(df, id_col, vec_col, k, metric)
    edges = materialize(fuzzy_graph(near, k), "umap-edges")
    most = edges.agg(F.max("weight")).first()[0] or 1.0
    curve = fit_curve(min_dist)
    e_names, whole = ("src", "dst", "weight"), n <= block

    def table(at: list[int], Y: np.ndarray) -> pa.Table:
        return pa.table({"id": pa.array(at, pa.int64()), "vector": pa.array([[float(t) for t in y] for y in Y], pa.list_(pa.float64()))})

    def arrays(right: pa.Table, ids: list[int]):
        right = right.sort_by([("src", "ascending"), ("dst", "ascending")])
        at = {x: i for i, x in enumerate(ids)}
        i, j = (np.array([at[x] for x in right.column(c).to_pylist()], int) for c in ("src", "dst"))
        return i, j, right.column("weight").to_numpy().astype(float)

    if whole:

        def run(key, left, right):
            ids, rng = sorted(left.column("id").to_pylist()), np.random.default_rng(seed)
            i, j, w = arrays(right, ids)
            if not len(w):
                return table(ids, np.zeros((len(ids), d)))
            return table(ids, _descend(_spectral(len(ids), d, i, j, w, rng), i, j, w / most, curve, range(epochs), epochs, rng))

        left, right = ids.select("id", F.lit(0).alias("block")), edges.select(F.lit(0).alias("block"), *e_names)
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, "id bigint, vector array<double>")

    places = materialize(principal_axes(df if metric != "cosine" else df.select(id_col, l2_normalize(F.col(vec_col)).alias(vec_col)), id_col, vec_col, d), "umap-places")
    v = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("part", F.col("id"))
    v = materialize(v, "umap-vertices")
    by = "key", "salt"

    def mover(r: int, span: range, pool: np.ndarray):
        """What a round's task does with a block."""

        def run(key, left, right):
            left = left.sort_by("id")
            ids, rng = left.column("id").to_pylist(), np.random.default_rng([seed, r, key[0].as_py() & 0xFFFFFFFF, key[1].as_py()])
            Y = np.array(left.column("vector").to_pylist(), float).reshape(len(ids), d)
            i, j, w = arrays(right, ids)
            return table(ids, _descend(Y, i, j, w / most, curve, span, epochs, rng, pool) if len(w) else Y)

        return run

    for r in range(rounds):
        span = range(epochs * r // rounds, epochs * (r + 1) // rounds)
        pool = np.array([x["vector"] for x in sample_rows(places, "id", POOL, seed + r).collect()])

        dealt = near_blocks(v, edges, block, seed + r)
        where = dealt.select("id", *by)
        a, b = where.toDF("src", "k", "s"), where.toDF("dst", "k2", "s2")
        inside = edges.join(unsent(a), "src").join(unsent(b), "dst").where("k = k2 and s = s2").select("k", "s", *e_names)
        moved = where.join(unsent(places), "id").groupBy(*by).cogroup(inside.groupBy("k", "s")).applyInArrow(mover(r, span, pool), "id bigint, vector array<double>")
        alone = places.join(unsent(v), "id", "left_anti")  # a vertex without an edge stays
        old, places = places, materialize(moved.unionByName(alone), "umap-places")
        discard(old, dealt)
    return places


def hash_model(width: int = 32) -> Callable[[list[str]], list[np.ndarray]]:
    """A deterministic stand-in for a language model: a state for each residue and two special tokens.

    It needs no weights; it serves tests and shows the interface of a real provider.
    """

    def run(batch: list[str]) -> list[np.ndarray]:
        out = []
        for s in batch:
            codes = np.array([1, *map(ord, s.replace(" ", "")), 2], np.int64)
            grid = (codes[:, None] * 2654435761 + np.arange(width)[None] * 40503) % 65521
            out.append((grid / 65521 - 0.5).astype(np.float32))
        return out

    return run


def budget_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """Greedy packing in order: a batch closes when the next would exceed the budget of tokens."""
    out: list[list[int]] = []
    total = 0
    for i, n in enumerate(lengths):
        if not out or total + n > budget:
            out.append([])
            total = 0
        out[-1].append(i)
        total += n
    return out


#: Fixed values: (truncation, tokens a batch, pooling over special tokens, rare residues masked and residues spaced) of the three embedding runs.
MODELS = {"esm2": (1175, 64 * 1175, True, False), "esm3": (1000, 500, False, False), "prott5": (1000, 1200, True, True)}

#: What the messages of errors name after which a batch is tried again one by one.
DEVICE_ERRORS = ("out of memory", "cuda", "internal assert")


def embed(df: DataFrame, id_col: str, seq_col: str, model: str, provider: Callable[[], Callable] = hash_model) -> DataFrame:
    """(id, vector, model_name): mean-pooled states of a pluggable model, batched by tokens.

    ``provider()`` builds the model once for each task. A batch that runs out of memory, or whose
    device fails (``DEVICE_ERRORS``), is done again one by one; other errors fail the task. Empty sequences are left out.
    """
    limit, budget, specials, spaced = MODELS[model]

    def run(batches):
        net = provider()
        for b in batches:
            ids, seqs = b.column(0).to_pylist(), b.column(1).to_pylist()
            vecs: list = [None] * len(ids)
            for group in budget_batches([(len(s) + 1) // 2 if spaced else len(s) for s in seqs], budget):
                try:
                    states = net([seqs[i] for i in group])
                except (MemoryError, RuntimeError) as e:
                    if not isinstance(e, MemoryError) and not any(x in str(e).lower() for x in DEVICE_ERRORS):
                        raise
                    states = [net([seqs[i]])[0] for i in group]
                for i, h in zip(group, states):
                    vecs[i] = (h if specials or len(h) <= 2 else h[1:-1]).mean(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.float32())), pa.array([model] * len(ids))], names=["id", "vector", "model_name"])

    cut = F.substring(F.upper(seq_col), 1, limit)
    rows = df.where(F.length(seq_col) > 0).select(F.col(id_col).cast("bigint").alias("id"), (mask_rare_residues(cut) if spaced else cut).alias("s"))
    return rows.mapInArrow(run, "id bigint, vector array<float>, model_name string")
