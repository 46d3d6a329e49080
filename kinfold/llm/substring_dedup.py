"""Operator 10, substring dedup: De Bruijn compaction."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.arrow import schema_of, spark_ddl
from kinfold.plans.tables import materialize

#: Words of an anchor, the k-mer that a run of windows is filed under.
ANCHOR = 12

_RUNS = [("doc_id", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]
_EDGES = [("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("j", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())]
_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
_TEXTS = [("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    h = (a * _M[k]) ^ (b + _M[k + 1])
    h ^= h >> np.uint64(32)
    h *= _M[k + 1]
    h ^= h >> np.uint64(29)
    return h


class Spans:
    """Hashes of all runs of m words of one text, built by doubling."""

    def __init__(self, words: Sequence[bytes]):
        digest = xxhash.xxh3_64_intdigest
        self.n = len(words)
        self.base = np.fromiter((digest(w) for w in words), np.uint64, len(words))
        self.memo: dict[tuple[int, int], np.ndarray] = {}

    def of(self, m: int, k: int = 0) -> np.ndarray:
        """Hash number k (0 or 2, independent) of the runs that start at each word."""
        got = self.memo.get((m, k))
        if got is None:
            if m == 1:
                got = _mix(self.base, self.base, k)
            else:
                a = 1 << (m - 1).bit_length() - 1
                left, right = self.of(a, k), self.of(m - a, k)
                size = self.n - m + 1
                got = _mix(left[:size], right[a : a + size] ^ np.uint64(m), k)
            self.memo[m, k] = got
        return got


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each run of ``width``."""
    n = len(values) - width + 1
    view = np.lib.stride_tricks.sliding_window_view(values, width)
    out = np.empty(n, np.int64)
    for a in range(0, n, 1 << 14):
        out[a : a + (1 << 14)] = view[a : a + (1 << 14)].argmin(axis=1)
    return out + np.arange(n)


def window_runs(words: Sequence[bytes], window: int, k: int = ANCHOR):
    """Runs of consecutive windows with one anchor: (start, count, anchor, two hashes).

    A window's anchor is its k-mer of least hash, the leftmost of equals, so it depends on
    the window's words alone. A run is known by its count, first and last window.
    """
    if len(words) < window:
        return None
    spans = Spans(words)
    mers = spans.of(k)
    at = _least(mers, window - k + 1)
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(starts, len(at)))
    ends = starts + n - 1
    keys = [_mix(spans.of(window, c)[starts], spans.of(window, c)[ends] ^ n.astype(np.uint64), c) for c in (0, 2)]
    return starts, n, mers[at[starts]], keys[0], keys[1]


def _emit_runs(window: int, k: int):
    def run(batches):
        for b in batches:
            parts = []
            for doc, tag, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                got = window_runs((text or "").encode().split(), window, k)
                if got is not None:
                    parts.append((doc, tag, *got))
            if not parts:
                continue
            sizes = [len(p[2]) for p in parts]
            docs = pa.array(np.repeat(np.arange(len(parts)), sizes))
            cols = [pa.array([p[0] for p in parts], pa.int64()).take(docs), pa.array([p[1] for p in parts], pa.int32()).take(docs)]
            cols += [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int32)) for c in (2, 3)]
            cols += [pa.array(np.concatenate([p[c] for p in parts]).view(np.int64)) for c in (4, 5, 6)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema_of(_RUNS))

    return run


def _emit_edges(window: int):
    def run(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in _EDGES]
            for text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = Spans((text or "").encode().split())
                w1, w2 = spans.of(window, 0), spans.of(window, 2)
                for r in runs:
                    s, n = r["start"], r["n"]
                    row = (np.full(n, r["k1"]), np.full(n, r["k2"]), np.full(n, n, np.int32), np.arange(n, dtype=np.int32), np.full(n, r["lo"]), np.full(n, r["hi"]), w1[s : s + n].view(np.int64), w2[s : s + n].view(np.int64))
                    for c, v in zip(out, row):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, (_, t) in zip(out, _EDGES)], schema=schema_of(_EDGES))

    return run


def repeated_ranges(docs: DataFrame, window: int = 50, k: int = ANCHOR) -> DataFrame:
    """Rows ``(doc_id, tag, ranges)``: the word ranges of a document (with its text's tag) that
    windows cover whose words also start in a document of a smaller identifier.

    ``docs`` has (doc_id, tag, text). The windows are edges between runs of window-1
    words. Consecutive windows under one anchor form a run; runs whose anchor occurs in
    one document only can't repeat and go. A run that is the only one of its anchor is a
    nonbranching path that all its documents walk whole: it is compact, and one minimum
    serves all its windows. At branching anchors the distinct runs, not their
    occurrences, are opened into windows once more from their source coordinates, which
    gives each window the least document. Two hashes of 64 bits stand for words.
    """
    runs = materialize(docs.select("doc_id", "tag", "text").mapInArrow(_emit_runs(window, k), spark_ddl(_RUNS)), "runs")
    shared = materialize(runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "run-anchors")
    cand = materialize(runs.join(shared, "anchor"), "run-candidates")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tag", "start")))
    paths = materialize(cand.groupBy("anchor", "k1", "k2", "n").agg(first.alias("at"), F.max("doc_id").alias("hi")).where("at is not null"), "paths")
    forks = materialize(paths.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor", F.lit(True).alias("fork")), "forks")
    paths = materialize(paths.join(forks, "anchor", "left").select("k1", "k2", "n", "at", "hi", "fork"), "paths")
    whole = paths.where("fork is null and at.doc_id < hi").select("k1", "k2", "n", F.array(F.struct(F.lit(0).alias("j0"), (F.col("n") - 1).alias("j1"), F.col("at.doc_id").alias("lo"))).alias("gone"))
    opened = paths.where("fork").select("at.doc_id", "at.tag", F.struct(F.col("at.start").alias("start"), "n", "k1", "k2", F.col("at.doc_id").alias("lo"), "hi").alias("r"))
    opened = opened.groupBy("doc_id", "tag").agg(F.collect_list("r").alias("runs"))  # as long as a document at most
    texts = docs.select("doc_id", "tag", "text").join(opened, ["doc_id", "tag"])
    edges = materialize(texts.select("text", "runs").mapInArrow(_emit_edges(window), spark_ddl(_EDGES)), "edges")
    least = materialize(edges.groupBy("w1", "w2").agg(F.min("lo").alias("g"), F.max("hi").alias("top")).where("g < top"), "edge-minima")
    parts = edges.join(least.select("w1", "w2", "g"), ["w1", "w2"]).where("g < hi")
    parts = parts.groupBy("k1", "k2", "n").agg(F.collect_set(F.struct(F.col("j").alias("j0"), F.col("j").alias("j1"), F.col("g").alias("lo"))).alias("gone"))  # n at most
    table = materialize(whole.unionByName(parts), "path-minima")
    hits = cand.join(table, ["k1", "k2", "n"]).select("doc_id", "tag", "start", F.explode("gone").alias("x")).where(F.col("x.lo") < F.col("doc_id"))
    hits = hits.select("doc_id", "tag", F.struct((F.col("start") + F.col("x.j0")).alias("a"), (F.col("start") + F.col("x.j1") + window).alias("b")).alias("r"))
    return materialize(hits.groupBy("doc_id", "tag").agg(F.collect_set("r").alias("ranges")), "ranges")


def _kept(text: str | None, ranges) -> tuple[list[bytes], int]:
    words = (text or "").encode().split()
    if not ranges:
        return words, 0
    mark = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        mark[r["a"]] += 1
        mark[r["b"]] -= 1
    gone = np.cumsum(mark)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def _finish(fields, digest: bool):
    def run(batches):
        for b in batches:
            rows = []
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept, gone = _kept(text, ranges)
                joined = b" ".join(kept)
                rows.append((len(kept) + gone, gone, sha256(joined).hexdigest()) if digest else (joined.decode(), len(kept) + gone, gone))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, (_, t) in zip(cols, fields[1:])]], schema=schema_of(fields))

    return run


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Every document without the words that an earlier document has in a window of ``window``.

    Rows ``(doc_id, kept_text, n_words, n_removed)``, or with ``digest`` the SHA-256 of the
    kept text in its place. Words are runs without ASCII white space and are kept joined
    by one space. Windows are judged on the input, not on what is left. A null text has
    no words. A null identifier is smaller and larger than none: its row loses nothing
    and takes from no other. Rows that repeat an identifier are not earlier than each
    other. Texts under ``window`` words stay whole; other columns are not read.
    """
    tag = F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), tag.alias("tag"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(rows, window)
    fields = _OUT if digest else _TEXTS
    joined = rows.join(ranges, ["doc_id", "tag"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_finish(fields, digest), spark_ddl(fields))
