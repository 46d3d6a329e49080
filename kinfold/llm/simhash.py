"""Operator 4, SimHash near-dedup: pigeonring filtering."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm.arrow import release_worker_cache, schema_of, spark_ddl
from kinfold.operators.components import connected_components
from kinfold.plans.tables import materialize

SEGMENTS = 4  # of 16 bits, in a ring
HOT = 64  # fingerprints in a bucket beyond which it is compared in blocks
BLOCK = 512

_FP = [("doc_id", pa.int64()), ("fp", pa.int64())]
_EDGE = [("src", pa.int64()), ("dst", pa.int64())]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without a word.

    A-Z are lower-cased, words are runs without ASCII white space, and a shingle's hash
    is XXH64. A bit is set if more than half of the hashes have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for a in range(0, n, 1 << 14):
        part = words[a : a + (1 << 14) + width - 1]
        h = np.array([digest(s, seed) for s in map(b" ".join, zip(*(part[i:] for i in range(width))))], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > n).tolist())


def _fingerprints(batches, width: int, fields=_FP):
    """Rows (doc_id, text, others) with the fingerprint in place of the text."""
    release_worker_cache()
    for b in batches:
        fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], schema=schema_of(fields))


def chains(seg: list, distance: int):
    """Whether some chain of consecutive segments keeps its budgets.

    ``seg`` are the differing bits of each segment (columns or arrays). If at most
    ``distance`` bits differ, there is a segment of the ring from which the differences of the
    first l segments stay within l * distance / segments, for every l.
    """
    k, out = len(seg), None
    for i in range(k):
        chain, ok = seg[i], seg[i] * k <= distance
        for n in range(2, k + 1):
            chain = chain + seg[(i + n - 1) % k]
            ok = ok & (chain * k <= n * distance)
        out = ok if out is None else out | ok
    return out


def pigeonring(diff: Column, distance: int = 3) -> Column:
    """``chains`` over the exclusive or of two fingerprints."""
    return chains([F.bit_count(F.shiftrightunsigned(diff, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(SEGMENTS)], distance)


def _pigeonring(diff: np.ndarray, distance: int) -> np.ndarray:
    """The same over an array."""
    return chains([np.bitwise_count(diff >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(SEGMENTS)], distance)


def spanning_links(fps: np.ndarray, distance: int = 3) -> list[tuple[int, int]]:
    """Links that join what all links within ``distance`` join: a forest, not all pairs."""
    left, out = fps.astype(np.uint64), []
    while len(left):
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            at = queue.popleft()
            diff = left ^ at
            near = np.flatnonzero(_pigeonring(diff, distance))
            near = near[np.bitwise_count(diff[near]) <= distance]
            if len(near):
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                queue.extend(found)
                left = np.delete(left, near)
    return out


def _block_links(distance: int):
    def run(key, table):
        fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
        links = np.array(spanning_links(fps, distance), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.Table.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=schema_of(_EDGE))

    return run


def near_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints (column ``fp``) whose components are
    those of all pairs within ``distance`` bits.

    A chain from segment i has no difference in segment i and at most one in the next,
    so one half of that one is equal too. The eight keys (i, half, bits of segment i,
    bits of that half) of 24 bits find all pairs. Buckets of up to HOT fingerprints
    are joined in the engine; larger ones are cut into blocks, each pair of blocks is one
    task's group, and that returns a forest in place of all pairs.
    """
    if distance != 3:
        raise ValueError("the keys are made for three bits")
    keys = []
    for i in range(SEGMENTS):
        nxt = 16 * ((i + 1) % SEGMENTS)
        for half in range(2):
            bits = F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) * 256 + F.shiftrightunsigned("fp", nxt + 8 * half).bitwiseAND(F.lit(0xFF))
            keys.append(bits + ((2 * i + half) << 24))
    rows = materialize(fps.select("fp", F.explode(F.array(*keys)).alias("key")), "simhash-keys")
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    held = materialize(rows.join(sizes, "key"), "simhash-held")
    small = held.where(F.col("n") <= HOT)
    a, b = small.select("key", F.col("fp").alias("src")), small.select("key", F.col("fp").alias("dst"))
    diff = F.col("src").bitwiseXOR(F.col("dst"))
    pairs = a.join(b, "key").where((F.col("src") < F.col("dst")) & pigeonring(diff) & (F.bit_count(diff) <= distance)).select("src", "dst")
    hot = held.where(F.col("n") > HOT)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    hot = hot.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    return pairs.unionByName(hot.groupBy("key", "x", "y").applyInArrow(_block_links(distance), spark_ddl(_EDGE)))


def _members(fp: DataFrame, distance: int) -> DataFrame:
    """Rows ``(fp, least, component)``: every fingerprint's smallest identifier and its component."""
    owners = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-owners")
    comps = connected_components(near_links(owners.select("fp"), distance))
    owners = owners.join(comps.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return materialize(owners, "simhash-members")


def simhash_components(docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Documents link when their fingerprints differ in ``distance`` bits at most; a
    component is named by its smallest identifier. Equal fingerprints are one vertex, so
    a group of copies costs one row in the search. Null texts and texts without a word
    have fingerprint 0 and link like any other. Null identifiers take part; they name a
    component (by null) only where it has no other. Repeated rows are all reported;
    other columns are not read; an empty table gives an empty table.
    """
    fp = materialize(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _fingerprints(it, width), spark_ddl(_FP)), "simhash-fp")
    owners = _members(fp, distance)
    names = owners.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(owners.join(materialize(names, "simhash-names"), "component").select("fp", "component_id"), "simhash-named")
    out = fp.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
