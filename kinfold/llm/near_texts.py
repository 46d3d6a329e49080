"""Operator 4 at a stated similarity: near copies by word shingles, SimHash and pigeonring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.llm.arrow import release_worker_cache, schema_of, spark_ddl
from kinfold.llm.simhash import chains
from kinfold.operators.components import connected_components
from kinfold.plans.tables import discard, materialize

WIDTH = 5
TENTHS = 8  # least Jaccard similarity, in tenths
#: Differing bits of two 128-bit fingerprints. Sets of similarity 0.8 differ in 20 bits with a
#: deviation of 4 (24 and 4.4 for the smallest sets); unlike ones in 64 with a deviation of 6.
DISTANCE = 44
SEGMENTS = 4  # of 32 bits, in a ring
HOT = 256  # sets in a bucket beyond which it is compared in blocks
BLOCK = 1024
BLOCK_ITEMS = 1 << 22  # of all sets of a block, on average

_FIRST = [("doc_id", pa.int64()), ("sha", pa.string()), ("vid", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.list_(pa.int64()))]
_SET = [("vid", pa.int64()), ("items", pa.list_(pa.int64()))]
_LINK = [("src", pa.int64()), ("dst", pa.int64())]


def shingles(text: str | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's word shingles, words as in operator 4.

    A text of fewer words is one shingle, a text without a word that of no bytes.
    """
    words = (text or "").encode().lower().split()
    digest, parts = xxhash.xxh64_intdigest, []
    if len(words) <= width:
        parts.append(np.array([digest(b" ".join(words), seed)], np.uint64))
    else:
        n = len(words) - width + 1
        for a in range(0, n, 1 << 14):
            part = words[a : a + (1 << 14) + width - 1]
            parts.append(np.unique(np.array([digest(s, seed) for s in map(b" ".join, zip(*(part[i:] for i in range(width))))], np.uint64)))
    return np.unique(np.concatenate(parts).view(np.int64))


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of a set of hashes: bits of the hashes and of a mixture of them."""
    h = items.view(np.uint64)
    m = h * np.uint64(0x9E3779B97F4A7C15)
    m = (m ^ (m >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = []
    for x in (h, m ^ (m >> np.uint64(32))):
        total = np.zeros(64, np.int64)
        for a in range(0, len(x), 1 << 14):
            total += np.unpackbits(x[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > len(x), bitorder="little").view(np.int64)[0]))
    return out[0], out[1]


def spare(n):
    """Items that a set of n can hold beyond those it shares with a similar one."""
    return n - (TENTHS * n + 9) // 10


def shared_least(n):
    """Items that the prefixes of two similar sets, the smaller of n, have in common at least."""
    return np.maximum((spare(n) + 1) // 2, 1)


def prefix_length(n: int) -> int:
    """Two sets share at least l items of their least ones, if each gives spare + l of them."""
    return min(n, int(spare(n) + shared_least(n)))


def _name(items: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(items.tobytes())).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _firsts(batches):
    release_worker_cache()
    for b in batches:
        sets = [shingles(t) for t in b.column(2).to_pylist()]
        prints = [fingerprint(s) for s in sets]
        cols = [[_name(s) for s in sets], [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints]]
        cols = [pa.array(c, t) for c, (_, t) in zip(cols, _FIRST[2:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, _lists([s[: prefix_length(len(s))] for s in sets])], schema=schema_of(_FIRST))


def _sets(batches):
    for b in batches:
        sets = [shingles(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), _lists(sets)], schema=schema_of(_SET))


def _need(n: Column) -> Column:
    """Prefix items that a set of n must share with others: ``shared_least`` of its smallest partner."""
    least = F.floor((n * TENTHS + 9) / 10)
    return F.greatest(F.floor((least - F.floor((least * TENTHS + 9) / 10) + 1) / 2), F.lit(1)).cast("int")


def _like(a: str, b: str) -> Column:
    """Pigeonring over the fingerprints, then the whole distance."""
    diff = [F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}")) for f in ("f1", "f2")]
    seg = [F.bit_count(F.shiftrightunsigned(d, 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))) for d in diff for i in range(2)]
    sizes = (F.col(f"{a}.n") * 10 >= F.col(f"{b}.n") * TENTHS) & (F.col(f"{b}.n") * 10 >= F.col(f"{a}.n") * TENTHS)
    return sizes & chains(seg, DISTANCE) & (F.bit_count(diff[0]) + F.bit_count(diff[1]) <= DISTANCE)


def _near(f: np.ndarray, n: np.ndarray, at: int) -> np.ndarray:
    """The same for row ``at`` against all rows: fingerprints as (rows, 4) of 32 bits."""
    seg = np.bitwise_count(f ^ f[at]).astype(np.int16)
    return (n * 10 >= n[at] * TENTHS) & (n * TENTHS <= n[at] * 10) & chains(list(seg.T), DISTANCE) & (seg.sum(axis=1) <= DISTANCE)


def _table(table: pa.Table):
    """A group's rows, one for each set: positions, sizes, fingerprints, names."""
    vid = table.column("vid").to_numpy()
    vid, at = np.unique(vid, return_index=True)
    n = table.column("n").to_numpy()[at].astype(np.int64)
    f = np.stack([table.column(c).to_numpy()[at] for c in ("f1", "f2")], axis=1)
    return vid, at, n, np.ascontiguousarray(f).view(np.uint32)


def _emit(links: list[tuple[int, int]]) -> pa.Table:
    out = np.array(links, np.int64).reshape(-1, 2)
    return pa.Table.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=schema_of(_LINK))


def _forest(key, table):
    """Links that join what all links of near fingerprints join."""
    vid, _, n, f = _table(table)
    links, left, queue = [], np.arange(len(vid)), []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        if len(left):
            near = _near(np.concatenate([f[at : at + 1], f[left]]), np.concatenate([n[at : at + 1], n[left]]), 0)[1:]
            links += [(int(vid[at]), int(vid[x])) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return _emit(links)


def _verified(key, table):
    """Links between similar sets of one block pair: a forest that joins what all of them join."""
    vid, at, n, f = _table(table)
    own, x, y = table.column("own").to_numpy()[at], key[1].as_py(), key[2].as_py()
    items = table.column("items").combine_chunks()
    ends, flat = items.offsets.to_numpy(), items.values.to_numpy()
    codes = np.unique(flat, return_inverse=True)[1]
    sets = [codes[ends[i] : ends[i + 1]] for i in at]
    group, mark, links = np.arange(len(vid)), np.zeros(len(flat) + 1, bool), []
    for i in np.flatnonzero(own == x):
        some = _near(f, n, i) & (group != group[i])
        some &= (np.arange(len(vid)) > i) if x == y else own == y
        js = np.flatnonzero(some)
        if not len(js):
            continue
        mark[sets[i]] = True
        both = np.add.reduceat(mark[np.concatenate([sets[j] for j in js])], np.cumsum([0, *n[js[:-1]]]), dtype=np.int64)
        mark[sets[i]] = False
        for j in js[both * (10 + TENTHS) >= (n[i] + n[js]) * TENTHS]:
            if group[j] != group[i]:
                links.append((int(vid[i]), int(vid[j])))
                group[group == group[j]] = group[i]
    return _emit(links)


def _block_pairs(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Rows of each pair of blocks of a group of ``size``: (key, x, y, own, others)."""
    blocks = rows.withColumn("blocks", F.ceil(F.col(size) / BLOCK).cast("int"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return blocks.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("blocks", "other", size)


def _candidates(held: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` between sets that may be similar, with the components of all such pairs.

    Two similar sets have ``shared_least`` items in common among their prefixes. So a
    set whose prefix shares fewer with others drops out, and of the items shared, the most
    frequent ones but one less can go: the rarest common one stays. Sets that keep an item
    in common meet, and those of near fingerprints are linked.
    """
    rows = held.select(F.explode("prefix").alias("item"), "vid")
    rows = rows.withColumn("c", F.count("*").over(Window.partitionBy("item"))).where("c > 1")
    rows = materialize(rows, "near-shared")
    per = rows.groupBy("vid").agg(F.array_sort(F.collect_set(F.struct("c", "item"))).alias("r"))  # as long as a prefix at most
    per = per.join(owners.select("vid", "n", "f1", "f2"), "vid").withColumn("keep", F.size("r") - _need(F.col("n")) + 1).where("keep > 0")
    kept = materialize(per.select("vid", "n", "f1", "f2", F.explode(F.slice("r", F.lit(1), F.col("keep"))).alias("r")).select("r.item", "vid", "n", "f1", "f2"), "near-kept")
    sizes = materialize(kept.groupBy("item").agg(F.count("*").alias("m")).where("m > 1"), "near-buckets")
    cold = kept.join(sizes.where(F.col("m") <= HOT).select("item"), "item", "left_semi")
    pairs = cold.alias("a").join(cold.alias("b"), "item").where((F.col("a.vid") < F.col("b.vid")) & _like("a", "b"))
    hot = kept.join(sizes.where(F.col("m") > HOT), "item")
    forest = _block_pairs(hot, "item", "m").groupBy("item", "x", "y").applyInArrow(_forest, spark_ddl(_LINK))
    return pairs.select(F.col("a.vid").alias("src"), F.col("b.vid").alias("dst")).unionByName(forest)


def near_firsts(docs: DataFrame) -> DataFrame:
    """One row ``(doc_id, sha)`` for each component of near copies: the smallest identifier,
    null last, then the smallest SHA-256 of the text.

    Documents link when the Jaccard similarity of their five-word shingles is 0.8 at least.
    Candidates share a rare shingle and pass the pigeonring test and the Hamming check of 128-bit
    SimHashes, whose distance is five deviations over that of such pairs; each is verified on
    its whole sets. Texts of one shingle set are one vertex. Components of candidates are
    compared in pairs of blocks of BLOCK sets, or fewer of long texts, each of which returns a forest of links, so that
    neither a frequent shingle nor a large group of near copies gives all its pairs as rows.
    Null texts count as empty; an empty table gives an empty table; other columns are not read.
    """
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), sha, "text")
    held = materialize(rows.mapInArrow(_firsts, spark_ddl(_FIRST)), "near-prefixes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")).alias("first")
    owners = materialize(held.groupBy("vid").agg(first, F.min("n").alias("n"), F.min("f1").alias("f1"), F.min("f2").alias("f2")), "near-owners")
    groups = materialize(connected_components(_candidates(held, owners)).withColumnRenamed("id", "vid"), "near-groups")
    discard(held)
    members = groups.join(owners, "vid")
    # long sets count for several, so that a block is bounded in items too
    large = F.ceil(F.sum("n") / (BLOCK_ITEMS // BLOCK))
    sizes = members.groupBy("component").agg(F.greatest(F.count("*"), large).alias("m"))
    members = materialize(members.join(sizes, "component"), "near-members")
    wanted = members.select(F.col("first.doc_id").alias("d"), F.col("first.sha").alias("sha"))
    texts = rows.join(wanted, (rows.sha == wanted.sha) & rows.doc_id.eqNullSafe(wanted.d), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(_sets, spark_ddl(_SET)).dropDuplicates(["vid"]), "near-sets")
    blocks = _block_pairs(members.select("component", "vid", "n", "f1", "f2", "m"), "component", "m").join(sets, "vid")
    links = blocks.groupBy("component", "x", "y").applyInArrow(_verified, spark_ddl(_LINK))
    comps = connected_components(links).withColumnRenamed("id", "vid")
    named = owners.join(comps, "vid", "left").select("first", F.coalesce("component", "vid").alias("component"))
    return named.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.sha")
