"""Operator 9, exact dedup: Patricia-trie owners."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.arrow import release_worker_cache, schema_of, spark_ddl
from kinfold.plans.tables import materialize


class _Node:
    __slots__ = ("label", "kids", "owner", "count", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.count, self.spill = label, None, None, 0, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 32:
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings.

    A terminal node stores the owner of its string (by default the smallest identifier,
    with ``largest`` the largest; None ranks below every identifier) and a count. When
    the labels held exceed ``budget`` bytes, the largest child of the root moves to a
    temporary file; later strings under it are appended there, and ``items`` rebuilds
    it as a trie of its own, which may spill again further down. A string that leaves the
    label of a spilled child splits it like any other; the file holds whole strings, so
    it stays as it is.
    """

    def __init__(self, budget: int = 192 << 20, largest: bool = False, depth: int = 0):
        self.root, self.budget, self.held, self.largest, self.depth = _Node(b""), budget, 0, largest, depth
        self.under: dict[int, int] = {}

    def _merge(self, node: _Node, owner, count: int) -> None:
        if node.count == 0 or node.owner is None:
            node.owner = owner if node.count == 0 or owner is not None else None
        elif owner is not None:
            node.owner = max(node.owner, owner) if self.largest else min(node.owner, owner)
        node.count += count

    def insert(self, key: bytes, owner, count: int = 1) -> None:
        node, pos, top = self.root, self.depth, None
        while True:
            if pos == len(key):
                self._merge(node, owner, count)
                return
            first = key[pos]
            if node is self.root:
                top = first
            kid = node.kids.get(first) if node.kids else None
            if kid is None:
                new = _Node(key[pos:])
                self._merge(new, owner, count)
                if node.kids is None:
                    node.kids = {}
                node.kids[first] = new
                self._grow(top, len(key) - pos + 200)
                return
            label = kid.label
            if key.startswith(label, pos):
                if kid.spill is not None:
                    pickle.dump((key, owner, count), kid.spill)
                    return
                node, pos = kid, pos + len(label)
                continue
            k = _common(label, key[pos : pos + len(label)])
            mid = _Node(label[:k])
            kid.label = label[k:]
            mid.kids = {kid.label[0]: kid}
            node.kids[first] = mid
            node, pos = mid, pos + k
            self._grow(top, 200, False)

    def _grow(self, top: int, n: int, may_spill: bool = True) -> None:
        self.held += n
        self.under[top] = self.under.get(top, 0) + n
        if may_spill and self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        live = {b: n for b, n in self.under.items() if self.root.kids[b].spill is None}
        # a subtree of one string cannot shrink, so it stays
        live = {b: n for b, n in live.items() if self.root.kids[b].kids}
        if not live:
            return
        byte = max(live, key=live.get)
        kid = self.root.kids[byte]
        files = [n.spill for n, _ in self._nodes(kid, b"") if n.spill is not None]
        file = files[0] if files else tempfile.TemporaryFile(dir=os.environ.get("TMPDIR"))
        for node, key in self._nodes(kid, b"\0" * self.depth):
            if node.count:
                pickle.dump((key, node.owner, node.count), file)
        for other in files[1:]:
            for row in self._rows(other):
                pickle.dump(row, file)
        stub = _Node(kid.label)
        stub.spill = file
        self.root.kids[byte] = stub
        self.held -= self.under.pop(byte)
        self.under[byte] = 0

    @staticmethod
    def _nodes(node: _Node, prefix: bytes) -> Iterator[tuple[_Node, bytes]]:
        """The nodes of a subtree with their strings."""
        stack = [(node, prefix)]
        while stack:
            n, p = stack.pop()
            p += n.label
            yield n, p
            if n.kids:
                stack.extend((k, p) for k in n.kids.values())

    @staticmethod
    def _rows(file) -> Iterator[tuple[bytes, object, int]]:
        """What a temporary file holds; it is closed at the end."""
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                break
        file.close()

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, object, int]]:
        """Every distinct string with its owner and count."""
        for node, key in self._nodes(self.root, prefix):
            if node.spill is None:
                if node.count:
                    yield key, node.owner, node.count
                continue
            sub = PatriciaTrie(self.budget, self.largest, self.depth + len(key) - len(prefix))
            for row in self._rows(node.spill):
                sub.insert(*row)
            yield from sub.items(key)


_OWNERS = [("len", pa.int64()), ("sha", pa.string()), ("bytes", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())]
_RESULT = [("len", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())]


def _tries(batches, largest: bool, budget: int, final: bool):
    """The owners of a partition's rows (bytes, owner, n), by one trie of full byte strings."""
    release_worker_cache()
    trie = PatriciaTrie(budget, largest)
    for b in batches:
        for key, owner, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            trie.insert(key, owner, n)
    rows, size = [], 0

    def batch():
        fields = _RESULT if final else _OWNERS
        cols = zip(*((len(k), sha256(k).hexdigest(), o, n) if final else (len(k), sha256(k).hexdigest(), k, o, n) for k, o, n in rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], schema=schema_of(fields))

    for item in trie.items():
        rows.append(item)
        size += len(item[0])
        if size > 4 << 20 or len(rows) >= 10_000:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def patricia_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, budget: int = 192 << 20) -> DataFrame:
    """One row ``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``.

    Texts are equal when their UTF-8 bytes are; null is the empty text. Of equal texts
    the smallest identifier owns (``largest``: the largest). A null identifier ranks
    below all others, and is the owner only of a group that has no other. Repeats of a
    whole row (same identifier and text) are all reported, kept alike. Other columns
    are not read. An empty table gives an empty table.

    Every map partition first inserts its full texts into a trie of its own, so that a
    group holding a third of all rows crosses the network once for each partition. The
    distinct texts then go to partitions of (length, content hash), whose tries hold
    the global owners. The digests route and rejoin rows; equality is decided on full
    byte strings.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("t"))
    keyed = rows.select("doc_id", F.octet_length("t").cast("bigint").alias("len"), F.sha2("t", 256).alias("sha"))
    raw = rows.select(F.encode("t", "UTF-8").alias("bytes"), F.col("doc_id").alias("owner"), F.lit(1).cast("bigint").alias("n"))
    local = raw.mapInArrow(lambda it: _tries(it, largest, budget, False), spark_ddl(_OWNERS))
    dealt = local.repartition("len", "sha").select("bytes", "owner", "n")
    owners = materialize(dealt.mapInArrow(lambda it: _tries(it, largest, budget, True), spark_ddl(_RESULT)), "trie-owners")
    out = keyed.join(owners, ["len", "sha"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
