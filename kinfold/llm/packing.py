"""Operator 11, packing documents into training sequences: minimum bin slack over remaining lengths."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.arrow import packed, schema_of, spark_ddl, worker_cache
from kinfold.llm.bpe import WHITE, WordTokenizer, byte_alphabet
from kinfold.plans.tables import materialize, numbered

_PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part_crc32", pa.list_(pa.int64())), ("ids", pa.list_(pa.int32()))]


class Known(dict):
    """Identifiers of words or pieces as bytes; one that is missing is asked for, and kept if it is short."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, key: str) -> bytes:
        got = self.ask(key)
        if len(key) <= 64:
            self[key] = got
        return got


class LibraryTokens:
    """Identifiers of texts by the tokenizers library, whose model sees every distinct piece of a batch once.

    That holds for files whose steps treat words alone (those ``WordTokenizer`` knows), whose
    words are normalised and split here. With any other file, and for words with added tokens, the library does it all.
    """

    #: Characters of a slice of a long text, and of a batch of short ones.
    SLICE = 1 << 20
    #: Words, and pieces, kept between batches.
    CACHE = 400_000

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on every core
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        parsed = json.loads(spec)
        added = [t["content"] for t in parsed.get("added_tokens", [])]
        try:
            self.split = regex.compile(WordTokenizer._pattern(parsed))
        except ValueError:
            self.split = None
        self.alone = self.split is not None and not any(regex.search(f"[{WHITE}]", t) for t in added)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        #: What all added tokens begin with; it may be empty.
        self.hint = os.path.commonprefix(added)
        self.words = regex.compile(f"[^{WHITE}]+")
        self.gap = regex.compile(f"[{WHITE}]")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.letters = byte_alphabet()
        self.known, self.pieces = Known(self._word), Known(self._piece)

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.library.model.tokenize(symbols)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.special is not None and self.hint in word and self.special.search(word):
            return self._ask([word])[0]
        text = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        if text.isalpha():
            return self.pieces[text]
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text as little-endian unsigned 32-bit integers."""
        if not self.alone:
            return self._ask(texts)
        for held in (self.known, self.pieces):
            if len(held) > self.CACHE:
                held.clear()
        words = (self.words.findall(t) if self.odd.search(t) else t.split() for t in texts)
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]

    def blocks(self, text: str) -> Iterator[bytes]:
        """Identifiers of one text, slice by slice; a slice ends before white space."""
        at = 0
        while at < len(text):
            gap = self.gap.search(text, at + self.SLICE) if self.alone else None
            end = gap.start() if gap else len(text)
            yield self.encode([text[at:end]])[0]
            at = end


def binary_parts(length: int) -> list[int]:
    """The powers of two that make up a length, the largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def cut_pieces(blocks: Iterable[bytes], window: int, end: bytes) -> Iterator[tuple[int, bytes]]:
    """(start, identifiers) of a document's full windows and of what remains after them."""
    held, start, size = b"", 0, 4 * window
    for block in chain(blocks, [end]):
        held += block
        full = len(held) // size * size
        for a in range(0, full, size):
            yield start, held[a : a + size]
            start += window
        held = held[full:]
    if held:
        yield start, held


def _measured(pieces: Iterable[tuple[int, bytes]], window: int, keep_ids: bool) -> list[tuple]:
    """(start, length, crc32, crc32 of the binary parts of a remainder, ids) of each piece."""
    out = []
    for start, ids in pieces:
        n, at, parts = len(ids) // 4, 0, []
        for p in binary_parts(n) if n < window else []:
            parts.append(zlib.crc32(ids[4 * at : 4 * (at + p)]))
            at += p
        out.append((start, n, parts[0] if len(parts) == 1 else zlib.crc32(ids), parts, array("i", ids).tolist() if keep_ids else None))
    return out


def token_pieces(docs: DataFrame, spec: str, window: int, end_id: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Full windows and remainders of every document's tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a tokenizer file has a fixed size

    def run(batches):
        tok = worker_cache("packing", shared.value, lambda: LibraryTokens(shared.value))
        last = array("I", [end_id]).tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in packed([len(t) for t in texts], tok.SLICE):
                found = [tok.encode(texts[a:b])] if b - a > 1 or len(texts[a]) <= tok.SLICE else None
                docs_blocks = [[x] for x in found[0]] if found else [tok.blocks(texts[a])]
                rows: list[tuple] = []
                for doc, blocks in zip(ids[a:b], docs_blocks):
                    got = _measured(cut_pieces(blocks, window, last), window, keep_ids)
                    n = got[-1][0] + got[-1][1]
                    rows += [(doc, s, m, crc, n, parts, kept) for s, m, crc, parts, kept in got]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _PIECES)], schema=schema_of(_PIECES))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, spark_ddl(_PIECES))


def closest_fill(left: dict[int, int], room: int, first: int) -> Counter:
    """The multiset of remaining lengths, one of them ``first``, whose sum is closest to ``room`` from below.

    Reachable sums are the bits of an integer; a length that is there n times enters
    in groups of 1, 2, 4, ... copies, and the counts are read back from the bits as they stood before each group.
    """
    space = room - first
    reach, full, steps = 1, (1 << (space + 1)) - 1, []
    for length in sorted((x for x in left if x <= space), reverse=True):
        n, k = min(left[length] - (length == first), space // length), 1
        while n > 0 and not reach >> space & 1:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & full
            n, k = n - k, 2 * k
        if reach >> space & 1:
            break
    best, take = reach.bit_length() - 1, Counter({first: 1})
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            take[length] += k
            best -= length * k
    return take


def plan_windows(counts: dict[int, int], window: int = 2048) -> tuple[list[tuple], list[tuple]]:
    """(placements, cuts) of ``counts[length]`` pieces of each length.

    A placement ``(length, first, last, sequence, each, offset)`` puts the pieces of a length with ranks
    from ``first`` below ``last``, ``each`` at a time, into consecutive sequences from ``sequence`` on, at ``offset``.
    A cut ``(length, first, last, shifts, sizes, bases)`` splits such pieces at powers of two; the parts
    of a size get the ranks from its base on, after all other pieces of their length.

    The longest remaining length is taken, and the multiset that fills its window best; it is used as
    often as the counts allow. Where even the best leaves slack, a quarter of the longest pieces that are no power
    of two is cut. Powers of two fill every window, and what is left at the end fills sequences
    whose lengths are powers of two, which need no padding. The plan depends on the histogram alone and
    is as large as ``window`` allows, whatever the number of documents.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    left, given, used = {k: n for k, n in counts.items() if n}, Counter(counts), Counter()
    total = sum(k * n for k, n in left.items())
    placements, cuts, sequence = [], [], 0
    while left:
        room, top = window if total >= window else 1 << total.bit_length() - 1, max(left)
        take = closest_fill(left, room, top) if top <= room else None
        if take is None or sum(k * n for k, n in take.items()) < room:
            longest = max(k for k in left if k & (k - 1))
            n, sizes = -(-left[longest] // 4), binary_parts(longest)
            cuts.append((longest, used[longest], used[longest] + n, [sum(sizes[:i]) for i in range(len(sizes))], sizes, [given[s] for s in sizes]))
            used[longest] += n
            left[longest] -= n
            for s in sizes:
                given[s] += n
                left[s] = left.get(s, 0) + n
        else:
            times, offset = min(left[k] // n for k, n in take.items()), 0
            for k, n in sorted(take.items(), reverse=True):
                placements.append((k, used[k], used[k] + n * times, sequence, n, offset))
                used[k] += n * times
                left[k] -= n * times
                offset += n * k
            sequence += times
            total -= times * room
        left = {k: n for k, n in left.items() if n}
    return placements, cuts


def pack_documents(docs: DataFrame, spec: str, window: int = 2048, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of pieces, with ``ids`` where asked for.

    A document's identifiers, by the tokenizers library without special tokens, then ``end_id``, are cut into full windows
    and a remainder shorter than one; remainders are packed by ``plan_windows``, few of them cut further. No
    sequence holds more than ``window`` identifiers, and none needs padding: lengths are ``window`` or powers of two.

    A null or empty text is the one identifier ``end_id``; rows are documents of their own, also where they repeat
    or have no identifier; very long texts are read in slices; other columns are not read; an empty table gives an
    empty table. The driver gets a histogram of ``window`` lengths. Pieces are ranked within their length by
    identifier and place over ranges, so a length that many documents share is no hot group; reruns agree, but for rows alike in all of this.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, spec, window, end_id, keep_ids, id_col, text_col)
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    placements, cuts = plan_windows(counts, window)
    narrow = numbered(pieces.drop("ids"), F.col("length"), F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("row"))
    before, bases = 0, []
    for length in sorted(counts):
        bases.append((length, before))
        before += counts[length]
    small = lambda rows, ddl: F.broadcast(spark.createDataFrame(rows, ddl))
    base = small(bases, "length int, base bigint")
    ranked = narrow.join(base, "length").withColumn("rank", F.col("number") - F.col("base"))
    cut = small(cuts, "length int, cut_first bigint, cut_last bigint, shifts array<int>, sizes array<int>, bases array<bigint>")
    ranked = ranked.join(cut, (ranked["length"] == cut["length"]) & (F.col("rank") >= F.col("cut_first")) & (F.col("rank") < F.col("cut_last")), "left").drop(cut["length"])
    part = lambda i: F.struct(F.get("shifts", i).alias("shift"), F.get("sizes", i).alias("length"), F.get("part_crc32", i).alias("ids_crc32"), (F.get("bases", i) + F.col("rank") - F.col("cut_first")).alias("rank"))
    whole = F.array(F.struct(F.lit(0).alias("shift"), "length", "ids_crc32", "rank"))
    parts = F.when(F.col("shifts").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.size("shifts") - 1), part))
    flat = ranked.select("doc_id", "doc_tokens", "row", "start", F.explode(parts).alias("p"))
    flat = flat.select("doc_id", "doc_tokens", "row", "p.shift", (F.col("start") + F.col("p.shift")).alias("start"), "p.length", "p.ids_crc32", "p.rank")
    place = small(placements, "of int, first bigint, last bigint, sequence bigint, each int, at bigint")
    flat = flat.join(place, (flat["length"] == place["of"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    out = flat.select(
        "doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("bigint").alias("offset"), "row", "shift",
    )
    if keep_ids:
        out = out.join(pieces.select("row", F.col("ids").alias("_all")), "row").withColumn("ids", F.slice("_all", F.col("shift") + 1, F.col("length").cast("int"))).drop("_all")
    return out.drop("row", "shift")


def sequences(packed_ids: DataFrame) -> DataFrame:
    """Rows ``(sequence_id, ids, doc_ids)``: the sequences to train on, from pieces with their ``ids``.

    A group holds one window of identifiers at most. ``doc_ids`` names the document of each piece, in order.
    """
    p = packed_ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return p.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
