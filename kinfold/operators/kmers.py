"""k-mer profiles in long form, vocabularies and matrices."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from kinfold.functions.sequences import kmers
from kinfold.plans.tables import materialize, numbered


#: Cells of an Arrow batch that counting returns.
CELLS = 1 << 15


def _row_cells(rows: DataFrame) -> DataFrame:
    """(id, k, len, kmer, n) of rows (id, seq, k): each row is counted where it lies, and nothing is shuffled."""

    def run(batches):
        for b in batches:
            for i, seq, k in zip(b.column("id"), b.column("seq"), b.column("k").to_pylist()):
                s = seq.as_py()
                found = Counter(s[j : j + k] for j in range(len(s) - k + 1))
                kmer, n = list(found), list(found.values())
                for a in range(0, len(kmer), CELLS):
                    m = len(kmer[a : a + CELLS])
                    same = pa.array([k] * m, pa.int32()), pa.array([len(s)] * m, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * m, i.type), *same, pa.array(kmer[a : a + CELLS], pa.string()), pa.array(n[a : a + CELLS], pa.int64())], names=["id", "k", "len", "kmer", "n"])

    return rows.mapInArrow(run, StructType([rows.schema["id"], *StructType.fromDDL("k int, len int, kmer string, n bigint")]))


#: Letters that have a byte in a word of 64 bits; characters of the rows that are counted together; parts that the words of a k are dealt to.
LETTERS, CHUNK, PARTS = 256, 1 << 22, 128


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def frequent_letters(rows: DataFrame) -> list[int]:
    """The code points of up to LETTERS characters, the most frequent of the rows (seq); one row a character is added up."""

    def run(batches):
        n = np.zeros(0x110000, np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                x = _points(s)
                few = np.bincount(x, minlength=0x250) if len(x) and x.max() < 0x250 else None
                if few is not None:
                    n[: len(few)] += few
                else:
                    np.add.at(n, x, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["x", "n"])

    counts = rows.select("seq").mapInArrow(run, "x bigint, n bigint").groupBy("x").agg(F.sum("n").alias("n"))
    return [r["x"] for r in counts.orderBy(F.desc("n"), "x").limit(LETTERS).collect()]


def _different(words: np.ndarray) -> np.ndarray:
    """The different words in order; sorting them is faster than a table of so many."""
    words = np.sort(words)
    return words[np.r_[True, words[1:] != words[:-1]]] if len(words) else words


class _Words:
    """The different k-mers of sequences, and the number of cells: the different k-mers of each sequence, added up.

    A k-mer of up to eight of the given letters is a word of 64 bits; words are sorted, those of a sequence first and then those of
    all. Sequences of other letters, and longer k-mers, are taken as strings.
    """

    def __init__(self, ks: Sequence[int], letters: Sequence[int]):
        self.ks, self.code = sorted(set(ks)), np.full(0x110000, -1, np.int16)
        self.code[np.array(letters, np.int64)] = np.arange(len(letters))

    def see(self, seqs: list[str]):
        """(k, words, strings, cells) for each k."""
        codes = [self.code[_points(s)] for s in seqs]
        own = [bool((c >= 0).all()) for c in codes]
        short = [c for c, ok in zip(codes, own) if ok] or [np.zeros(0, np.int16)]
        end = np.cumsum([len(c) for c in short])
        begin = end - np.array([len(c) for c in short])
        one = np.concatenate(short).astype(np.uint64)
        x = one
        for k in range(1, self.ks[-1] + 1):
            if 1 < k <= 8:
                x = (x[:-1] << np.uint64(8)) | one[k - 1 :]
            if k not in self.ks:
                continue
            strings, cells = set(), 0
            for s in (s for s, ok in zip(seqs, own) if not ok or k > 8):
                some = {s[j : j + k] for j in range(len(s) - k + 1)}
                cells += len(some)
                strings |= some
            words = np.zeros(0, np.uint64)
            if k <= 8 and len(x):
                word, new = x.copy(), np.ones(len(x), bool)
                for a, b in zip(begin.tolist(), (end - k + 1).tolist()):
                    if b > a:
                        word[a:b].sort()
                new[1:] = word[1:] != word[:-1]
                new[begin[end - begin >= k]] = True
                for j in range(1, k):  # words that go on into the next sequence
                    tail = end - j
                    new[tail[(tail >= begin) & (tail < len(new))]] = False
                words = word[new]
                cells += len(words)
                words = _different(words)
            yield k, *self.sorted(k, strings, words), cells

    def sorted(self, k: int, strings: set[str], words: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(words, strings): those of the different k-mers ``strings`` that are words go to the others."""
        some = sorted(strings)
        if not some or k > 8:
            return words, some
        code = self.code[_points("".join(some))].reshape(-1, k)
        ok = (code >= 0).all(axis=1)
        x = np.zeros(int(ok.sum()), np.uint64)
        for c in code[ok].T.astype(np.uint64):
            x = (x << np.uint64(8)) | c
        return _different(np.concatenate([words, x])), [s for s, y in zip(some, ok.tolist()) if not y]


def _word_statistics(rows: DataFrame, ks: Sequence[int], counted: DataFrame | None = None) -> DataFrame:
    """(k, vocabulary, cells) of rows (seq), and of k-mers that are ``counted`` (k, kmer, n: cells), in parts that add up.

    Tasks send the different words of CHUNK characters, packed, to the parts that words fall into, and a part holds its different words.
    """
    letters = frequent_letters(rows)

    def part(words: np.ndarray) -> np.ndarray:
        return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(PARTS)

    def packed(found):
        out = []
        for k, words, strings, cells in found:
            at = part(words).astype(np.uint8)
            order = np.argsort(at, kind="stable")
            edge = np.searchsorted(at[order], np.arange(PARTS + 1))
            words = words[order]
            out += [(k, p, 0, words[edge[p] : edge[p + 1]].tobytes(), None) for p in range(PARTS) if edge[p] < edge[p + 1]]
            some: dict[int, list[str]] = {}
            for x in strings:
                some.setdefault(zlib.crc32(x.encode("utf-8", "surrogatepass")) % PARTS, []).append(x)
            out += [(k, p, 0, None, x) for p, x in some.items()] + [(k, 0, cells, None, None)]
        types = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string())
        for a in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 64]), types)], names=["k", "part", "cells", "words", "strings"])

    def count(batches):
        words, seqs, chars = _Words(ks, letters), [], 0
        for b in batches:
            for s in b.column("seq").to_pylist():
                seqs.append(s)
                chars += len(s)
                if chars >= CHUNK:
                    yield from packed(words.see(seqs))
                    seqs, chars = [], 0
        if seqs:
            yield from packed(words.see(seqs))

    def known(batches):
        words = _Words(ks, letters)
        for b in batches:
            k, kmer, n = (np.array(b.column(c).to_pylist(), object) for c in ("k", "kmer", "n"))
            yield from packed((x, *words.sorted(x, set(kmer[k == x]), np.zeros(0, np.uint64)), int(n[k == x].sum())) for x in sorted(set(k)))

    def merge(batches):
        key, held, waiting, size, strings, cells = None, np.zeros(0, np.uint64), [], 0, set(), 0

        def total():
            n = len(_different(np.concatenate([held, *waiting]))) + len(strings)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([n], pa.int64()), pa.array([cells], pa.int64())], names=["k", "vocabulary", "cells"])

        for b in batches:
            for k, p, c, words, some in zip(*(b.column(x).to_pylist() for x in ("k", "part", "cells", "words", "strings"))):
                if (k, p) != key:
                    if key:
                        yield total()
                    key, held, waiting, size, strings, cells = (k, p), np.zeros(0, np.uint64), [], 0, set(), 0
                cells += c
                strings.update(some or ())
                if words:
                    waiting.append(np.frombuffer(words, np.uint64))
                    size += len(waiting[-1])
                    if size > max(1 << 20, len(held)):
                        held, waiting, size = _different(np.concatenate([held, *waiting])), [], 0
        if key:
            yield total()

    schema = "k int, part int, cells bigint, words binary, strings array<string>"
    sent = rows.select("seq").mapInArrow(count, schema)
    if counted is not None:
        sent = sent.unionByName(counted.select("k", "kmer", "n").mapInArrow(known, schema))
    sent = sent.repartitionById(PARTS, F.col("part")).sortWithinPartitions("part", "k")
    return sent.mapInArrow(merge, "k int, vocabulary bigint, cells bigint")


def _repeated(rows: DataFrame) -> DataFrame:
    """(i, l): identifiers and lengths that more than one of the rows (id, seq, len) have."""
    return materialize(rows.groupBy("id", "len").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("i"), F.col("len").alias("l")), "kmer-repeated")


def kmer_counts(df: DataFrame, id_col: str, seq_col: str, ks: Sequence[int]) -> DataFrame:
    """Rows (id, k, kmer, n, freq) for every k in one scan; shorter sequences have none.

    freq is n over the number of positions. A row is counted in its task. Only the counts of rows that share
    identifier and length are added up by a shuffle, keyed by (id, k, kmer); a look at identifiers and lengths finds whether there are any.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), F.length(seq_col).alias("len"))
    rows = rows.where(F.col("len") >= min(ks))
    cells = lambda r: _row_cells(r.select("id", "seq", "len", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("len >= k").select("id", "seq", "k"))
    again = _repeated(rows)
    if again.limit(1).count():
        same = F.col("id").eqNullSafe(F.col("i")) & (F.col("len") == F.col("l"))
        more = cells(rows.join(again, same, "left_semi")).groupBy("id", "k", "len", "kmer").agg(F.sum("n").alias("n"))
        counts = cells(rows.join(again, same, "left_anti")).unionByName(more)
    else:
        counts = cells(rows)
    return counts.select("id", "k", "kmer", "n", (F.col("n") / (F.col("len") - F.col("k") + 1)).alias("freq"))


#: Characters of the vectors of an Arrow batch, but for its last.
VECTOR_CHARS = 1 << 22


def kmer_vectors(df: DataFrame, id_col: str, seq_col: str, ks: Sequence[int]) -> DataFrame:
    """(id, length, n_distinct, n_kmers, vector, k) of every row: the sparse vector as ``kmer:count`` in the order of names.

    A row is counted and written in its task; nothing is shuffled, so rows that share an identifier stay apart.
    """
    names = ["id", "length", "n_distinct", "n_kmers", "vector", "k"]

    def run(batches):
        types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for b in batches:
            rows, chars = [], 0
            for i, seq in zip(b.column("id"), b.column("seq")):
                s = seq.as_py() or ""
                for k in ks:
                    found = sorted(Counter(s[j : j + k] for j in range(len(s) - k + 1)).items())
                    rows.append((i.as_py(), len(s), len(found), max(0, len(s) - k + 1), " ".join(f"{x}:{n}" for x, n in found), k))
                    chars += len(rows[-1][4])
                    if chars >= VECTOR_CHARS:
                        yield pack(rows)
                        rows, chars = [], 0
            if rows:
                yield pack(rows)

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(seq_col).alias("seq"))
    return rows.mapInArrow(run, "id bigint, length int, n_distinct bigint, n_kmers bigint, vector string, k int")


def kmer_maps(df: DataFrame, id_col: str, seq_col: str, ks: Sequence[int]) -> DataFrame:
    """Rows (id, k_size, kmer_vector): profiles as maps, for stores of documents."""
    c = kmer_counts(df, id_col, seq_col, ks)
    return c.groupBy("id", F.col("k").alias("k_size")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kmer", "freq")))).alias("kmer_vector"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """Column numbers of the k-mers of each k, in the order of names, from 0."""
    v = numbered(counts.select("k", "kmer").distinct(), F.col("k"), F.col("kmer"))
    first = v.groupBy("k").agg(F.min("number").alias("first"))
    return v.join(first, "k").select("k", "kmer", (F.col("number") - F.col("first")).cast("int").alias("col"))


def kmer_totals(df: DataFrame, seq_col: str, ks: Sequence[int]) -> DataFrame:
    """(k, kmer, n) over all sequences, counted on the map side with no identifier in the key."""
    rows = df.select(F.col(seq_col).alias("seq"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(F.length("seq") >= F.col("k"))
    return rows.select("k", F.explode(kmers(F.col("seq"), F.col("k"))).alias("kmer")).groupBy("k", "kmer").agg(F.count("*").alias("n"))


def first_seen_vocabulary(df: DataFrame, id_col: str, seq_col: str, k: int) -> DataFrame:
    """Column numbers by first appearance: rows in the order of identifiers, positions in order."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(kmers(F.col(seq_col), k)).alias("pos", "kmer"))
    first = rows.groupBy("kmer").agg(F.min(F.struct("id", "pos")).alias("at"))
    return numbered(first, F.col("at.id"), F.col("at.pos")).select("kmer", F.col("number").alias("col"))


def sparse_rows(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """The matrix in long form: (id, k, col, freq)."""
    return counts.join(vocab, ["k", "kmer"]).select("id", "k", "col", "freq")


def k_statistics(counts: DataFrame) -> DataFrame:
    """For each k: vocabulary, rows, nonzero cells and density of the matrix."""
    words = counts.groupBy("k", "kmer").agg(F.count("*").alias("n")).groupBy("k").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("cells"))
    rows = counts.groupBy("k", "id").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count("*").alias("rows"))
    s = words.join(rows, "k")
    return s.select("k", "vocabulary", "rows", "cells", F.round(F.col("cells") / (F.col("vocabulary") * F.col("rows")), 6).alias("density"))


def k_statistics_of(df: DataFrame, id_col: str, seq_col: str, ks: Sequence[int]) -> DataFrame:
    """The same of sequences. The different k-mers of a task's sequences are sorted out and their cells counted where rows lie, and only those k-mers are shuffled.

    Rows that share identifier and length count as ``kmer_counts`` gives them.
    """
    seqs = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), F.length(seq_col).alias("len")).where(F.col("len") >= min(ks))
    again = _repeated(seqs)
    if again.limit(1).count():
        same = F.col("id").eqNullSafe(F.col("i")) & (F.col("len") == F.col("l"))
        more = _row_cells(seqs.join(again, same, "left_semi").select("id", "seq", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(F.length("seq") >= F.col("k")))
        more = more.select("id", "k", "len", "kmer").distinct().groupBy("k", "kmer").agg(F.count("*").alias("n"))
        found = _word_statistics(seqs.join(again, same, "left_anti"), ks, more)
    else:
        found = _word_statistics(seqs, ks)
    words = found.groupBy("k").agg(F.sum("vocabulary").alias("vocabulary"), F.sum("cells").alias("cells"))
    rows = df.select(F.col(id_col).alias("id"), F.length(seq_col).alias("len")).distinct()
    rows = rows.select("id", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("len") >= k)).alias("k")).distinct().groupBy("k").agg(F.count("*").alias("rows"))
    s = words.join(rows, "k")
    return s.select("k", "vocabulary", "rows", "cells", F.round(F.col("cells") / (F.col("vocabulary") * F.col("rows")), 6).alias("density"))


def bounded_columns(cells: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(id, col, freq) with at most ``most`` columns: k-mers hashed to columns, frequencies in one added up.

    For products with a dense matrix of all columns, whose size this bounds.
    """
    return cells.groupBy("id", F.pmod(F.xxhash64("kmer"), F.lit(most)).alias("col")).agg(F.sum("freq").alias("freq"))
