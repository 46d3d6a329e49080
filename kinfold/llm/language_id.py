"""Operator 1, language ID: bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm.arrow import packed, schema_of, spark_ddl
from kinfold.plans.tables import materialize

#: Code points of one block; texts longer than a block are cut into overlapping pieces.
BLOCK = 1 << 19

_OUT = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_grams", pa.int64())]
_GRAMS = [("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]


@cache
def _letters() -> np.ndarray:
    """Code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _blocks(texts: Sequence[str], orders: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of each gram, hash of each gram) that cover all grams of all texts once.

    A gram is a run of n characters whose inner ones are letters and whose ends are
    letters or a word's edge, at least one being a letter; case is ignored.
    """
    reach = max(orders) - 1
    cut = [(i, s, min(s + BLOCK, len(t) + 2)) for i, t in enumerate(texts) for s in range(0, len(t) + 2, BLOCK)]
    letters = _letters()
    for a, b in packed([e - s for _, s, e in cut], BLOCK):
        parts, rows, own = [], [], []
        for i, s, e in cut[a:b]:
            padded = " " + texts[i] + " " if s == 0 and e + reach >= len(texts[i]) + 2 else (" " + texts[i] + " ")[s : e + reach]
            piece = padded.lower()
            piece = piece if len(piece) == len(padded) else "".join(c.lower()[0] for c in padded)
            parts.append(piece + " " * reach)
            n = len(piece) + reach
            rows.append(np.full(n, i, np.int32))
            k = np.zeros(n, bool)
            k[: e - s] = True
            own.append(k)
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        row, keep = np.concatenate(rows), np.concatenate(own)
        letter = letters[codes]
        c = np.where(letter, codes, 0).astype(np.uint64)
        for n in orders:
            m = len(c) - n + 1
            if m < 1:
                continue
            ok = keep[:m].copy()
            for j in range(1, n - 1):
                ok &= letter[j : m + j]
            ok &= (letter[:m] | letter[n - 1 : m + n - 1]) & (row[:m] == row[n - 1 : m + n - 1])
            at = np.flatnonzero(ok)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + c[at + j] + np.uint64(1)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            yield row[at], h


@dataclass
class LanguageFilters:
    """Bloom filters of all languages, sliced by bit: slot s holds in bit l whether the
    filter of language l has s set, so that one gather answers for all languages."""

    langs: list[str]
    slots: np.ndarray  # (size, words) of uint64, size a power of two
    n_hashes: int
    orders: tuple[int, ...]
    priors: list[int]

    @classmethod
    def build(cls, langs: list[str], grams: np.ndarray, owner: np.ndarray, orders, priors, n_hashes: int = 3, bits_per_gram: int = 12) -> LanguageFilters:
        per = max([1, *np.bincount(owner, minlength=len(langs)).tolist()])
        size = 1 << max(10, int(per * bits_per_gram - 1).bit_length())
        self = cls(langs, np.zeros((size, max(1, (len(langs) + 63) // 64)), np.uint64), n_hashes, tuple(orders), priors)
        for at in self._places(grams.view(np.uint64)):
            np.bitwise_or.at(self.slots, (at, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))
        return self

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(self.n_hashes):
            yield ((h + np.uint64(k) * step) & mask).astype(np.int64)

    def containing(self, h: np.ndarray) -> np.ndarray:
        """The bit mask of languages whose filter contains each gram."""
        out = None
        for at in self._places(h):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def false_positives(self) -> np.ndarray:
        """For each language, the chance that a gram it lacks answers yes."""
        fill = np.array([np.count_nonzero(self.slots[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) for i in range(len(self.langs))]) / len(self.slots)
        return fill**self.n_hashes

    def votes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each text, and of these the count in each language."""
        total = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(self.langs)), np.int64)
        for row, h in _blocks(texts, self.orders):
            total += np.bincount(row, minlength=len(texts))
            masks = self.containing(h)
            for i in range(len(self.langs)):
                yes = (masks[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)
                hits[:, i] += np.bincount(row[yes.view(np.int64) == 1], minlength=len(texts))
        return total, hits

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, grams) for each text; ``und``, 0 for null and texts without a letter."""
        fpr = self.false_positives()
        total, hits = self.votes([t or "" for t in texts])
        true = np.maximum(0, hits - total[:, None] * fpr) / (1 - np.minimum(fpr, 0.999))
        out = []
        default = int(np.argmax(self.priors)) if self.langs else -1
        for t, n, v in zip(texts, total.tolist(), true):
            if default < 0 or not t or not any(c.isalpha() for c in t):
                out.append(("und", 0.0, n))
                continue
            best, s = int(np.argmax(v)), float(v.sum())
            out.append((self.langs[best], float(v[best]) / s, n) if s > 0 else (self.langs[default], 0.0, n))
        return out


def _count_grams(batches, orders):
    """Gram counts of a partition's rows (lang, text)."""
    for b in batches:
        lang, text = b.column(0).to_pylist(), b.column(1).to_pylist()
        for name in dict.fromkeys(lang):
            own = [t for t, x in zip(text, lang) if x == name and t]
            got: list[np.ndarray] = []
            for a, z in packed([len(t) for t in own], 1 << 22):
                keys, n = np.unique(np.concatenate([h for _, h in _blocks(own[a:z], orders)] or [np.zeros(0, np.uint64)]), return_counts=True)
                got.append((keys, n))
            for keys, n in got:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema_of(_GRAMS))


def fit_filters(docs: DataFrame, trainable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 1500, orders: Sequence[int] = (3, 4), min_rate: float = 2e-5, share: float = 0.5) -> LanguageFilters:
    """Learn the filters from the rows that ``trainable`` admits and whose language is known.

    Of each language about ``sample_docs`` documents (all, if it has fewer), chosen by a
    hash of the identifier, are counted whole. A filter takes a gram whose rate in the
    language is at least ``min_rate`` and ``share`` of its highest rate in any language.
    Rates bound the filters: a language has at most 1/min_rate grams of each order, so
    what reaches the driver and is broadcast doesn't grow with the corpus.
    """
    known = docs.where(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(lang_col).collect()}
    if not sizes:
        return LanguageFilters.build([], np.zeros(0, np.int64), np.zeros(0, np.int64), orders, [])
    langs = sorted(sizes)
    u = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n))]), F.col(lang_col))
    counts = known.where(u < limit).select(lang_col, text_col).mapInArrow(lambda it: _count_grams(it, orders), spark_ddl(_GRAMS))
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "lang-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("rate"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rates.join(best, "gram").where((F.col("rate") >= min_rate) & (F.col("rate") >= share * F.col("best")) & (F.col("n") >= 2)).select("lang", "gram").toPandas()
    owner = kept["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy(np.int64)
    return LanguageFilters.build(langs, kept["gram"].to_numpy(np.int64), owner, orders, [sizes[x] for x in langs])


def identify_languages(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, lang_pred, score, n_grams)`` for each document, from whole texts.

    ``score`` is the winner's part of all corrected counts. Null texts and texts without
    a letter are ``und`` with score 0; a text whose letters match no filter gets the
    commonest language with score 0; a tie goes to the first language by name. Rows are
    judged alone. With no learned language everything is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        model = shared.value
        for b in batches:
            rows = model.predict(b.column(1).to_pylist())
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, (_, t) in zip(cols, _OUT[1:])]], schema=schema_of(_OUT))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, spark_ddl(_OUT))
