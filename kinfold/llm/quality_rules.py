"""Operator 6, quality rules: a ledger of failure bits and measurements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm.arrow import schema_of, spark_ddl

#: The characters that separate words, and those that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")

#: Bit k of the ledger is rule k: a name and a condition that fails the document.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("repeated_lines", "n_dup_lines > 3 and 100 * n_dup_lines > 40 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("capitals", "100 * n_upper > 50 * word_chars"),
    ("exclaims", "10 * n_exclaims > 3 * n_words and n_exclaims > 10"),
]

#: A policy's version names the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals", "exclaims"),
}

_OUT = [("doc_id", pa.int64()), *[(m, pa.int64()) for m in MEASURES]]


def repeated_window_words(words: Sequence[bytes], width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Rolling hashes screen; windows whose hash repeats are then compared in full.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for i in range(width):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    w ^= w >> np.uint64(29)
    order = np.argsort(w, kind="stable")
    s = w[order]
    twin = np.zeros(n, bool)
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    seen: dict[tuple, list] = {}
    for i in np.flatnonzero(twin).tolist():
        key = tuple(words[i : i + width])
        if key in seen:
            seen[key].append(i)
        else:
            seen[key] = [i]
    mark = np.zeros(len(words) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            a = np.array(at)
            np.add.at(mark, a, 1)
            np.add.at(mark, a + width, -1)
    return int(np.count_nonzero(np.cumsum(mark)))


def measures(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text; null measures as empty."""
    text = text or ""
    words = text.encode().split()
    lines, dup, seen = 0, 0, set()
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    upper = int(_upper()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].sum())
    return len(words), word_chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_window_words(words), lines, upper, text.count("!")


@cache
def _upper() -> np.ndarray:
    """Whether each code point is a capital letter."""
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


def _measured(batches):
    for b in batches:
        rows = [measures(t) for t in b.column(1).to_pylist()]
        cols = list(zip(*rows)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], schema=schema_of(_OUT))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: identifier, MEASURES and ``failures``, a bit for each rule.

    Every rule is evaluated once, whatever policies are applied later. Null texts
    measure as empty ones. Rows are judged alone, so repeated and null identifiers pass
    through; other columns are not read.
    """
    m = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measured, spark_ddl(_OUT))
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, cond) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return m.withColumn("failures", total.cast("bigint"))


def policy_mask(policy: str | Sequence[str], policies: Mapping[str, Sequence[str]] = POLICIES) -> int:
    names = policies[policy] if isinstance(policy, str) else policy
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in names)


def passes(failures: Column, policy: str | Sequence[str]) -> Column:
    """Whether a ledger row passes a policy."""
    return failures.bitwiseAND(F.lit(policy_mask(policy)).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: str | Sequence[str]) -> DataFrame:
    """For each rule of a policy: rows it fails, rows it alone fails, rows kept without it.

    One bitwise aggregation over the ledger; the texts are not read again.
    """
    mask = policy_mask(policy)
    hit = F.col("failures").bitwiseAND(F.lit(mask).cast("bigint"))
    own = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    cells = [F.struct(F.lit(name).alias("rule"), F.count_if(hit.bitwiseAND(F.lit(bit).cast("bigint")) != 0).alias("fails"), F.count_if(hit == bit).alias("fails_alone"), F.count_if(hit.bitwiseAND(F.lit(mask & ~bit).cast("bigint")) == 0).alias("kept_without")) for name, bit in own]
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(hit == 0).alias("kept"), F.array(*cells).alias("c")).select("n_rows", "kept", F.inline("c"))
