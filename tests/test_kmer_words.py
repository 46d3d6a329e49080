"""Statistics by k of words sorted out in tasks: cells aren't shuffled, and letters beyond a byte and k-mers beyond eight are taken too."""

import random

import pytest

from kinfold.operators import kmers as km


def _want(rows, ks):
    out = []
    for k in ks:
        cells = {(i, len(s), s[j : j + k]) for i, s in rows if s for j in range(len(s) - k + 1)}
        ids = {i for i, s in rows if s and len(s) >= k}
        if cells:
            out.append((k, len({c[2] for c in cells}), len(ids), len({(n, c) for n, c in enumerate(cells)}), round(len(cells) / (len({c[2] for c in cells}) * len(ids)), 6)))
    return sorted(out)


@pytest.mark.parametrize("chunk,letters", [(1 << 22, 256), (60, 6)])
def test_statistics_of_words(spark, monkeypatch, chunk, letters):
    monkeypatch.setattr(km, "CHUNK", chunk)
    monkeypatch.setattr(km, "LETTERS", letters)
    r = random.Random(4)
    kinds = ["ab", "abcé", "xyz\U0001f600", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))]
    rows = [(i, "".join(r.choice(kinds[i % 4] + "ab") for _ in range(r.randrange(0, 60)))) for i in range(80)] + [(5, s) for s in ("abab", "abac", "abc")] + [(90, None), (None, "zzz"), (None, "zza"), (91, "")]
    ks = [1, 2, 3, 8, 9]
    d = spark.createDataFrame(rows, "id bigint, s string")
    assert sorted(map(tuple, km.k_statistics_of(d, "id", "s", ks).collect())) == _want(rows, ks)


def test_words_are_sent_packed(spark):
    """A row for each part of the words of many sequences, and not one for each cell."""
    d = spark.createDataFrame([(i, f"abcabd{i}" * 30) for i in range(400)], "id bigint, seq string")
    plan = km._word_statistics(d, [3])._jdf.queryExecution().executedPlan().toString()
    assert "kmer" not in plan and "words" in plan
