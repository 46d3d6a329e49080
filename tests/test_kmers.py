"""k-mer tables against counting in Python."""

from collections import Counter

from kinfold.operators import kmers as km

ROWS = [(3, "abcabcab"), (1, "xyabc"), (2, "ab"), (5, ""), (4, None), (6, "éß漢éß漢é")]


def _counts(k):
    return {i: Counter(s[a : a + k] for a in range(len(s) - k + 1)) for i, s in ROWS if s and len(s) >= k}


def test_statistics_of_each_k(spark):
    d = spark.createDataFrame(ROWS, "id bigint, s string")
    got = {r["k"]: tuple(r)[1:] for r in km.k_statistics(km.kmer_counts(d, "id", "s", [2, 3, 5])).collect()}
    for k in (2, 3, 5):
        c = _counts(k)
        words, cells = len(set().union(*c.values())), sum(map(len, c.values()))
        assert got[k] == (words, len(c), cells, round(cells / (words * len(c)), 6))


def test_columns_by_first_appearance_and_the_matrix(spark):
    d = spark.createDataFrame(ROWS, "id bigint, s string").repartition(3)
    seen: dict[str, int] = {}
    for i, s in sorted(ROWS):
        for a in range(len(s or "") - 2):
            seen.setdefault(s[a : a + 3], len(seen))
    vocab = km.first_seen_vocabulary(d, "id", "s", 3)
    assert {r["kmer"]: r["col"] for r in vocab.collect()} == seen
    cells = km.sparse_rows(km.kmer_counts(d, "id", "s", [3]), vocab.selectExpr("3 as k", "kmer", "col")).collect()
    want = {(i, seen[w]): n / c.total() for i, c in _counts(3).items() for w, n in c.items()}
    assert {(r["id"], r["col"]): r["freq"] for r in cells} == want


def test_maps(spark):
    d = spark.createDataFrame(ROWS, "id bigint, s string")
    got = {(r["id"], r["k_size"]): r["kmer_vector"] for r in km.kmer_maps(d, "id", "s", [2, 3]).collect()}
    assert got == {(i, k): {w: n / c.total() for w, n in c.items()} for k in (2, 3) for i, c in _counts(k).items()}
