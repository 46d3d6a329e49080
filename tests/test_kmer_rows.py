"""k-mers counted in their rows, against rows that share identifiers, and without a shuffle of cells."""

from collections import Counter

from kinfold.operators import kmers as km


def test_rows_that_share_identifier_and_length_are_added_up(spark):
    rows = [(1, "abab"), (1, "abac"), (1, "abc"), (None, "zzz"), (None, "zza"), (2, "\U0001f600\U0001f600é"), (3, "x"), (4, None)]
    d = spark.createDataFrame(rows, "id bigint, s string")
    want = Counter()
    for i, s in rows:
        for k in (2, 3):
            for j in range(len(s or "") - k + 1):
                want[i, k, len(s), s[j : j + k]] += 1
    got = km.kmer_counts(d, "id", "s", [2, 3]).collect()
    assert sorted((str(r["id"]), r["k"], r["kmer"], r["n"], round(r["freq"], 9)) for r in got) == sorted((str(i), k, x, n, round(n / (m - k + 1), 9)) for (i, k, m, x), n in want.items())
    a, b = (sorted(map(tuple, x.collect())) for x in (km.k_statistics(km.kmer_counts(d, "id", "s", [2, 3, 5])), km.k_statistics_of(d, "id", "s", [2, 3, 5])))
    assert a == b and len(a) == 2


def test_cells_of_rows_with_identifiers_of_their_own_are_not_shuffled(spark):
    d = spark.createDataFrame([(i, "abcabd" * 3) for i in range(20)], "id bigint, s string")
    assert "Exchange" not in km.kmer_counts(d, "id", "s", [3])._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_written_in_their_rows(spark):
    d = spark.createDataFrame([(1, "ABAB"), (2, "A"), (3, "")], "id bigint, s string")
    out = km.kmer_vectors(d, "id", "s", [2, 3])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["k"]): tuple(r)[1:5] for r in out.collect()}
    assert got == {(1, 2): (4, 2, 3, "AB:2 BA:1"), (1, 3): (4, 2, 2, "ABA:1 BAB:1"), (2, 2): (1, 0, 0, ""), (2, 3): (1, 0, 0, ""), (3, 2): (0, 0, 0, ""), (3, 3): (0, 0, 0, "")}
