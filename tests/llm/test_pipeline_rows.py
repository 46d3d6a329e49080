"""The dedup stages drop rows, not identifiers."""

import random

import corpus_pipeline


def test_rows_that_share_an_identifier(spark):
    r = random.Random(4)
    a, b, c, d, e = (" ".join(f"w{r.randrange(9999)}" for _ in range(60)) for _ in range(5))
    near = " ".join(f"w{r.randrange(9999)}" for _ in range(900))
    rows = [(1, a), (9, a), (None, a), (None, b), (None, c), (None, c), (2, a), (2, d), (7, e), (7, e), (8, near), (None, near + " end"), (5, near + " end"), (6, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, source string, n_chars int").repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted(((x["doc_id"], x["text"] or "") for x in df.collect()), key=str)
    exact = steps["exact_dedup"](spark, docs, "")
    assert exact.columns == docs.columns
    assert key(exact) == sorted([(9, a), (None, b), (None, c), (2, d), (7, e), (8, near), (5, near + " end"), (6, "")], key=str)
    out = steps["near_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    assert key(out) == sorted([(1, a), (None, b), (None, c), (2, d), (7, e), (5, near + " end"), (6, "")], key=str)


def test_nulls_clashing_columns_and_empty_tables(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(9999)}" for _ in range(n)) for n in (60, 90, 30, 400, 1)]
    rows = [(i, t, s) for i, t, s in zip((1, 2, None, 4, 4), texts, ("a", "a", "b", None, "b"))] + [(9, None, "a"), (10, "", None), (11, "  ", "a")]
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, source string, n_chars int")
    docs = docs.selectExpr("*", "1 as size", "'k' as key", "7 as words", "2 as whole", "3 as extra", "4 as tag", "5 as n", "'s' as sha", "6 as vid", "array(1) as items")
    for name in ("exact_dedup", "near_dedup", "mix"):
        stage = dict(corpus_pipeline.STAGES)[name]
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0
        got = out.collect()
        assert all((x["size"], x["key"], x["words"], x["whole"], x["items"]) == (1, "k", 7, 2, [1]) for x in got)
        if name != "mix":
            assert {x["doc_id"] for x in got} >= {1, 2, None, 4} and sum(not (x["text"] or "").strip() for x in got) <= 2
    # a text is taken whole, or cut at a word; each source's words come near its target
    for x in got:
        assert x["text"] is None or any(t is not None and (x["text"] == t or t.split()[: len(x["text"].split())] == x["text"].split()) for _, t, _ in rows)
