"""The near-duplicate stage finds every pair of similarity 0.8 by five-word shingles."""

import random

import corpus_pipeline


def _set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_all_pairs(spark):
    r = random.Random(7)
    texts = []
    for _ in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([12, 60, 180, 400]))]
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for _ in range(r.randrange(1, 2 + len(words) // 40)):
                other[r.randrange(len(other))] = f"x{r.randrange(3000)}"
            texts.append(" ".join(other))
    sets, top = [_set(t) for t in texts], list(range(len(texts)))
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                near += 1
                x, y = top[i], top[j]
                top = [min(x, y) if t in (x, y) else t for t in top]
    assert near > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(x["doc_id"] for x in out.collect()) == sorted(set(top))
