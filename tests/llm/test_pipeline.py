import corpus_pipeline
from kinfold.llm.bpe import WordTokenizer
from kinfold.llm.mixing import mix_sources
from kinfold.llm.queries import tokenizer_spec
from kinfold.llm.simhash import fingerprint

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    cols, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, docs, DIR)
    assert good.columns == cols and 0 < good.count() < docs.count()
    good_rows = {r["doc_id"]: r["text"] for r in good.collect()}
    exact = steps["exact_dedup"](spark, good, DIR)
    last = {t: max(i for i, x in good_rows.items() if x == t) for t in good_rows.values()}
    assert {r["doc_id"] for r in exact.collect()} == set(last.values())
    near = steps["near_dedup"](spark, exact, DIR)
    left = {r["doc_id"]: fingerprint(r["text"]) for r in near.collect()}
    assert all((a ^ b).bit_count() > 3 for i, a in left.items() for j, b in left.items() if i < j)
    mixed = steps["mix"](spark, near, DIR)
    plan = {r["doc_id"]: r for r in mix_sources(near).collect()}
    words: dict = {}
    for r in mixed.collect():
        n = len(r["text"].split())
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + n
        assert r["n_chars"] == len(r["text"]) and (r["text"] == seen[r["doc_id"]] or n < plan[r["doc_id"]]["size"])
    assert all(words.get(i, 0) == p["taken"] for i, p in plan.items())
    out = steps["tokens"](spark, mixed, DIR).collect()
    tok = WordTokenizer(tokenizer_spec())
    assert len(out) == mixed.count() and {r["n_tokens"] for r in out} <= {len(tok.encode(r["text"])) for r in mixed.collect()}
