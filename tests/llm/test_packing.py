"""Packing against the tokenizers library, and its plan against all subsets."""

import itertools
import random
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from kinfold.llm import packing
from kinfold.llm.packing import LibraryTokens, closest_fill, pack_documents, plan_windows, sequences
from kinfold.llm.queries import tokenizer_spec


def _library():
    t = Tokenizer.from_str(tokenizer_spec())
    t.no_truncation()
    t.no_padding()
    return t


def _check(rows, texts, window=2048):
    """Every identifier in one piece, with its digest; sequences gapless and without padding."""
    lib, by = _library(), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc, text in texts.items():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        got, at = sorted(by[doc], key=lambda r: r["start"]), 0
        for r in got:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r["length"]
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(bins) == list(range(len(bins)))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    assert sum(1 for m in bins.values() if sum(x for _, x in m) < window) <= 11


def test_documents_nulls_repeats_long_texts_and_clashing_columns(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghéßΣЖ'1,") for _ in range(r.randrange(1, 9)))
    texts = {i: " ".join(word() for _ in range(r.choice([0, 1, 40, 300, 900]))) for i in range(60)}
    texts |= {100: None, 101: "", 102: " \t\n", 103: "İstanbul ΟΔΟΣ \x1c é <|endoftext|> x<|startoftext|>y", 104: " ".join(word() for _ in range(30_000)), 105: "w" * 9000}
    for i in range(200, 230):
        texts[i] = "same words again"
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "1 as length", "2 as row", "3 as rank", "4 as number", "5 as start").repartition(5)
    rows = pack_documents(docs, tokenizer_spec()).collect()
    _check(rows, texts)
    key = lambda rs: sorted(tuple(x) for x in rs)
    assert key(rows) == key(pack_documents(docs.repartition(2), tokenizer_spec()).collect())
    kept = pack_documents(docs, tokenizer_spec(), keep_ids=True)
    for x in kept.collect():
        assert len(x["ids"]) == x["length"] and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x["ids"])) == x["ids_crc32"]
    whole = sequences(kept).collect()
    assert sum(len(x["ids"]) for x in whole) == sum(x["length"] for x in rows) and {i for x in whole for i in x["doc_ids"]} == set(texts)
    assert pack_documents(docs.limit(0), tokenizer_spec()).count() == 0


def test_repeated_rows_and_null_identifiers(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "d"), (1, "d"), (1, None)], "doc_id bigint, text string")
    rows = pack_documents(docs, tokenizer_spec()).collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == {None: 2, 1: 3}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_slices_of_a_long_text(monkeypatch):
    text = " ".join(str(i) for i in range(3000))
    monkeypatch.setattr(LibraryTokens, "SLICE", 100)
    tok = LibraryTokens(tokenizer_spec())
    assert b"".join(tok.blocks(text)) == b"".join(i.to_bytes(4, "little") for i in _library().encode(text, add_special_tokens=False).ids)
    tok.alone = False  # a file whose words are not independent
    assert len(list(tok.blocks(text))) == 1


def test_closest_fill_against_all_subsets():
    r = random.Random(3)
    for _ in range(200):
        left = dict(Counter(r.randrange(1, 40) for _ in range(r.randrange(1, 9))))
        first = max(left)
        rest = list((Counter(left) - Counter([first])).elements())
        room = r.randrange(first, 120)
        best = max(first + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if first + sum(c) <= room)
        take = closest_fill(left, room, first)
        assert sum(k * n for k, n in take.items()) == best and take[first] >= 1 and all(left[k] >= n for k, n in take.items())


@pytest.mark.parametrize("counts", [{}, {1: 10**9}, {1500: 1000}, {2047: 3}, {1025: 99, 3: 7}, {k: 3 for k in range(1, 2049)}, {2048: 5}, {1500: 1}])
def test_plan_places_every_rank_once(counts):
    placements, cuts = plan_windows(counts)
    spans: dict[int, list] = {}
    for length, first, last, _, each, offset in placements:
        spans.setdefault(length, []).append((first, last))
        assert (last - first) % each == 0 and offset + each * length <= 2048
    for length, first, last, shifts, sizes, bases in cuts:
        spans.setdefault(length, []).append((first, last))
        assert sum(sizes) == length and shifts == [sum(sizes[:i]) for i in range(len(sizes))]
    given = Counter(counts)
    for _, first, last, _, sizes, _ in cuts:
        for s in sizes:
            given[s] += last - first
    for length, found in spans.items():
        at = 0
        for first, last in sorted(found):
            assert first == at
            at = last
        assert at == given[length]
    assert sum(n for n in given.values() if n) == sum(last - first for s in spans.values() for first, last in s)


def test_window_must_be_a_power_of_two():
    with pytest.raises(ValueError):
        packing.plan_windows({3: 1}, 1000)


def test_added_tokens_with_other_beginnings():
    import json

    from kinfold.llm.bpe import WordTokenizer

    spec = json.loads(tokenizer_spec())
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 49408, "content": "[BOX]"})
    text = json.dumps(spec)
    lib = Tokenizer.from_str(text)
    for t in ("abc [BOX] def", "x[BOX]y<|endoftext|>", "no such"):
        want = lib.encode(t, add_special_tokens=False).ids
        assert WordTokenizer(text).encode(t) == want
        assert LibraryTokens(text).encode([t]) == [b"".join(i.to_bytes(4, "little") for i in want)]
