"""The operators against brute force, on small tables with nulls, repeats, ties and odd texts."""

from __future__ import annotations

import random
from collections import Counter
from functools import cache
from hashlib import sha256

import numpy as np
import pytest
import regex
import xxhash

from kinfold.llm import bpe, line_dedup, simhash
from kinfold.llm.exact_dedup import PatriciaTrie, patricia_owners
from kinfold.llm.language_id import LanguageFilters, _blocks, fit_filters, identify_languages
from kinfold.llm.line_dedup import UNITS, dedup_lines, line_decisions
from kinfold.llm.mixing import mix_sources
from kinfold.llm.pii import PATTERN, pseudonymize
from kinfold.llm.quality_mil import GatedMIL, fit_quality, score_quality
from kinfold.llm.quality_rules import RULES, ablations, ledger, measures, passes, policy_mask
from kinfold.llm.queries import tokenizer_spec
from kinfold.llm.substring_dedup import remove_repeats
from pyspark.sql import functions as F

WS = r"[^\x20\x09-\x0D]+"
rng = random.Random(5)


def words(n, vocab=400):
    return [f"w{rng.randrange(vocab)}x" for _ in range(n)]


@cache
def corpus():
    base = [" ".join(words(n)) for n in (3, 20, 60, 120, 200, 300)]
    shared = " ".join(words(70))
    texts = [*base, base[3], base[3], base[4] + " end", shared, "x " + shared + " y", " ".join(words(30)) + " " + shared, base[5].replace("w1", "q1"), None, "", "  \n\t", "ñandú\nñandú", base[0].upper()]
    texts += [" ".join(words(20)) + " " + " ".join(base[5].split()[i : i + 90]) for i in range(0, 200, 40)]
    rows = [(i + 1, t, ["a", "b", None][i % 3], "en" if i % 2 else "de") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base[2], "a", None)]


DDL = "doc_id bigint, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns that operators use as names of their own
    return spark.createDataFrame(corpus(), DDL).selectExpr("*", "1 as tag", "2 as size", "'z' as fp", "3 as n").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_trie_spills_and_keeps_owners():
    trie, want = PatriciaTrie(budget=3000), {}
    for i in range(600):
        key = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
        trie.insert(key, i)
        n = want.get(key, (i, 0))
        want[key] = (n[0], n[1] + 1)
    assert trie.held < 10**6 and {k: (o, c) for k, o, c in trie.items()} == want


def test_exact_dedup(docs, empty):
    rows = corpus()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    got = patricia_owners(docs, largest=True).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        ids = groups[texts[r["doc_id"]]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
        assert r["text_sha256"] == sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert patricia_owners(empty).count() == 0


def test_simhash(docs, empty):
    rows, fps = corpus(), {}
    for i, t, *_ in rows:
        w = regex.findall(WS, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[a] != comp[b]:
                    low = min((x for x in (comp[a], comp[b]) if x is not None), default=None)
                    comp[a] = comp[b] = low
                    changed = True
    for r in simhash.simhash_components(docs).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", comp[r["doc_id"]])
    assert simhash.simhash_components(empty).count() == 0


def test_hot_buckets_give_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    base, fps = rng.getrandbits(64), set()
    for _ in range(150):
        x = base
        for b in rng.sample(range(64), rng.randrange(4)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()

    def roots(pairs):
        up = {x: x for x in signed}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in signed}

    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert roots([(r[0], r[1]) for r in links]) == roots(every) and len(links) < len(every)


def test_substring_dedup(docs, empty):
    rows = corpus()
    ws = [(i, regex.findall(WS, t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in ws:
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    want = []
    for i, w in ws:
        gone = set()
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in remove_repeats(docs, digest=True).collect()]
    assert Counter(got) == Counter(want) and sum(w[2] for w in want) > 200
    assert remove_repeats(empty).count() == 0


def test_rules(docs, empty):
    for t in [c[1] for c in corpus()] + ["a b c d e f g h " * 5, "x\ny\nx\n \n x"]:
        w = regex.findall(WS, t or "")
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        rep = {j + o for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for o in range(8)}
        lines = Counter(x for x in (t or "").split("\n") if regex.search(WS, x))
        m = measures(t)
        assert m[:5] == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), sum(lines.values()) - len(lines), len(rep))
    rows = ledger(docs)
    assert rows.count() == len(corpus()) and ledger(empty).count() == 0
    kept = rows.where(passes(F.col("failures"), "v2")).count()
    table = ablations(rows, "v2").collect()
    assert {r["kept"] for r in table} == {kept} and len(table) == len(RULES) and policy_mask("base") == 3
    assert all(r["kept_without"] == kept + r["fails_alone"] for r in table)


def test_mixing(docs, empty):
    got = mix_sources(docs).collect()
    rows = corpus()
    size = {s: sum(len(regex.findall(WS, t or "")) for _, t, x, _ in rows if x == s) for s in ("a", "b", None)}
    weight, total = {"a": 3.0, "b": 1.0, None: 2.0}, 1.5 * sum(size.values())
    target, capped = {}, set()
    while True:
        level = (total - sum(2 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in size if level * weight[s] >= 2 * size[s]} | capped
        if more == capped:
            break
        capped = more
    target = {s: min(2.0 * size[s], level * weight[s]) for s in size}
    taken = Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))
    assert mix_sources(empty).count() == 0


def test_bpe_equals_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    spec = tokenizer_spec()
    lib, own = tokenizers.Tokenizer.from_str(spec), bpe.WordTokenizer(spec)
    parts = ["a", "th", "ing", "'s", "'", "!!", "É", "é", "Σ", "中", "12", " ", "\n", "\x1c", "\x85", "<|endoftext|>", "<|", "🙂", "ß", "aeiou" * 9]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    long = "".join(rng.choice("abcde") for _ in range(30_000))
    assert own.encode(long) == lib.encode(long, add_special_tokens=False).ids
    rows = bpe.bpe_digests(docs, spec).collect()
    text = {i: t or "" for i, t, *_ in corpus()}
    for r in rows:
        ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, spec), spec, as_bytes=True)
    assert back.count() == len(corpus()) and bpe.bpe_digests(empty, spec).count() == 0
    m = bpe.Utf8Machine()
    raw = "aé中🙂".encode() + b"\xff\xe4"
    assert "".join(m.feed(raw[i : i + 1]) for i in range(len(raw))) + m.finish() == raw.decode("utf-8", "replace")


def test_language_filters(spark, docs, empty):
    text = "Über ' die e\n" + "abc def " * 40
    grams = sum(len(h) for _, h in _blocks([text, text], (3, 4)))
    assert grams == 2 * sum(len(h) for _, h in _blocks([text], (3, 4)))
    rows = [(i, "the quick and the lazy thing " * 3 if i % 2 else "der schnelle und die faule sache " * 3, "s", "en" if i % 2 else "de") for i in range(60)]
    train = spark.createDataFrame(rows + [(99, None, "s", "en"), (98, "x", "s", None)], DDL)
    f = fit_filters(train, F.lit(True))
    assert f.langs == ["de", "en"] and (f.false_positives() < 0.1).all()
    test = spark.createDataFrame([(1, "und die sache", "", ""), (2, "and the thing", "", ""), (3, None, "", ""), (4, "12 !!", "", ""), (5, "中文中文", "", "")], DDL)
    got = by_id(identify_languages(test, f))
    assert [got[i]["lang_pred"] for i in range(1, 5)] == ["de", "en", "und", "und"] and got[5]["lang_pred"] in f.langs and got[5]["score"] == 0
    assert identify_languages(docs, f).count() == len(corpus()) and identify_languages(empty, f).count() == 0
    none = fit_filters(empty, F.lit(True))
    assert isinstance(none, LanguageFilters) and none.predict(["text"])[0][0] == "und"


def test_quality_learns_and_gradient_is_right(spark, docs, empty):
    good = [(i, " ".join(words(80)), "", "") for i in range(60)]
    bad = [(100 + i, " ".join(w + "$$$" for w in words(80)), "", "") for i in range(60)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good + bad] + [(5, 0, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    d = spark.createDataFrame(good + bad, DDL)
    model = fit_quality(d, labels, F.col("doc_id") % 3 != 1)
    got = by_id(score_quality(d, model))
    assert all(got[i]["predicted"] == (i < 100) for i in got)
    out = score_quality(docs, model).collect()
    assert len(out) == len(corpus()) and all(0 <= r["score"] <= 1 for r in out) and score_quality(empty, model).count() == 0
    assert fit_quality(empty, labels, F.lit(True)) is not None
    m = GatedMIL.new(width=5, hidden=4, gate=3)
    for k in m.NAMES:
        setattr(m, k, getattr(m, k).astype(float))
    x, s, y, w = np.random.default_rng(0).standard_normal((6, 5)), np.array([0, 2, 3]), np.array([1.0, 0, 1]), np.ones(3)
    loss = lambda: float(-np.mean(y * np.log(m.forward(x, s)[0]) + (1 - y) * np.log(1 - m.forward(x, s)[0])))
    g = m.gradients(x, s, y, w)
    for k in m.NAMES:
        v = getattr(m, k)
        i = np.unravel_index(0, v.shape)
        v[i] += 1e-5
        up = loss()
        v[i] -= 2e-5
        down = loss()
        v[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-4


def test_lines(spark, empty):
    base = words(30, 10_000)
    near = base[:14] + ["changed"] + base[15:]
    rows = [(1, "Hello there\n" + " ".join(base)), (2, " ".join(near) + "\nown line " + " ".join(words(12, 10**6))), (3, "HELLO, there!\n\nother"), (4, None), (5, ""), (1, "a second text of one id")]
    d = spark.createDataFrame([(i, t, "", "") for i, t in rows], DDL)
    got = {(r["doc_id"], r["n_lines"]): r for r in dedup_lines(d).collect()}
    assert got[3, 3]["kept_text"] == "\nother" and got[4, 0]["kept_text"] is None and got[5, 1]["kept_text"] == ""
    assert got[1, 2]["n_removed"] == 0 and got[1, 1]["n_removed"] == 0
    assert {r["doc_id"]: r["removed"] for r in line_decisions(d).collect()}[3] == [0]
    assert dedup_lines(empty).count() == 0


def test_long_line_and_clashing_columns(spark):
    long = " ".join(words(20_000, 10**7))
    rows = [(1, long), (2, long.replace("w1", "q1", 40) + " more"), (3, "z" * 70_000), (4, "z" * 70_000 + "y"), (None, long), (7, "own"), (7, "own")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as tag", "2 as h", "3 as key", "'x' as norm", "4 as gone")
    got = Counter((r["doc_id"], r["n_removed"]) for r in dedup_lines(d).collect())
    assert got == Counter({(1, 0): 1, (2, 1): 1, (3, 0): 1, (4, 1): 1, (None, 1): 1, (7, 0): 2})


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_blocks_of_similar_lines(spark):
    """Lines share a key after an insertion, a removal or a change, in scripts with and without spaces."""
    pairs = []
    for n in (2, 3, 7, 16, 40, 200):
        w = words(n, 10**6)
        at = n // 2
        pairs += [(" ".join(w), " ".join(x)) for x in (w[:at] + ["new"] + w[at:], w[:at] + ["new"] + w[at + 1 :], w[:at] + w[at + 1 :])]
    pairs += [("ж" * 3 + "абвгдежзиклмн", "ж" * 3 + "абвгдежзиклм"), ("漢字仮名交文日本語学", "漢字仮名交文日本語")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    keys = rows.select("i", line_dedup.block_keys(F.col("a")).alias("x"), line_dedup.block_keys(F.col("b")).alias("y"))
    assert {r["i"] for r in keys.where(F.size(F.array_intersect("x", "y")) == 0).collect()} == set()
    assert keys.agg(F.max(F.size("x"))).first()[0] < 200


@pytest.mark.parametrize("hot", [64, 2])
def test_fuzzy_lines_against_all_pairs(spark, monkeypatch, hot):
    """Groups and removed lines from the edit similarity of every pair of lines, in crowded blocks and in others."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(11)
    base = [[f"w{r.randrange(9999)}" if r.random() < 0.9 else f"longerwords{r.randrange(99)}" for _ in range(n)] for n in (60, 60, 80, 12, 5)]
    lines = []
    for b in base:
        for _ in range(5):
            c = list(b)
            for _ in range(r.randrange(3)):
                c[r.randrange(len(c))] = f"x{r.randrange(99)}"
            lines.append(" ".join(c))
    lines += ["", "--", "same", "Same!", lines[0].upper(), lines[3] + " end", "İİ İ" + " i" * 5, "chapter 11", "Chapter 12", "an address of 40 rows", "an address of 41 rows"]
    r.shuffle(lines)
    docs = [(i + 1, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4)] + [(None, lines[0] + "\n" + lines[1]), (90, None)]
    d = spark.createDataFrame([(i, t, "", "") for i, t in docs], DDL).repartition(3)
    got = {x["doc_id"]: x["removed"] for x in line_decisions(d).collect()}
    norms = {(i, no): " ".join(regex.findall(r"[\p{L}\p{N}]+", t.lower())) for i, whole in docs if whole for no, t in enumerate(whole.split("\n"))}
    places = sorted((k for k in norms if norms[k]), key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    lines = spark.createDataFrame([(n, norms[k]) for n, k in enumerate(places)], "h bigint, norm string")
    prints = {x["h"]: x["fp"] & (1 << 64) - 1 for x in line_dedup.line_prints(lines).collect()}
    for n, k in enumerate(places):
        units = set(norms[k].split() if norms[k].count(" ") >= UNITS - 1 else norms[k])
        sums = [0] * 64
        for w in units:
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            sums = [c + (h >> i & 1) for i, c in enumerate(sums)]
        assert prints[n] == sum(1 << i for i, c in enumerate(sums) if 2 * c > len(units))
    parent = {k: k for k in places}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    fuzzy = 0
    for n, b in enumerate(places):
        for a in places[:n]:
            x, y = norms[a], norms[b]
            if x == y or edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                fuzzy += x != y
                ra, rb = sorted((root(a), root(b)), key=places.index)
                parent[rb] = ra
    want = {i: [] for i, _ in docs}
    for k in places:
        if root(k) != k:
            want[k[0]].append(k[1])
    found, all_of = sum(map(len, got.values())), sum(map(len, want.values()))
    assert fuzzy > 5 and all(set(got[i]) <= set(v) for i, v in want.items()) and found >= 0.9 * all_of


def test_surrogates(spark, empty):
    t1 = "Write to Anna.Berg@mail.example.com or +1 (974) 555-3436, card 4845168114407329, ip 10.20.30.40; Mrs. Helen Park"
    t2 = 'anna.berg@mail.example.com and otto@x.org TOKEN = "2ABC3FF2CA8FB1E4C565A0EB63815530A948BDDE" Mr. Paul Stone'
    d = spark.createDataFrame([(1, t1, "", ""), (2, t2, "", ""), (3, "clean text, version 2.0", "", ""), (4, None, "", ""), (None, t2, "", ""), (2, t2, "", "")], DDL)
    out = pseudonymize(d, "key").collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and got[3]["text"] == "clean text, version 2.0" and got[4]["text"] is None
    for t, i in ((t1, 1), (t2, 2)):
        for e in regex.findall(PATTERN, t):
            assert e not in got[i]["text"], e
    mails = [regex.findall(r"\S+@\S+", got[i]["text"]) for i in (1, 2)]
    assert mails[0][0].lower() == mails[1][0] != mails[1][1] and mails[0][0][0].isupper()
    card = regex.search(r"card (\d{16})", got[1]["text"])[1]
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert regex.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1]["text"]) and regex.search("Mrs. [A-Z][a-z]+ [A-Z][a-z]+k", got[1]["text"])
    assert regex.search('TOKEN = "[0-9A-F]{40}"', got[2]["text"]) and pseudonymize(empty, "key").count() == 0
