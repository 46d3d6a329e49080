"""Operator 3, quality classifier: attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.llm.arrow import packed, release_worker_cache, schema_of, spark_ddl

PASSAGE_WORDS = 64
BLOCK = 1 << 19
N_CLASSES = 16
N_EXTRA = 6
WIDTH = N_CLASSES * N_CLASSES + N_CLASSES + N_EXTRA

_OUT = [("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int64())]
_BAGS = [("key", pa.int64()), ("label", pa.int32()), ("n", pa.int32()), ("features", pa.binary())]


@cache
def _classes() -> np.ndarray:
    """The class of each code point: kinds of letters and digits, and some punctuation apart."""
    out = np.full(0x110000, 15, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 0 if c.islower() else 2
        elif c.isdigit():
            out[i] = 3
        elif c.isspace():
            out[i] = 4
    for k, chars in {5: "\n", 6: ".?", 7: ",;:", 8: "!", 9: "|", 10: "#*$%&<>", 11: "\"'", 12: "()[]{}", 13: "-_/\\=+~^", 14: "@"}.items():
        for c in chars:
            out[ord(c)] = k
    return out


def passages(text: str | None) -> list[list[str]]:
    """A text's words in passages of PASSAGE_WORDS; a text without words is one empty passage."""
    words = (text or "").split()
    return [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)] or [[]]


def encode(bag: Sequence[list[str]], lines: Sequence[int] | None = None) -> np.ndarray:
    """Features of passages: rates of character classes and of pairs of neighbours, and
    rates of repeated words, word lengths and size. Nothing but the text goes in."""
    out = np.zeros((len(bag), WIDTH), np.float32)
    texts = [" ".join(p) for p in bag]
    table, n2 = _classes(), N_CLASSES * N_CLASSES
    for a, b in packed([len(t) + 1 for t in texts], BLOCK):
        codes = np.frombuffer(("\0".join(texts[a:b]) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = table[codes].astype(np.int64)
        size = np.array([len(t) + 1 for t in texts[a:b]])
        row = np.repeat(np.arange(b - a), size)
        inner = codes[:-1] != 0
        pair = np.bincount((row[:-1] * n2 + kind[:-1] * N_CLASSES + kind[1:])[inner & (codes[1:] != 0)], minlength=(b - a) * n2).reshape(-1, n2)
        single = np.bincount((row * N_CLASSES + kind)[codes != 0], minlength=(b - a) * N_CLASSES).reshape(-1, N_CLASSES)
        n = np.maximum(size - 1, 1)[:, None]
        out[a:b, :n2] = 4 * np.sqrt(pair / n)
        out[a:b, n2 : n2 + N_CLASSES] = 4 * np.sqrt(single / n)
    for i, p in enumerate(bag):
        if p:
            k = len(p)
            mean = (len(texts[i]) - k + 1) / k
            out[i, n2 + N_CLASSES :] = (1 - len(set(p)) / k) * 4, sum(map(str.__eq__, p, p[1:])) / k * 4, sum(map(str.__eq__, p, p[2:])) / k * 4, min(mean, 40) / 5, k / PASSAGE_WORDS, (k < 8) * 1.0
    return out


@dataclass
class GatedMIL:
    """h = tanh(xW + b) encodes a passage; its attention is the softmax, over the document,
    of w . (tanh(hV) * sigmoid(hU)); the weighted sum of h is scored by a logistic unit."""

    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    d: np.ndarray

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    @classmethod
    def new(cls, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 3) -> GatedMIL:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls(g(width, hidden), np.zeros(hidden, np.float32), g(hidden, gate), g(hidden, gate), g(gate), g(hidden), np.zeros(1, np.float32))

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of the bags of rows that begin at ``starts``, and what the gradient needs."""
        h = np.tanh(x @ self.W + self.b)
        t, s = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        e = (t * s) @ self.w
        size = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        a = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return p, (h, t, s, a, z, size)

    def gradients(self, x, starts, y, weight):
        p, (h, t, s, a, z, size) = self.forward(x, starts)
        g = ((p - y) * weight / weight.sum()).astype(np.float32)
        gz = np.repeat(g[:, None] * self.c, size, axis=0)
        da = (gz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), size))
        dt, ds = de[:, None] * self.w * s * (1 - t * t), de[:, None] * self.w * t * s * (1 - s)
        dh = (a[:, None] * gz + dt @ self.V.T + ds @ self.U.T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = 3) -> GatedMIL:
        """Adam over batches of bags, the rarer label weighing up to twice as much."""
        r, y = np.random.default_rng(seed), labels.astype(np.float32)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        weight = np.where(y == 1, min(1.0, max(0.5, (1 - share) / share)), min(1.0, max(0.5, share / (1 - share)))).astype(np.float32)
        m = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in self.NAMES}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            lr = rate * (1 - epoch / epochs) + 1e-4
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x = np.concatenate([bags[i] for i in some])
                starts = np.cumsum([0, *(len(bags[i]) for i in some[:-1])])
                step += 1
                for k, g in self.gradients(x, starts, y[some], weight[some]).items():
                    v = getattr(self, k)
                    m1, m2 = m[k]
                    m1 += 0.1 * (g - m1)
                    m2 += 0.01 * (g * g - m2)
                    v -= (lr * (m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) + decay * v)).astype(np.float32)
        return self

    def scores(self, texts: Sequence[str | None]) -> list[tuple[float, int, int]]:
        """(score, predicted, passages) of each whole text; the words of a few million characters are held at a time."""
        out = []
        for i, j in packed([len(t or "") for t in texts], 1 << 22):
            bags = [passages(t) for t in texts[i:j]]
            for a, b in packed([len(x) for x in bags], 1 << 13):
                x = encode([p for bag in bags[a:b] for p in bag])
                starts = np.cumsum([0, *(len(bag) for bag in bags[a : b - 1])])
                p, _ = self.forward(x, starts)
                out += [(float(v), int(v >= 0.5), len(bag)) for v, bag in zip(p, bags[a:b])]
        return out


def _bags(batches):
    release_worker_cache()
    for b in batches:
        rows = []
        for key, label, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            bag = passages(text)
            rows.append((key, label, len(bag), encode(bag).astype(np.float16).tobytes()))
        cols = list(zip(*rows)) or [()] * len(_BAGS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _BAGS)], schema=schema_of(_BAGS))


def fit_quality(docs: DataFrame, labels: DataFrame, trainable: Column, sample_docs: int = 4000, sample_passages: int = 100_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> GatedMIL:
    """Learn from labelled documents whose identifier ``trainable`` admits.

    The fit is on a sample: at most ``sample_docs`` labelled identifiers in the order of a hash
    of them, of these as many as together have at most ``sample_passages`` passages (56 MB of
    features); each document is read whole, and one that would be more than a tenth of all passages is left out, so that long
    texts can't crowd out the others. Null labels and identifiers with two different
    labels are left out; of texts that share an identifier the one of least hash counts. With
    no labelled row, or only one label, scores stay near the untrained model's or that label.
    """
    known = labels.where(F.col(label_col).isNotNull() & trainable).groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("other")).where("label = other")
    known = known.orderBy(F.xxhash64("key"), "key").limit(sample_docs).select("key", "label")
    tag = F.xxhash64(F.col(text_col)).alias("tag")
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), tag).join(F.broadcast(known), "key")
    size = F.greatest(F.ceil(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)) / PASSAGE_WORDS), F.lit(1))
    sizes = rows.select("key", F.struct("tag", size.alias("n")).alias("s")).groupBy("key").agg(F.min("s").alias("s"))  # sample_docs rows
    sizes = sizes.where(F.col("s.n") <= max(1, sample_passages // 10))
    total = F.sum("s.n").over(Window.orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0))
    taken = sizes.withColumn("total", total).where(F.col("total") <= sample_passages).select("key", F.col("s.tag").alias("tag"))
    rows = rows.join(F.broadcast(taken), ["key", "tag"]).dropDuplicates(["key"]).select(F.col("key").cast("bigint").alias("key"), "label", "text")
    rows = rows.mapInArrow(_bags, spark_ddl(_BAGS)).collect()
    model = GatedMIL.new()
    if not rows:
        return model
    rows.sort(key=lambda r: (r["key"], r["features"]))
    bags = [np.frombuffer(r["features"], np.float16).astype(np.float32).reshape(r["n"], WIDTH) for r in rows]
    return model.fit(bags, np.array([r["label"] for r in rows]))


def score_quality(docs: DataFrame, model: GatedMIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, score, predicted, n_passages)`` for each document, from all passages.

    Null and empty texts are one empty passage and get the score of that. Rows are scored
    alone: repeats agree, null identifiers pass through, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release_worker_cache()
        net = shared.value
        for b in batches:
            cols = list(zip(*net.scores(b.column(1).to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, (_, t) in zip(cols, _OUT[1:])]], schema=schema_of(_OUT))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, spark_ddl(_OUT))


def filter_quality(docs: DataFrame, model: GatedMIL, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, whose text scores at least ``threshold``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        release_worker_cache()
        net = shared.value
        for b in batches:
            yield b.filter(pa.array([p >= threshold for p, _, _ in net.scores(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
