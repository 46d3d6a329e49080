"""Operator 2, BPE encoding and decoding: a bounded-lookahead streaming transducer."""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.arrow import schema_of, spark_ddl, worker_cache

#: White space by the Unicode property, as the tokenizer files mean it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

_OUT = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
_TOKENS = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
_TEXTS = [("doc_id", pa.int64()), ("text", pa.string())]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(kept))}
    return [rest.get(b, chr(b)) for b in range(256)]


class MergeList:
    """A vocabulary with ranked merges, ready for left-to-right encoding.

    A symbol is one character; the last of a piece is moved by ``END`` where the
    vocabulary marks word ends. Every token is made by one merge, which is checked.
    """

    END = 0x20000
    #: Prefixes up to this length are remembered with their last token.
    HEAD = 8
    #: Runs up to this length are encoded at once.
    SHORT = 256

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.ids = {self._symbols(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        made: dict[str, int] = {}
        for r, (a, b) in enumerate(merges):
            pair = self._symbols(a), self._symbols(b)
            if pair[0] + pair[1] in made:
                raise ValueError(f"two merges make {a + b!r}")
            made[pair[0] + pair[1]] = self.rank[pair] = r
        self.longest = max(map(len, self.ids), default=1)
        self.lookahead = self._lookahead(made)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        #: The last token of short prefixes, which depends on the prefix alone.
        self.heads: dict[str, str] = {}
        #: Lengths of the longer tokens that end in each pair, and in each three, of symbols, the longest first; and 1.
        self.lengths, self.lengths3 = self._ends(2), self._ends(3)

    def _ends(self, n: int) -> dict[str, tuple[int, ...]]:
        by: dict[str, set[int]] = {}
        for token in self.ids:
            if len(token) >= n:
                by.setdefault(token[-n:], set()).add(len(token))
        pair = lambda end: {2} if end[-2:] in self.ids else set()
        return {end: (*sorted(sizes | pair(end) - {1}, reverse=True), 1) for end, sizes in by.items()}

    def whole(self, text: str) -> list[str]:
        """The tokens of a run of few symbols at once: the chain of last tokens that a ``Transducer`` would find."""
        last, ids, heads, two, three, pairs = [""], self.ids, self.heads, self.lengths, self.lengths3, self._pairs
        if len(heads) > 150_000:
            heads.clear()
        for i in range(1, len(text) + 1):
            if i <= self.HEAD and (token := heads.get(text[:i])):
                last.append(token)
                continue
            sizes = three.get(text[i - 3 : i]) if i > 2 else None
            for n in sizes or two.get(text[max(0, i - 2) : i], (1,)):
                if n > i or (token := text[i - n : i]) not in ids:
                    continue
                prev = last[i - n]
                ok = pairs.get((prev, token)) if prev else self.stands(token)
                if ok or ok is None and self.adjoin(prev, token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at {text[i - 1]!r}")
            if i <= self.HEAD:
                heads[text[:i]] = token
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(out[-1])
        return out[::-1]

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + self.END)
        return token

    def piece(self, text: str) -> str:
        """Symbols of a piece."""
        return text[:-1] + chr(ord(text[-1]) + self.END) if self.suffix and text else text

    @staticmethod
    def _lookahead(made: dict[str, int]) -> int:
        """Symbols after a token within which its fate is decided.

        A merge can only be spoilt by an earlier merge that takes its last symbols, that
        one by a still earlier one, and so on: the bound is the longest such chain, each
        link overlapping the one before. Taken in the order of rank, every token looks up
        the longest chain from each of its suffixes.
        """
        best: dict[str, int] = {}
        most = 1
        for token in made:
            reach = len(token) + max((best.get(token[i:], 0) for i in range(1, len(token))), default=0)
            most = max(most, reach)
            for i in range(1, len(token)):
                head = token[:i]
                if reach - i > best.get(head, 0):
                    best[head] = reach - i
        return most

    def merged(self, symbols: str) -> list[str]:
        """All merges over a short run of symbols, the earliest and leftmost first."""
        parts, rank, none = list(symbols), self.rank, 1 << 60
        while len(parts) > 1:
            r, i = min((rank.get((parts[i], parts[i + 1]), none), i) for i in range(len(parts) - 1))
            if r == none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stands(self, token: str) -> bool:
        """Whether a token alone encodes as itself."""
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = self.merged(token) == [token]
        return ok

    def adjoin(self, a: str, b: str) -> bool:
        """Whether a followed by b stays as it is; neighbours in an encoding do."""
        key = (a, b)
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > 150_000:
                self._pairs.clear()
            ok = self._pairs[key] = self.merged(a + b) == [a, b]
        return ok


class Transducer:
    """Encodes one piece, symbol by symbol, in constant memory.

    For each prefix it finds the last token of the prefix's own encoding: the one token
    that ends there and adjoins the last token of what precedes it. Future tokens can
    begin only at the last ``longest`` positions, so what all chains of last tokens from
    these positions have in common is stable and is emitted. It is looked for after every
    ``lookahead`` symbols.
    """

    def __init__(self, model: MergeList):
        self.m = model
        self.text, self.last, self.base = "", [""], ""

    def feed(self, symbols: str) -> Iterator[str]:
        step = self.m.lookahead
        for a in range(0, len(symbols), step):
            self._extend(symbols[a : a + step])
            if len(self.text) > step + self.m.longest:
                yield from self._stable()

    def finish(self) -> list[str]:
        out = self._chain(len(self.text))[0]
        self.text, self.last, self.base = "", [""], ""
        return out

    def _extend(self, more: str) -> None:
        m, first = self.m, len(self.text) + 1
        self.text += more
        text, last, ids, known = self.text, self.last, self.m.ids, self.m.heads
        if len(known) > 150_000:
            known.clear()
        for i in range(first, len(text) + 1):
            if i <= m.HEAD and not self.base and (token := known.get(text[:i])):
                last.append(token)
                continue
            for n in m.lengths.get(text[max(0, i - 2) : i], (1,)):
                if n <= i and (token := text[i - n : i]) in ids and (m.adjoin(prev, token) if (prev := last[i - n] or self.base) else m.stands(token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at {text[i - 1]!r}")
            if i <= m.HEAD and not self.base:
                known[text[:i]] = token

    def _chain(self, at: int) -> tuple[list[str], list[int]]:
        tokens, ends = [], [at]
        while at > 0:
            tokens.append(self.last[at])
            at -= len(tokens[-1])
            ends.append(at)
        return tokens[::-1], ends[::-1]

    def _stable(self) -> list[str]:
        n = len(self.text)
        common = set(self._chain(n)[1])
        for at in range(max(1, n - self.m.longest + 1), n):
            common &= set(self._chain(at)[1])
        cut = max(common)
        if cut == 0:
            return []
        out = self._chain(cut)[0]
        self.text, self.last, self.base = self.text[cut:], ["", *self.last[cut + 1 :]], out[-1]
        return out


class Utf8Machine:
    """Incremental bytes to text: holds at most the three bytes of an unfinished character.

    Bytes that can't be part of a character become U+FFFD, as in a decoder over the whole.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                need = 4 if 0xF0 <= b < 0xF5 else 3 if 0xE0 <= b < 0xF0 else 2 if 0xC2 <= b < 0xE0 else 1
                cut -= back if need > back else 0
                break
        text = data[:cut]
        self.held = data[cut:]
        return text.decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class WordTokenizer:
    """A tokenizer file of pieces with word ends: added tokens, NFC, lower case, a split
    pattern, byte-level symbols and merges.

    ``spec`` is the file's JSON. Encoding equals that of the tokenizers library without
    special tokens added, truncation or padding; decoding that of a file without a
    decoder, which joins token strings by spaces, or with ``as_bytes`` the text itself.
    """

    #: What a file's steps must be; the pattern of its split is read from it.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    #: Characters of a text that are split into words at a time.
    SLICE = 1 << 16
    #: Entries of one generation of the cache of words and pieces; two are held.
    CACHE = 250_000

    def __init__(self, spec: str | dict):
        spec = json.loads(spec) if isinstance(spec, (str, bytes)) else spec
        model = spec["model"]
        self.pieces = regex.compile(self._pattern(spec))
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merges = MergeList(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: What all added tokens begin with; it may be empty.
        self.hint = os.path.commonprefix(list(self.added))
        self.words = regex.compile(f"[^{WHITE}]+")
        self.gap = regex.compile(f"[{WHITE}]")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.letters = byte_alphabet()
        self.strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.joined = [self.strings.get(i, "").encode() for i in range(max(self.strings) + 1)]
        back = {c: b for b, c in enumerate(self.letters)}
        end = self.merges.suffix
        self.raw = [t.encode() if t in self.added else bytes(back[c] for c in t.removesuffix(end)) + b" " * (bool(end) and t.endswith(end)) for t in (self.strings.get(i, "") for i in range(len(self.joined)))]
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @classmethod
    def _pattern(cls, spec: dict) -> str:
        """The split pattern of a file whose other steps are those this class carries out."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        split, model = steps[0], spec["model"]
        pattern = (split.get("pattern") or {}).get("Regex", "").replace(r"\s", WHITE)
        known = {
            "normalizer": (spec.get("normalizer") or {}).get("normalizers") == cls.NORMALIZERS,
            "pre_tokenizer": len(steps) == 2 and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True) and cls.BYTES.items() <= steps[1].items(),
            "pattern": bool(pattern) and not regex.search(pattern, " "),
            "decoder": spec.get("decoder") is None,
            "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
            "added_tokens": not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
        }
        if odd := [k for k, ok in known.items() if not ok]:
            raise ValueError(f"this tokenizer file has steps that are not supported: {odd}")
        return pattern

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
        symbols, ids = self.merges.piece(symbols), self.merges.ids
        if len(symbols) <= self.merges.SHORT:
            out = self.merges.whole(symbols)
        else:
            run = Transducer(self.merges)
            out = [*run.feed(symbols), *run.finish()]
        return array("I", [ids[t] for t in out]).tobytes()

    def _keep(self, word: str, got: bytes) -> bytes:
        """Remember a short word or piece; the older generation goes when the younger is full."""
        if len(word) < 64:
            if len(self._known) >= self.CACHE:
                self._older, self._known = self._known, {}
            self._known[word] = got
        return got

    def _word(self, word: str) -> bytes:
        """A word that the younger generation lacks. A piece that stands alone is a word like any other."""
        got = self._older.get(word)
        if got is not None:
            return self._keep(word, got)
        text = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        if text == word and text.isalpha():
            return self._keep(word, self._piece(word))
        out = []
        for p in self.pieces.findall(text):
            got = self._known.get(p) or self._older.get(p) or self._piece(p)
            out.append(got if p == word else self._keep(p, got))
        return self._keep(word, b"".join(out))

    def _parts(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Ranges of a text: added tokens, and what is between them in slices that end with a word."""
        marks = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special and self.hint in text else []
        at = 0
        for a, b in [*marks, (len(text), len(text))]:
            while at < a:
                end = min(at + self.SLICE, a)
                if end < a:
                    gap = self.gap.search(text, end, a)
                    end = gap.start() if gap else a
                yield "words", at, end
                at = end
            if a < b:
                yield "added", a, b
            at = b

    def encode_bytes(self, text: str | None) -> Iterator[bytes]:
        """Blocks of identifiers as little-endian unsigned 32-bit integers, of one slice of the text each."""
        if not text:
            return
        miss = self._word
        for kind, a, b in self._parts(text):
            part = text if (a, b) == (0, len(text)) else text[a:b]
            if kind == "added":
                yield np.array([self.added[part]], "<u4").tobytes()
                continue
            words = self.words.findall(part) if self.odd.search(part) else part.split()
            known = self._known.get
            yield b"".join([known(w) or miss(w) for w in words])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.encode_bytes(text)), "<u4").tolist()

    def decode_blocks(self, blocks: Iterable[bytes], as_bytes: bool = False) -> Iterator[str]:
        """Text of blocks of identifiers, through the byte-to-text machine."""
        machine, table, first = Utf8Machine(), self.raw if as_bytes else self.joined, True
        for block in blocks:
            if not block:
                continue
            data = (b"" if as_bytes else b" ").join([table[i] for i in np.frombuffer(block, "<u4").tolist()])
            yield machine.feed(data if first or as_bytes else b" " + data)
            first = False
        yield machine.finish()

    def decode(self, ids: Iterable[int], as_bytes: bool = False) -> str:
        return "".join(self.decode_blocks([np.array(list(ids), "<u4").tobytes()], as_bytes))


def _tokenizer(spec: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    return worker_cache("bpe", spec, lambda: WordTokenizer(spec))


def _run(docs: DataFrame, spec: str, id_col: str, col: str, fields, one):
    """``one(tokenizer, value) -> tuple`` for every row. A tokenizer file has a fixed size, and
    is read on the driver, for executors may not have it."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        tok = _tokenizer(shared.value)
        for b in batches:
            cols = list(zip(*(one(tok, v) for v in b.column(1).to_pylist()))) or [()] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, (_, t) in zip(cols, fields[1:])]], schema=schema_of(fields))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(col)).mapInArrow(run, spark_ddl(fields))


def encode_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, ids)``; a null text has no tokens. Rows are taken alone; other columns are not read."""
    return _run(docs, spec, id_col, text_col, _TOKENS, lambda tok, t: (tok.encode(t),))


def decode_documents(tokens: DataFrame, spec: str, as_bytes: bool = False, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows ``(doc_id, text)`` of identifiers; null identifiers decode as the empty text."""
    return _run(tokens, spec, id_col, ids_col, _TEXTS, lambda tok, ids: (tok.decode(ids or [], as_bytes),))


def _digests(tok: WordTokenizer, text: str | None) -> tuple[int, str, str]:
    """Both digests grow slice by slice: no list of a text's words, tokens or decoded parts is held."""
    ids, out, n = sha256(), sha256(), 0

    def seen() -> Iterator[bytes]:
        nonlocal n
        for block in tok.encode_bytes(text):
            ids.update(block)
            n += len(block) // 4
            yield block

    for part in tok.decode_blocks(seen()):
        out.update(part.encode())
    return n, ids.hexdigest(), out.hexdigest()


def bpe_digests(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: every whole text encoded, and decoded again.

    A null text counts as empty. Rows are taken alone, so repeats agree and null identifiers
    pass through; other columns are not read; an empty table gives an empty table.
    """
    return _run(docs, spec, id_col, text_col, _OUT, _digests)
