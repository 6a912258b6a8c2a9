"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can end its encoding.  A matching
automaton over the vocabulary names, in one pass, all tokens that end at each
place; such a token is the prefix's last one if it may follow the last token of
the prefix before it.  Two tokens may stand side by side if undoing their
merges, latest first, never uncovers a pair across their border that the merge
order would have joined earlier.  The last tokens are stored per prefix, and
following them back from the whole word gives the ids: no merge loop, and time
in proportion to the matches.

Words are cut out as the vocabulary file says (its normaliser and its splitter,
from the tokenizers library); the merges and the ids are found here.  A worker
remembers the words it has met, up to a bound (see ``encoders.Encoder``).

Edge cases.  Null and empty texts have no ids and decode to the empty string.
Special tokens inside a text become their ids.  Repeated rows and null ids of
documents are kept row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.llm.encoders import KEEP, Encoder

WORDS = 800_000  # pieces a worker remembers, about 200 bytes each
_LAST = 0xE000  # a word's last symbol is another symbol where the vocabulary marks word ends


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


class PrefixBpe(Encoder):
    """Encoder and decoder for one vocabulary file of byte-level merges."""

    def __init__(self, path: str, keep: int = KEEP) -> None:
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank = [-1] * (max(self.ids.values()) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            joined, a, b = self.ids[a + b], self.ids[a], self.ids[b]
            self.pairs[a, b] = n
            if self.rank[joined] < 0:
                self.rank[joined], self.left[joined], self.right[joined] = n, a, b
        self.fits: dict[tuple[int, int], bool] = {}
        self.match = ahocorasick.Automaton()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.ids.items():
            symbols = self._symbols(token)
            # A token that is neither a symbol nor made by a merge never appears.
            if token not in special and (len(symbols) == 1 or self.rank[i] >= 0):
                self.match.add_word(symbols, (len(symbols), i))
        self.match.make_automaton()
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.bytes = byte_symbols()
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"])
        self.memo: dict[str, bytes] = {}
        tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.joins = (spec["decoder"] or {}).get("type") is None
        self.decimal = pa.array([b"%d " % i for i in range(len(self.tokens))], pa.binary())
        back = {c: b for b, c in enumerate(self.bytes)}
        self.surface = pa.array([(t + " ").encode() if self.joins else bytes(back[c] for c in t) if set(t) <= back.keys() else t.encode() for t in self.tokens], pa.binary())
        super().__init__(path, keep)

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(_LAST + ord(token[-1]))
        return token

    def follows(self, a: int, b: int) -> bool:
        """May token ``b`` follow token ``a``: would no merge cross their border?"""
        key = (a, b)
        if (known := self.fits.get(key)) is None:
            known, before = True, len(self.pairs)
            while True:
                n = self.pairs.get((a, b))
                if n is not None and n < before:
                    known = False
                    break
                if self.rank[a] > self.rank[b]:  # the later merge is undone; a's border part is its right half
                    before, a = self.rank[a], self.right[a]
                elif self.rank[b] >= 0:  # of equal merges the left one came first, so the border pair went before b
                    before, b = self.rank[b] + 1, self.left[b]
                else:
                    break
            if len(self.fits) > self.keep // 4:
                self.fits.clear()
            self.fits[key] = known
        return known

    def word(self, symbols: str) -> list[int]:
        """Ids of one word given as symbols."""
        n = len(symbols)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        follows = self.follows
        for end, (length, token) in self.match.iter(symbols):
            end += 1
            if size[end]:
                continue
            before = end - length
            if before == 0 or (size[before] and follows(last[before], token)):
                last[end], size[end] = token, length
        if n and not size[n]:
            raise ValueError("the vocabulary does not cover a symbol")
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def _word(self, text: str) -> bytes:
        """Ids of one word given as byte-level characters."""
        if (ids := self.memo.get(text)) is None:
            symbols = text[:-1] + chr(_LAST + ord(text[-1])) if self.suffix else text
            ids = np.array(self.word(symbols), "<u2").tobytes()
            if len(self.memo) > self.keep // 4:
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def _words(self, words: list[str]) -> dict[str, bytes]:
        if not self.lowers:
            return dict(zip(words, self.whole([" " + w if self.spaced else w for w in words])))
        return {w: self._word("".join([self.bytes[b] for b in w.lower().encode()])) for w in words}

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            ids = []
            for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if k % 2:
                    ids.append(np.array([self.special[part]], "<u2").tobytes())
                elif part:
                    if self.library.normalizer:
                        part = self.library.normalizer.normalize_str(part)
                    ids += [self._word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part) if w]
            out.append(b"".join(ids))
        return out

    def _spread(self, values: pa.Array, payload: bytes) -> bytes:
        if not payload:
            return b""
        got = values.take(pa.array(np.frombuffer(payload, "<u2").astype(np.int32)))
        ends = np.frombuffer(got.buffers()[1], np.int32)
        return bytes(memoryview(got.buffers()[2])[ends[0] : ends[len(got)]])

    def decode(self, payload: bytes) -> str:
        """Text of 16-bit ids, special tokens included."""
        return self._surface(payload).decode("utf-8", "replace")

    def _surface(self, payload: bytes) -> bytes:
        text = self._spread(self.surface, payload)
        return text[:-1] if self.joins else text

    def digests(self, payload: bytes) -> tuple[str, str]:
        """sha256 of the decimal ids joined by one space, and of the decoded text."""
        ids = self._spread(self.decimal, payload)[:-1]
        text = self._surface(payload)
        if not self.joins:
            text = text.decode("utf-8", "replace").encode()
        return hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()


_loaded: dict[str, PrefixBpe] = {}


def prefix_bpe(path: str) -> PrefixBpe:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path, WORDS)
    return _loaded[path]


def _map(docs: DataFrame, path: str, doc_id: str, text: str, made, fields: list[tuple[str, str]]) -> DataFrame:
    names = ["doc_id", *(n for n, _ in fields)]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def work(batches):
        bpe = prefix_bpe(path)
        for batch in batches:
            ids = bpe.encode(batch.column(1))
            for at in range(0, len(ids), 2048):
                rows = list(zip(*(made(bpe, x) for x in ids[at : at + 2048])))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 2048]] + [pa.array(c, kinds[k]) for c, (_, k) in zip(rows, fields)], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in fields))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, decoded)``: ids of every whole text and their text again."""

    def made(bpe, x):
        return np.frombuffer(x, "<u2").astype(np.int32), bpe.decode(x)

    return _map(docs, path, doc_id, text, made, [("ids", "array<int>"), ("decoded", "string")])


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text."""

    def made(bpe, x):
        return len(x) // 2, *bpe.digests(x)

    return _map(docs, path, doc_id, text, made, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
