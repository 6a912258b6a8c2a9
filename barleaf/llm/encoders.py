"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces.

Both vocabularies split a text before every space that follows a non-space, so
a piece (a word, with the space or line break before it) has the same ids
wherever it stands.  A worker keeps the ids of pieces it has seen, up to
``KEEP`` of them, and asks the library only for new ones.  Texts holding white
space other than single spaces and line breaks are given to the library whole.
Ids are kept as little-endian 16-bit numbers; both vocabularies fit.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP = 400_000

# A text is taken whole if white space stands at an end or in runs, or is not a plain space or line break.
_ODD = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SLICE = 4 << 20
# Marks after a word are a run of their own; an apostrophe may open a contraction and is not among them.
_MARKS = ".,;:!?#*$%&|)"


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def crc(payload: bytes) -> int:
    """crc32 of 16-bit ids written as little-endian 32-bit numbers."""
    return zlib.crc32(np.frombuffer(payload, "<u2").astype("<u4").tobytes())


def _letters(word: str) -> bool:
    """Latin letters only, which stay letters under the normaliser."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250" and word.lower().isalpha())


def _stand(piece: str) -> str:
    """A piece as it stands in a text: after a space, unless it opens a line or the text."""
    return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece


class Encoder:
    """Ids of texts under one vocabulary file; ``encode`` takes texts, null counts as empty.

    Pieces are remembered in two generations of ``keep / 2``: when the younger is
    full it becomes the older one, and pieces met again move back.
    """

    def __init__(self, path: str, keep: int = KEEP) -> None:
        self.library, self.keep = _library(path), keep
        size = self.library.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        # A word of letters closes with one id that ends a word, or opens with one id that holds its space.
        self.closes = np.array([t.endswith("</w>") for t in tokens])
        self.opens = np.array([t.startswith("\u0120") for t in tokens])
        self.spaced = not self.closes.any()
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # ASCII letters need no normaliser: lowered, they are split by white space alone.
        spec = json.loads(self.library.to_str())
        self.bare = None
        if "Lowercase" in json.dumps(spec["normalizer"]) and not self.spaced:
            self.bare = type(self.library).from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.marks: dict[str, bytes] = {}

    def _ids_of(self, library, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return self._ids_of(self.library, texts)

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, many to a call, split where a word closes or opens."""
        out = {}
        plain = [w for w in words if w.isascii()] if self.bare else []
        for library, some in ((self.bare, plain), (self.library, [w for w in words if not (self.bare and w.isascii())])):
            for at in range(0, len(some), 128):
                part = some[at : at + 128]
                text = " ".join(part)
                payload = self._ids_of(library, [text.lower() if library is self.bare else " " + text if self.spaced else text])[0]
                ids = np.frombuffer(payload, "<u2")
                ends = [*(2 * (np.flatnonzero(self.opens[ids])[1:] if self.spaced else np.flatnonzero(self.closes[ids])[:-1] + 1)).tolist(), len(payload)]
                if len(ends) == len(part):
                    out.update(zip(part, [payload[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces; a piece stands after a space unless it opens a line."""
        marked = {p: base for p in pieces if (base := p.rstrip(_MARKS)) != p and base and _letters(base)}
        bases = set(marked.values())
        known = {p: ids for p in bases if (ids := self.seen.get(p) or self.older.get(p))}
        known |= self._words([p for p in (pieces | bases) - known.keys() if _letters(p)])
        if tails := {p[len(base) :] for p, base in marked.items()} - self.marks.keys():
            if len(self.marks) > 10_000:
                self.marks.clear()
                tails = {p[len(base) :] for p, base in marked.items()}
            tails = list(tails)
            self.marks.update(zip(tails, self.whole(tails)))
        out = {p: known[base] + self.marks[p[len(base) :]] for p, base in marked.items() if base in known}
        out |= {p: known[p] for p in pieces & known.keys()}
        rest = list(pieces - out.keys())
        out.update(zip(rest, self.whole([_stand(p) if self.spaced else p for p in rest])))
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.seen) > self.keep // 2:
            self.seen, self.older = {}, self.seen
        found = list(map(self.seen.get, pieces))
        if new := {p for p, ids in zip(pieces, found) if ids is None}:
            self.seen |= (moved := {p: ids for p in new if (ids := self.older.get(p)) is not None})
            if rest := new - moved.keys():
                self.seen |= self._learn(rest)
            found = [self.seen[p] if ids is None else ids for p, ids in zip(pieces, found)]
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array; null counts as empty."""
        out: list[bytes] = []
        texts = pc.fill_null(texts, "")
        at = 0
        while at < len(texts):  # slices of bounded size, one text at least
            sizes = np.cumsum(pc.binary_length(texts[at : at + 4096]).to_numpy(zero_copy_only=False))
            n = max(1, int(np.searchsorted(sizes, _SLICE)))
            out += self._slice(texts[at : at + n])
            at += n
        return out

    def _slice(self, texts: pa.Array) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        some = texts.take(pa.array(plain))
        if self.spaced:  # a text's first piece has no space before it: a zero marks it
            some = pc.binary_join_element_wise("\0", pc.replace_substring(some, "\n", " \n"), "")
        else:
            some = pc.replace_substring(some, "\n", " ")
        lists = pc.split_pattern(some, " ")
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(words.indices)
        data = ids.buffers()[2]
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :] if len(ids) else np.zeros(1, np.int32)
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(some) else []
        data = memoryview(data) if data is not None else memoryview(b"")
        for k, i in enumerate(plain):
            out[i] = bytes(data[bounds[k] : bounds[k + 1]])
        rest = np.flatnonzero(odd).tolist()
        for i, x in zip(rest, self.whole(texts.take(pa.array(rest)).to_pylist()) if rest else []):
            out[i] = x
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str, keep: int = KEEP) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, keep)
    return _loaded[path]
