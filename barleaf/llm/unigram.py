"""Token counts by the unigram model, without making tokens.

An Aho-Corasick automaton over the vocabulary names every piece that ends at
each character; dynamic programming keeps, per place, the best score and the
number of pieces on the best path, and nothing to walk back.  Ties go to the path
whose last piece starts first, and an unknown character costs ten less than the
worst piece and counts as its bytes, as the tokenizers library's unigram model
with byte fallback has it.

White space is the model's ``▁``, one stands before the text.  No piece holds
it after another character (checked when the vocabulary is read), so paths meet
before each word, and a worker remembers a word's score and count, up to a bound.

The vocabulary is the public 32k piece file.  Its scores are whole numbers, so
sums over words are exact.

Edge cases.  Null and empty texts count zero.  Repeated rows and null ids are
counted row by row; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
PENALTY = 10.0
KEEP = 500_000
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Best score and number of tokens of texts."""

    def __init__(self, pieces: list[tuple[str, float]], keep: int = KEEP) -> None:
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece goes on over white space")
        self.match = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.keep = keep
        self.seen: dict[str, tuple[float, int]] = {}

    def best(self, text: str) -> tuple[float, int]:
        """Score and count of one text in the model's characters."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.match.iter(text):
            ends[end + 1].append((length, score))
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, count, single = None, 0, False
            for length, score in ends[end]:  # longest first: the one that starts first
                if length == 1:
                    single = True
                s = scores[end - length] + score
                if top is None or s > top:
                    top, count = s, counts[end - length] + 1
            if not single:
                s = scores[end - 1] + self.unknown
                if top is None or s > top:
                    top, count = s, counts[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
            scores[end], counts[end] = top, count
        return scores[n], counts[n]

    def _unit(self, unit: str) -> tuple[float, int]:
        parts = [self.best(u) for u in _UNIT.findall(unit)]
        return sum(s for s, _ in parts), sum(c for _, c in parts)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores and counts of a string array; null counts as empty."""
        texts = pc.fill_null(texts, "")
        given = (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
        # A space opens the word after it; runs of spaces stay together with their word.
        runs = pc.match_substring_regex(texts, f"\\A[ {SPACE}]|[ {SPACE}]\\z|[ {SPACE}][ {SPACE}]|{SPACE}").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(runs), "", texts), " ")
        words = lists.flatten().dictionary_encode()
        found = []
        for word in words.dictionary.to_numpy(zero_copy_only=False).tolist():
            if (told := self.seen.get(word)) is None:
                if len(self.seen) > self.keep:
                    self.seen.clear()
                told = self.seen[word] = self._unit(SPACE + word) if word else (0.0, 0)
            found.append(told)
        codes, bounds = words.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = []
        for k in (0, 1):
            sums = np.r_[0, np.cumsum(np.array([f[k] for f in found], np.float64)[codes])] if len(codes) else np.zeros(1)
            out.append((sums[bounds[1:]] - sums[bounds[:-1]]) * given)
        for i in np.flatnonzero(runs):
            text = texts[int(i)].as_py().replace(" ", SPACE)
            out[0][i], out[1][i] = self._unit(text if text.startswith(SPACE) else SPACE + text)
        return out[0], out[1].astype(np.int64)


_loaded: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """The worker's counter for a vocabulary file; it lives as long as the worker."""
    if path not in _loaded:
        _loaded[path] = UnigramCounter(vocabulary(path))
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, score)``: one row for each input row."""

    def work(batches):
        model = counter(path)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                scores, counts = model.count(batch.column(1)[at : at + 2048])
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 2048], pa.array(counts), pa.array(scores)], ["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double")
