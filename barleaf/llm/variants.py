"""Spelling variants: words one edit apart, by blocked products of letter counts.

A word is a vector of letter counts.  The squared distance of two such vectors
is a matrix product away, |x|^2 + |y|^2 - 2xy, and words one edit apart are at
most two apart: two for a replaced letter, one for an inserted or deleted one.
Blocks keep the products small.  Letters are dealt into ``GROUPS`` groups by
code point, and a block holds the words with the same counts per group (so of
one length).  One edit moves at most one unit between two groups, so a word
meets its own block, the blocks with one unit moved, and the blocks of the
adjacent length with one unit less.  Every pair meets in one block only: the
shorter word's, or for equal lengths the one whose counts are greater.  Pairs
within distance two are then verified letter by letter.

Scale.  Counts of words are summed inside tasks before the shuffle.  A word is
sent to at most 1 + 8 + 28 blocks whatever the corpus holds.  A block of more
than ``HOME`` words is dealt into chunks; a task holds one chunk and streams
the words that visit it, so memory is bounded.  A task leaves one row per word
and worker flush, never pairs.

Edge cases.  Null texts have no words; a null id is written as an empty text
before the hash.  Repeated rows count again.  Very long runs are words like any
other (distances are taken in double precision where single would round).  Ties
of the nearest word go to the smallest in code-point order.  Other columns are
ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.llm.common import parts, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Every so many-th (document, run) pair loses a letter.
MODULUS = 97
SHORTEST, RAREST = 5, 3
GROUPS = 8
#: Words of a block that one task holds at once, and visitors multiplied with them at once.
HOME, VISITORS = 2048, 4096
#: Distinct words a worker sums before it passes them on.
FLUSH = 400_000
#: Letters of a verified slice of pairs.
SLICE = 1 << 21
LETTERS = 26 + 64


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """Occurrences of every word of a text, after the hashed deletions."""
    out: Counter = Counter()
    # bytes.lower() changes A-Z only
    runs = Counter(RUN.findall((text or "").encode().lower().decode()))
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before)
        if h % MODULUS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``(word, n)`` of words with at least ``shortest`` letters and ``rarest`` occurrences."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py()).items():
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


class Words:
    """Some words with their code points laid out end to end."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)

    def counts(self, of: int, column: np.ndarray) -> np.ndarray:
        """Per word the number of code points in each of ``of`` columns."""
        row = np.repeat(np.arange(len(self.words)), self.size)
        return np.bincount(row * of + column, minlength=len(self.words) * of).reshape(-1, of)

    def letters(self) -> np.ndarray:
        return self.counts(LETTERS, np.where(self.flat < 128, self.flat - 97, self.flat - 192 + 26).astype(np.int64))

    def groups(self) -> np.ndarray:
        return self.counts(GROUPS, (self.flat % GROUPS).astype(np.int64))

    def slice(self, to: slice) -> Words:
        return Words(self.words[to], self.n[to])

    def plus(self, other: Words) -> Words:
        return Words(self.words + other.words, np.concatenate([self.n, other.n]))


def _keys(counts: np.ndarray) -> np.ndarray:
    """A block's key: its counts in seven bits each.  Counts that differ by 128
    may share a key; the products tell such words apart."""
    return ((counts & 127) << (7 * np.arange(GROUPS))).sum(axis=1)


def visits(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, block key and side (0 at home, 1 visiting) of every block a word is sent to."""
    own = words.groups()
    index, keys, side = [np.arange(len(own))], [_keys(own)], [np.zeros(len(own), np.int8)]
    for i in range(GROUPS):
        from_i = np.flatnonzero(own[:, i])
        less = own[from_i]
        less[:, i] -= 1
        # one unit less is the adjacent length; one unit moved to an earlier group gives greater counts
        for j in range(-1, i):
            moved = less.copy()
            if j >= 0:
                moved[:, j] += 1
            index.append(from_i)
            keys.append(_keys(moved))
            side.append(np.ones(len(from_i), np.int8))
    return np.concatenate(index), np.concatenate(keys), np.concatenate(side)


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) are exactly one edit apart; b[j] is as long or one longer."""
    ok = np.zeros(len(i), bool)
    longer = b.size[j] - a.size[i]
    for size, more in sorted(set(zip(a.size[i].tolist(), longer.tolist()))):
        if more not in (0, 1):
            continue
        at = np.flatnonzero((a.size[i] == size) & (longer == more))
        step, cols = max(1, SLICE // size), np.arange(size)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            x = a.flat[a.start[i[some]][:, None] + cols]
            front = b.start[j[some]][:, None] + cols
            head = x == b.flat[front]
            if more == 0:
                ok[some] = head.sum(axis=1) == size - 1
            else:
                tail = x == b.flat[front + 1]
                common = lambda m: np.where(m.all(axis=1), size, np.argmin(m, axis=1))
                ok[some] = common(head) + common(tail[:, ::-1]) >= size
    return ok


class Nearest:
    """Per word the number of near words seen so far and the best of them."""

    def __init__(self) -> None:
        self.held: dict[str, list] = defaultdict(lambda: [0, 0, ""])

    def add(self, word: str, other: str, n: int) -> None:
        mine = self.held[word]
        mine[0] += 1
        if n > mine[1] or n == mine[1] and other < mine[2]:
            mine[1], mine[2] = n, other

    def batch(self) -> pa.RecordBatch:
        seen, best, form = zip(*self.held.values()) if self.held else ((), (), ())
        arrays = [pa.array(self.held.keys(), pa.string()), pa.array(seen, pa.int64()), pa.array(best, pa.int64()), pa.array(form, pa.string())]
        self.held.clear()
        return pa.RecordBatch.from_arrays(arrays, ["word", "near", "best", "form"])


def within_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two count matrices with squared distance one or two."""
    used = (a.any(axis=0)) | (b.any(axis=0))
    a, b = a[:, used], b[:, used]
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    kind = np.float32 if max(aa.max(initial=0), bb.max(initial=0)) < 1 << 22 else np.float64
    gram = a.astype(kind) @ b.astype(kind).T
    gram *= -2
    gram += aa.astype(kind)[:, None]
    gram += bb.astype(kind)
    return np.nonzero((gram > 0) & (gram <= 2))


def _meet(home: Words, x: np.ndarray, other: Words, y: np.ndarray, nearest: Nearest, same: bool) -> None:
    i, j = within_two(x, y)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return
    ok = one_edit(home, i, other, j)
    i, j = i[ok], j[ok]
    for p, q, np_, nq in zip(i.tolist(), j.tolist(), home.n[i].tolist(), other.n[j].tolist()):
        nearest.add(home.words[p], other.words[q], nq)
        nearest.add(other.words[q], home.words[p], np_)


def near(words: DataFrame, home: int = HOME) -> DataFrame:
    """``(word, n_near, best, form)`` of words with near words; ``form`` is the one of largest ``best``."""
    spark = words.sparkSession

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, VISITORS):
                part = batch.slice(k, VISITORS)
                some = Words(part.column(0).to_pylist(), part.column(1).to_numpy())
                index, keys, side = visits(some)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(side), pc.take(part.column(0), pa.array(index)), pa.array(some.n[index])], ["key", "side", "word", "n"])

    rows = words.mapInArrow(sent, "key long, side byte, word string, n long")
    # blocks of many words are dealt into chunks; the others, nearly all, need no row here
    large = rows.where("side = 0").groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > home)
    chunks = F.ceil(F.coalesce("held", F.lit(1)) / home).cast("int")
    dealt = rows.join(large, "key", "left").withColumn("chunks", chunks)
    mine = F.pmod(F.xxhash64("word"), "chunks").cast("int")
    # at home in one chunk and visiting the earlier ones; visitors from elsewhere meet every chunk
    last = F.when(F.col("side") == 0, mine).otherwise(F.col("chunks") - 1)
    placed = dealt.withColumn("_last", last).select("key", F.explode(F.sequence(F.lit(0), "_last")).alias("chunk"), "side", "word", "n", "_last")
    side = F.when((F.col("side") == 0) & (F.col("chunk") == F.col("_last")), 0).otherwise(1).cast("byte")
    cells = placed.select("key", "chunk", side.alias("side"), "word", "n").repartition(parts(spark), "key", "chunk").sortWithinPartitions("key", "chunk", "side")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, at, home_words, x = Nearest(), None, None, None
        for batch in batches:
            for k in range(0, batch.num_rows, VISITORS):
                part = batch.slice(k, VISITORS)
                cell = np.stack([part.column(i).to_numpy() for i in range(3)])
                edges = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
                names, n = part.column(3).to_pylist(), part.column(4).to_numpy()
                for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), part.num_rows]):
                    place = cell[0, lo], cell[1, lo]
                    if place != at:
                        at, home_words = place, None
                    if cell[2, lo] and home_words is None:
                        continue  # visitors of a block that holds no words
                    some = Words(names[lo:hi], n[lo:hi])
                    y = some.letters()
                    if cell[2, lo]:
                        _meet(home_words, x, some, y, nearest, False)
                        continue
                    _meet(some, y, some, y, nearest, True)
                    if home_words is None:
                        home_words, x = some, y
                    else:
                        _meet(home_words, x, some, y, nearest, False)
                        home_words, x = home_words.plus(some), np.concatenate([x, y])
                if len(nearest.held) > FLUSH:
                    yield nearest.batch()
        yield nearest.batch()

    found = cells.mapInArrow(met, "word string, near long, best long, form string")
    first = F.min(F.struct((-F.col("best")).alias("b"), F.col("form").alias("f")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("_first")).select("word", "n_near", (-F.col("_first.b")).alias("best"), F.col("_first.f").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)`` without nulls: the end of each chain.

    Chains double their reach every round.  A form occurs at least twice as
    often as its word, so chains are no longer than the bits of a count and
    seven rounds are the most there can be.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = stored(step, "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def groups(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, home: int = HOME) -> DataFrame:
    """Every word with its form, root and counts."""
    words = stored(word_counts(docs, shortest, rarest), "words")
    judged = words.join(near(words, home), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    fits = F.col("best") >= 2 * F.col("n")
    judged = stored(judged.select("word", F.when(fits, F.col("form")).alias("form"), "n", "n_near", F.when(fits, F.col("best")).alias("form_n")), "variants")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
