"""Hierarchical multi-length packing of token documents.

Every document is its ids and an end id.  Whole windows of the longest context
leave at once as sequences of their own.  What is left of a document is routed
to the smallest context tier (a power of two) that holds it, opens a window of
that tier, and the window's gap is filled from shorter tiers: the longest rest
that fits whole, and only where none fits, a piece cut from the shortest one.
So every window is full, and a full power of two needs no padding.  Tokens that
can't fill a last window are cut along the binary digits of their number.
Sequences are dealt to step groups of about equal token counts, longest first
to the group with the fewest tokens.

Packing runs inside each input partition over batches of ``BATCH`` rests, so
memory is bounded, nothing is shuffled, and a lost task repeats alone with the
same result.  ``sequence_id`` and ``step_group`` hold the partition in their
upper bits.

Edge cases.  Null and empty texts are the end id alone.  Repeated rows and
repeated or null ids are packed row by row.  Other columns are ignored.  Empty
tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.llm.encoders import encoder

WINDOW = 1024
SHORTEST = 64
BATCH = 8192
STEP_TOKENS = 64 * 1024
SLICE = 2048


def tier_of(n: int, window: int = WINDOW, shortest: int = SHORTEST) -> int:
    """The smallest tier that holds ``n`` tokens."""
    return min(window, max(shortest, 1 << (n - 1).bit_length()))


def fill(rests: list[int], window: int = WINDOW, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Pack rests of the given lengths, each under ``window``.

    Returns sequences as lists of ``(rest, from, length)``; every sequence's
    total is a power of two.
    """
    held: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # by length: (rest, from)
    lengths = 0  # bit n: some rest of length n is left
    for i, n in enumerate(rests):
        held[n].append((i, 0))
        lengths |= 1 << n

    def take(n: int) -> tuple[int, int]:
        nonlocal lengths
        got = held[n].pop()
        if not held[n]:
            lengths &= ~(1 << n)
        return got

    out = []
    while lengths:
        n = lengths.bit_length() - 1
        tier = tier_of(n, window, shortest)
        one = [(*take(n), n)]
        gap = tier - n
        while gap and lengths:
            fits = lengths & ((1 << (gap + 1)) - 1)
            if fits:
                n = fits.bit_length() - 1
                one.append((*take(n), n))
                gap -= n
            else:
                n = (lengths & -lengths).bit_length() - 1
                i, at = take(n)
                one.append((i, at, gap))
                held[n - gap].append((i, at + gap))
                lengths |= 1 << (n - gap)
                gap = 0
        if not gap:
            out.append(one)
            continue
        left = tier - gap  # nothing is left to fill with
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            part = []
            while want:
                i, at, n = one.pop(0)
                part.append((i, at, min(n, want)))
                if n > want:
                    one.insert(0, (i, at + want, n - want))
                want -= min(n, want)
            out.append(part)
    return out


def step_groups(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Group of each sequence: longest first, to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, round(sum(lengths) / step_tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (tokens + lengths[i], g))
    return out


def pack(docs: DataFrame, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shortest: int = SHORTEST, batch: int = BATCH, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: its token ids, where it comes from, its sequence and its place there.

    ``ids`` holds the piece's ids as little-endian 32-bit numbers; a sequence's
    pieces joined by ``offset`` are the training sequence.  ``ids_crc32`` is
    derived from ``ids``.
    """
    end = np.array([end_id], "<u2").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def work(batches):
        tokens, base = encoder(path), TaskContext.get().partitionId() << 36
        sequence, group = base, base
        ready: list[list[tuple]] = []  # sequences: lists of (doc, from, length)
        open_: list[tuple] = []  # documents with a rest: (doc, from)
        full = 0
        made: list[tuple] = []  # documents: (id, ids)
        kind = None

        def flush():
            nonlocal sequence, group, ready, open_, full, made
            rests = [len(made[d][1]) - at for d, at in open_]
            for one in fill(rests, window, shortest):
                ready.append([(open_[i][0], open_[i][1] + at, n) for i, at, n in one])
            lengths = [sum(n for _, _, n in one) for one in ready]
            steps = step_groups(lengths, step_tokens)
            rows = []
            for one, total, step in zip(ready, lengths, steps):
                offset = 0
                for d, at, n in one:
                    doc, ids = made[d]
                    rows.append((doc, at, n, ids[at : at + n].astype("<u4").tobytes(), len(ids), sequence, offset, total, group + step))
                    offset += n
                sequence += 1
            group += max(steps, default=-1) + 1
            ready, open_, made, full = [], [], [], 0
            columns = list(zip(*rows))
            kinds = [kind, *(pa.binary() if n == "ids" else pa.int64() for n in names[1:])]
            return [pa.RecordBatch.from_arrays([pa.array(c[at : at + SLICE], k) for c, k in zip(columns, kinds)], names) for at in range(0, len(rows), SLICE)]

        for rows in batches:
            kind = rows.schema.field(0).type
            for doc, payload in zip(rows.column(0).to_pylist(), tokens.encode(rows.column(1))):
                ids = np.frombuffer(payload + end, "<u2")
                made.append((doc, ids))
                for at in range(0, len(ids) - window + 1, window):
                    ready.append([(len(made) - 1, at, window)])
                if len(ids) % window:
                    open_.append((len(made) - 1, len(ids) - len(ids) % window))
                full += len(ids)
                if len(open_) >= batch or full >= batch * window:
                    yield from flush()
        if made:
            yield from flush()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names[1:]))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))
