"""SimHash near-duplicates found through pivot distance tables.

A document's fingerprint has bit *i* set when more than half of its shingle
hashes have it.  Two fingerprints link at ``radius`` or fewer differing bits.

Search.  Distances to a reference fingerprint change by at most one per
differing bit, so linked fingerprints have coordinates within ``radius`` of each
other for every reference.  Random references alone give windows too wide to
search in 64 dimensions (a window of +-3 around a mean of 32 with deviation 4
holds nearly half of all fingerprints), so the references come in two sets:

* one-bit references, in ``groups`` disjoint groups of bit positions.  Relative
  to the zero reference, a group's coordinates are constant unless a bit of that
  group differs, and ``radius`` bits touch at most ``radius`` groups.  Linked
  fingerprints therefore agree in all coordinates of some choice of ``groups -
  radius`` groups: an equi-join key for every such choice (those coordinates are
  the fingerprint under the groups' mask).
* random references: within a key, a pair is discarded as soon as one
  coordinate differs by more than ``radius``; survivors are verified bit by bit.

Skew.  Equal fingerprints collapse to one row first, with partial sums.  Keys
held by more than ``cell`` fingerprints are dealt into chunks, and every pair of
chunks is a task's group of at most two chunks.  A group emits a spanning forest
of its links, never all pairs, so a large group of near copies costs rows in
proportion to its members while no link between components is lost.

Edge cases.  Null and empty texts and texts of white space have fingerprint zero
and link like any other; repeated rows each get their row; rows with a null id
take part and get the smallest non-null id of their component, or null; other
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.llm.common import components, stored

SEED = 42
RADIUS = 3
GROUPS = 6
REFERENCES = 32
CELL = 2048

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PLACE = np.arange(8, dtype=np.int64) * 256
_STEP = 1 << 16


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of one whole text given as UTF-8 bytes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros((8, 8))
    for at in range(0, n, _STEP):
        bytes_ = hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.bincount((bytes_ + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").ravel().view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one row for each input row."""

    def work(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, fp long")


def _masks(groups: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``groups - radius`` groups, as signed longs."""
    edges = [round(64 * i / groups) for i in range(groups + 1)]
    group = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(groups)]
    masks = [sum(chosen) for chosen in combinations(group, groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, pivots: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among one group's fingerprints.

    Each visit narrows the fingerprints not reached yet by one reference's
    coordinate after the other and verifies what is left.
    """
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    table = np.bitwise_count(pivots[:, None] ^ fps[None, :]).astype(np.int8)
    rest = np.arange(len(fps))
    links = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = rest
            for row in table:
                near = near[np.abs(row[near] - row[at]) <= radius]
                if len(near) < 8:
                    break
            near = near[np.bitwise_count(fps[near] ^ fps[at]) <= radius]
            if len(near):
                links += [(at, int(x)) for x in near]
                queue += near.tolist()
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return links


def links(distinct: DataFrame, radius: int = RADIUS, groups: int = GROUPS, references: int = REFERENCES, cell: int = CELL) -> DataFrame:
    """``(a, b)``: links that connect what all links among ``distinct(fp)`` connect."""
    masks = _masks(groups, radius)
    pivots = np.random.default_rng(SEED).integers(0, 2**64, references, dtype=np.uint64)

    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("k", "key"))
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(sizes, ["k", "key"]).withColumn("chunks", F.ceil(F.col("n") / cell).cast("int"))
    held = held.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # With one chunk there is one group; else every pair of chunks is one.
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("chunk")))
    held = held.select("fp", "k", "key", "chunk", F.explode(other).alias("with"))
    held = held.select("fp", F.xxhash64("k", "key", F.least("chunk", "with"), F.greatest("chunk", "with")).alias("g"), "k", "key", F.least("chunk", "with").alias("c"), F.greatest("chunk", "with").alias("d"))
    order = ["g", "k", "key", "c", "d"]

    def work(batches):
        kept = np.empty((0, 6), np.int64)

        def runs(rows):
            """Links of the groups in ``rows``, which are sorted by group."""
            if not len(rows):
                return None
            cuts = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)) + 1
            a, b = [], []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(rows)]):
                if hi - lo > 1:
                    fps = rows[lo:hi, 0].view(np.uint64) if rows.flags.f_contiguous else np.ascontiguousarray(rows[lo:hi, 0]).view(np.uint64)
                    for x, y in _forest(fps, pivots, radius):
                        a.append(int(rows[lo + x, 0]))
                        b.append(int(rows[lo + y, 0]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            rows = np.vstack([kept, rows])
            cuts = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0  # the last group may go on in the next batch
            kept = rows[last:]
            if (out := runs(rows[:last])) is not None:
                yield out
        if (out := runs(kept)) is not None:
            yield out

    return held.repartition("g").sortWithinPartitions(*order).mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, groups: int = GROUPS, references: int = REFERENCES, cell: int = CELL) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row for each input row.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest id
    reachable over links, the document's own included.
    """
    fps = stored(fingerprints(docs, doc_id, text), "fingerprints")
    first = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    label = components(links(first.select("fp"), radius, groups, references, cell)).toDF("fp", "label")
    label = stored(label, "labels")
    root = first.join(label, "fp").groupBy("label").agg(F.min("first").alias("component_id"))
    linked = label.join(root, "label").select("fp", "component_id")
    known = stored(first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "components")
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: one row each.

    A row is told by its id and its text, so ids given to several texts are safe;
    the group's smallest id stays.
    """
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    keyed = docs.select(key.alias("_key"), F.struct("*").alias("_row"))
    chosen = near_duplicates(docs.select(key.alias("doc_id"), F.col(text).alias("text")), **options).select(F.col("component_id").alias("_key")).distinct()
    return keyed.join(chosen, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
