"""Near copies by the similarity of word shingle sets.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is ``SIMILARITY`` or more.  SimHash at a few bits reaches only the
closest of these; min-wise hashing reaches all but about 4 in 10,000 at 0.8
(``BANDS`` bands of ``ROWS`` minima), and fewer above.  Every link is verified on
the whole texts.

Buckets.  Documents that agree in a band share a bucket.  A band is one long:
``LANE`` bits of each of its minima, so equal minima always agree and unequal ones
once in 4,096 times.  In each round the first ``LEADERS`` members of a bucket, in
one order for all buckets, meet all the others.  Before a pair leaves their join
it must pass the bound that the set sizes give, and agree in ``AGREE`` of the
minima, which the bands of both sides tell (a pair at 0.8 agrees in 80 of 100 on
average, and in fewer than 50 once in 10^11 times).  It must also be able to reach
the similarity by both sides' masks.  A mask holds the parity of the set's shingles
at ``SPREAD`` or more positions a shingle, so every position in which two masks
differ stands for a shingle that only one side has: a bound that loses no link, and
near enough that a crowd's pairs below the similarity don't leave the join.  Masks
have a power of two of positions, and the longer one is folded to the shorter.
Texts are read for the pairs that are left.  Linked documents become one,
the leaders have met their bucket and leave it, and the next round has ``MORE``
times as many leaders, so rounds grow with the logarithm of a bucket.  A pair that
shares several buckets counts in the first of them only.  At the end no
two kept documents of one bucket are unmet, and whatever went is linked to a kept
document, directly or by a chain of links.

Traffic.  The rows are written once with their bands; sets are never
written, and only the texts of candidate pairs are shuffled.  Rows that go are
told by their number, and the others don't move while Spark finds the list small
enough to broadcast.

Skew.  Documents of equal sets collapse first.  A bucket's leaders come from
``PARTS`` partial rankings; its members meet the leaders by an equi-join that
adaptive execution can split; a leader's pairs are verified in slices of ``SLICE``.

Edge cases.  Case is ignored, words end at white space.  A text of fewer words is
one shingle, null and empty texts are equal.  Of equal rows and of each group the
first in storage order stays.  Sets collapse by the SHA-256 of their hashes;
shingles are compared by 64-bit hashes.  All columns are kept whatever their
names.  Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barleaf.llm.common import components, parts, stored

SEED = 42
WIDTH = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
AGREE = 50
LANE = 12
SPREAD = 2
LEADERS = 2
MORE = 8
PARTS = 64
SLICE = 512
BUCKET = ["band", "bucket"]

_STEP = 2048
# a band's lanes, all but their upper bits, and those upper bits
_LOW = sum((1 << LANE - 1) - 1 << LANE * k for k in range(ROWS))
_HIGH = sum(1 << LANE * k + LANE - 1 for k in range(ROWS))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = (text or b"").lower().split()
    found = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of ``BANDS`` x ``ROWS`` permutations."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _STEP):
        least = np.minimum(least, (hashes[None, at : at + _STEP] * a + b).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One long for each band: middle bits of its minima side by side (the upper bits of a minimum are mostly zero)."""
    lanes = (least >> np.uint64(20) & np.uint64((1 << LANE) - 1)).astype(np.int64).reshape(BANDS, ROWS)
    return (lanes << LANE * np.arange(ROWS)).sum(axis=1)


def mask(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes at each of a power of two of positions, as longs."""
    longs = 1 << (max(1, -(-SPREAD * len(hashes) // 64)) - 1).bit_length()
    odd = np.bincount((hashes & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _agreeing(x: Column, y: Column) -> Column:
    """Minima in which two documents' bands agree."""

    def unlike(x: Column, y: Column) -> Column:
        v = x.bitwiseXOR(y)
        return F.bit_count((v.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(v).bitwiseAND(F.lit(_HIGH)))

    return F.lit(BANDS * ROWS) - F.aggregate(F.zip_with(x, y, unlike), F.lit(0), lambda s, n: s + n)


def _unshared(x: Column, y: Column) -> Column:
    """At least so many shingles are in one of the sets only, by their masks; 0 where these are not within a factor of two."""

    def folded(v: Column) -> Column:
        half = F.shiftright(F.size(v), 1)
        return F.zip_with(F.slice(v, F.lit(1), half), F.slice(v, half + 1, half), lambda a, b: a.bitwiseXOR(b))

    def differing(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)

    p, q = F.size(x), F.size(y)
    return F.when(p == q, differing(x, y)).when(p == 2 * q, differing(folded(x), y)).when(2 * p == q, differing(x, folded(y))).otherwise(F.lit(0))


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """``rows(row, text, number)`` with the set's digest, size, bands and mask; the text stays in the row."""

    def work(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                sets = [shingles(t, width) for t in some.column(1).to_pylist()]
                columns = [pa.array([hashlib.sha256(s).digest() for s in sets], pa.binary()), pa.array(map(len, sets), pa.int64()), *(pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (lambda s: bands(minima(s)), mask))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *columns], ["row", "number", "digest", "n", "buckets", "mask"])

    schema = rows.select("row", "number").schema.add("digest", T.BinaryType()).add("n", T.LongType()).add("buckets", T.ArrayType(T.LongType())).add("mask", T.ArrayType(T.LongType()))
    return rows.mapInArrow(work, schema)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(a, b)``: the ``pairs(node, head)`` whose whole texts are similar; a head's set is made once for a slice of its pairs."""
    spark = pairs.sparkSession
    slices = pairs.groupBy("head").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    dealt = pairs.join(slices, "head").withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    members = dealt.select("head", "slice", "node").join(texts, "node")
    heads = slices.select("head", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("node"))
    heads = heads.join(texts.withColumnRenamed("node", "head"), "head").select("head", "slice", "node", "text")
    rows = heads.unionByName(members.select("head", "slice", "node", "text"))
    rows = rows.repartition(parts(spark), "head", "slice").sortWithinPartitions("head", "slice", F.col("node").asc_nulls_first())

    def work(batches):
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for head, node, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                one = shingles(text, width)
                if node is None:
                    mine = one
                    continue
                both = len(np.intersect1d(mine, one, assume_unique=True))
                if both >= similarity * (len(mine) + len(one) - both):
                    a.append(node)
                    b.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


def _leaders(members: DataFrame, n: int) -> DataFrame:
    """``(band, bucket, head, m, theirs, their_mask)``: the first ``n`` members of every bucket in the order of their numbers' hash."""
    order = F.xxhash64("node")
    part = Window.partitionBy("band", "bucket", F.pmod(order, F.lit(PARTS))).orderBy(order, "node")
    some = members.withColumn("at", F.row_number().over(part)).where(F.col("at") <= n)
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("band", "bucket").orderBy(order, "node"))).where(F.col("at") <= n)
    return some.select("band", "bucket", F.col("node").alias("head"), F.col("n").alias("m"), F.col("buckets").alias("theirs"), F.col("mask").alias("their_mask"))


def _met(members: DataFrame, heads: DataFrame, similarity: float, agree: int) -> DataFrame:
    """``(node, head)`` of the members and leaders of a bucket that may be similar, each pair once."""
    # the bands of both sides tell whether a pair has met in an earlier one
    first = F.array_position(F.zip_with("buckets", "theirs", lambda x, y: x == y), True) == F.col("band") + 1
    bound = (F.col("node") != F.col("head")) & (F.least("n", "m") >= similarity * F.greatest("n", "m"))
    # two leaders of a bucket meet once
    once = ~(F.col("leads") & (F.col("node") < F.col("head")))
    led = members.join(heads.select(*BUCKET, F.col("head").alias("node"), F.lit(True).alias("is_head")), [*BUCKET, "node"], "left").withColumn("leads", F.coalesce("is_head", F.lit(False)))
    # as many shared shingles as the masks allow, held against the similarity just as the sets will be
    most = (F.col("n") + F.col("m") - _unshared(F.col("mask"), F.col("their_mask"))) / 2
    reach = most >= similarity * (F.col("n") + F.col("m") - most)
    fits = bound & once & first & (_agreeing(F.col("buckets"), F.col("theirs")) >= agree) & reach
    return led.join(heads, BUCKET).where(fits).select("node", "head")


def representatives(docs: DataFrame, text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, agree: int = AGREE) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of near copies: one row each."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("number"))
    signed = stored(_signed(rows, width), "signed")
    # equal sets are one node, told by its first row's number
    nodes = signed.groupBy("digest").agg(F.min("number").alias("node"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("mask").alias("mask"))
    nodes = stored(nodes.drop("digest"), "nodes")
    texts = signed.select(F.col("number").alias("node"), F.col(f"row.`{text}`").cast("binary").alias("text"))
    kept = nodes.select("node")

    def shared(members: DataFrame) -> DataFrame:
        """Members of buckets with company."""
        sizes = members.groupBy(BUCKET).agg(F.count("*").alias("size")).where("size > 1").select(BUCKET)
        return members.join(sizes, BUCKET, "left_semi")

    thin = shared(nodes.select("node", F.posexplode("buckets").alias("band", "bucket")))
    members, leaders = stored(thin.join(nodes.select("node", "n", "buckets", "mask"), "node"), "members"), LEADERS
    while not members.isEmpty():
        heads = stored(_leaders(members, leaders), "heads")
        pairs = stored(_met(members, heads, similarity, agree), "pairs")
        links = stored(_verified(pairs, texts, width, similarity), "links")
        met = heads.select(*BUCKET, F.col("head").alias("node"))
        rest = members.join(met, [*BUCKET, "node"], "left_anti")
        if not links.isEmpty():
            linked = components(links)
            gone = stored(linked.where("node != label").select("node"), "copies")
            kept, rest = kept.join(gone, "node", "left_anti"), rest.join(gone, "node", "left_anti")
        members = stored(shared(rest), "members")
        leaders *= MORE

    dropped = stored(signed.select("number").join(kept.withColumnRenamed("node", "number"), "number", "left_anti"), "dropped")
    return signed.select("number", "row").join(dropped, "number", "left_anti").select("row.*")
