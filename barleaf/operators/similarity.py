"""Set-similarity joins: pairs of token sets with a Jaccard similarity of at least t.

Tokens are ordered from rare to frequent, by counts per hash bucket.  Two similar sets share one of each
other's first ``size - ceil(t size) + 1`` tokens, so only those are joined.  A
candidate must pass three bounds before it leaves the join: the sizes, the
tokens left behind the shared one (which holds at the pair's first common
token, where every true pair is met), and the bits in which two 256-bit token
masks differ.  Survivors are verified on the whole sets.

A token's group may hold any share of all sets.  Its left side is dealt into
cells of ``CELL`` sets and its right side is sent to each of them, so no task
meets a whole group.

Below ``COUNTED`` a prefix leaves out so little of a set that its rows, masks and
verification cost more than they save: there the shared tokens of every pair are
counted.  Left sets whose size fits no right set go first; the rest travel once,
whole, by id, so where Spark broadcasts the right side's tokens a pair is counted
in the task that holds its left set, and only similar pairs leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barleaf.functions.text import jaccard

CELL = 4096
#: Thresholds from which prefixes are used.
COUNTED = 0.3
#: Hash buckets of tokens that are counted: a table of fixed size, which may be broadcast.
BUCKETS = 1 << 18
MASKS = ["_m0", "_m1", "_m2", "_m3"]


def bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def masked(sets: DataFrame) -> DataFrame:
    """``sets`` with the size of ``tokens`` and a 256-bit mask of their hashes."""

    def mask(k: int) -> Column:
        # the low six bits pick the bit, the next two the mask
        spot = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
        return F.aggregate("_hashes", F.lit(0).cast("long"), lambda m, h: F.when(F.pmod(F.shiftright(h, 6), F.lit(4)) == k, m.bitwiseOR(spot(h))).otherwise(m))

    rows = sets.withColumns({"size": F.size("tokens"), "_hashes": F.transform("tokens", lambda t: F.xxhash64(t))})
    return rows.withColumns({m: mask(k) for k, m in enumerate(MASKS)}).drop("_hashes")


def frequencies(*sides: DataFrame) -> DataFrame:
    """Sets per hash bucket of tokens over all sides; at most ``BUCKETS`` rows."""
    rows = None
    for s in sides:
        some = s.select(F.explode("tokens").alias("token"))
        rows = some if rows is None else rows.unionByName(some)
    return rows.groupBy(bucket("token").alias("_bucket")).agg(F.count("*").alias("_df"))


def prefixes(sets: DataFrame, often: DataFrame, key: Sequence[str], threshold: float) -> DataFrame:
    """One row per set and prefix token: key, size, masks, ``token`` and its place ``_at`` in the set's order.

    Any order that all sets share is right; the counts of ``often`` only make it
    one from rare to frequent.  ``sets`` are dealt by key, so tokens meet their
    counts and each other in the task that holds the set.
    """
    spark = sets.sparkSession
    dealt = sets.select(*key, "tokens").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    tokens = dealt.withColumn("tokens", F.explode("tokens")).withColumn("_bucket", bucket("tokens")).join(F.broadcast(often), "_bucket")
    order = F.sort_array(F.collect_list(F.struct("_df", F.col("tokens").alias("token"))))
    whole = tokens.groupBy(*key).agg(order.alias("_order")).withColumn("tokens", F.transform("_order", lambda t: t["token"]))
    whole = masked(whole).drop("tokens")
    n = F.size("_order")
    front = F.slice("_order", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    ranked = whole.select(*key, "size", *MASKS, F.posexplode(front).alias("_at", "_t"))
    return ranked.select(*key, "_at", F.col("_t.token").alias("token"), "size", *MASKS)


def candidates(left: DataFrame, right: DataFrame, within: Sequence[str], a: str, b: str, threshold: float, when: Column | None = None) -> DataFrame:
    """Distinct (within, a, b) of prefix rows that pass every bound; ``a`` names the left id, ``b`` the right one."""
    group = [*within, "token"]
    large = left.groupBy(*group).agg(F.count("*").alias("_held")).filter(F.col("_held") > CELL)
    cells = F.ceil(F.coalesce("_held", F.lit(1)) / CELL).cast("int")
    one = left.join(large, group, "left").withColumn("_cell", F.pmod(F.xxhash64(a), cells).cast("int")).drop("_held")
    many = right.join(large, group, "left").withColumn("_cell", F.explode(F.sequence(F.lit(0), cells - 1))).drop("_held")
    many = many.select(*group, "_cell", b, *[F.col(c).alias(f"{c}_r") for c in ("size", "_at", *MASKS)])
    both = one.join(many, [*group, "_cell"])
    small, big = F.least("size", "size_r"), F.greatest("size", "size_r")
    total = F.col("size") + F.col("size_r")
    shared = F.ceil(total * (threshold / (1 + threshold)) - 1e-9)
    behind = F.least(F.col("size") - F.col("_at"), F.col("size_r") - F.col("_at_r"))
    differ = sum(F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_r"))) for m in MASKS)
    fits = (small >= threshold * big - 1e-9) & (behind >= shared) & (differ <= total - 2 * shared)
    both = both.filter(fits if when is None else fits & when)
    return both.select(*within, a, b).distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, within: Sequence[str], a: str, b: str, threshold: float) -> DataFrame:
    """(within, a, b, jaccard) of the pairs that reach the threshold on the whole sets."""
    pairs = pairs.join(left.select(*within, a, F.col("tokens").alias("_ta")), [*within, a]).join(right.select(*within, b, F.col("tokens").alias("_tb")), [*within, b])
    return pairs.select(*within, a, b, jaccard("_ta", "_tb").alias("jaccard")).filter(F.col("jaccard") >= threshold)


def counted(left: DataFrame, right: DataFrame, within: Sequence[str], a: str, b: str, threshold: float) -> DataFrame:
    """(within, a, b, jaccard) of the pairs that reach the threshold, by the number of tokens that each pair shares."""
    one, other = (s.select(*within, i, "tokens", F.size("tokens").alias(n)) for s, i, n in ((left, a, "size"), (right, b, "size_r")))
    # empty sets share nothing; a filter on the left would make its sets twice
    limits = other.filter("size_r > 0").agg(F.min("size_r").alias("_least"), F.max("size_r").alias("_most"))  # one row
    fits = (F.col("size") >= threshold * F.col("_least") - 1e-9) & (threshold * F.col("size") <= F.col("_most") + 1e-9)
    one = one.crossJoin(F.broadcast(limits)).filter(fits).select(*within, a, "size", "tokens")
    # a named count, as pairs weigh more than the rows that adaptive execution would merge by
    one = one.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *within, a)
    both = one.withColumn("tokens", F.explode("tokens")).join(other.withColumn("tokens", F.explode("tokens")), [*within, "tokens"])
    pairs = both.groupBy(*within, a, b, "size", "size_r").agg(F.count("*").alias("_k"))
    return pairs.select(*within, a, b, (F.col("_k") / (F.col("size") + F.col("size_r") - F.col("_k"))).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def similar(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float, within: Sequence[str] = ()) -> DataFrame:
    """(within, a, b, jaccard) of every pair of a left and a right set with at least the threshold.

    ``left`` and ``right`` need (within, id, tokens) with distinct tokens and one
    row per id; empty sets are similar to none.
    """
    if threshold < COUNTED:
        return counted(left, right, within, a, b, threshold)
    one, other = (s.filter(F.size("tokens") > 0) for s in (left, right))
    often = frequencies(one, other)
    pairs = candidates(prefixes(one, often, [*within, a], threshold), prefixes(other, often, [*within, b], threshold), within, a, b, threshold)
    return verified(pairs, one, other, within, a, b, threshold)
