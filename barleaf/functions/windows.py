"""Window helpers shared by every panel operator.

All of them use one partitioning (ticker) and one order (date), so a chain of
calls needs a single exchange.  A ticker holds at most one row per calendar
date, which bounds every window partition by the length of the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into the session's shuffle partition count.

    Long rolling frames cost far more CPU than their bytes suggest, so the
    exchange names its partition count: adaptive execution then keeps the
    tasks instead of merging a small-looking shuffle into one or two of them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *(keys or ("ticker",)))


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def by_date():
    return Window.partitionBy("date")



def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_rows(n: int, by=("ticker",), order=("date",)):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)


def roll(agg, x: Column | str, n: int, at_least: int | None = None, by=("ticker",), order=("date",)) -> Column:
    """Rolling aggregate over the last n rows, null until enough values exist.

    The guard is the difference of two growing counts: Spark updates growing
    frames in constant time per row, while a second sliding count would walk
    all n rows again.
    """
    need = n if at_least is None else at_least
    grow = Window.partitionBy(*by).orderBy(*order)
    seen = F.count(col(x)).over(grow.rowsBetween(Window.unboundedPreceding, 0))
    gone = F.count(col(x)).over(grow.rowsBetween(Window.unboundedPreceding, -n))
    return F.when(seen - gone >= need, agg(col(x)).over(last_rows(n, by, order)))


def back(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_ticker())


def carry(x: Column | str, by=("ticker",), order=("date",)) -> Column:
    """Forward fill: last non-null value up to and including this row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(col(x), ignorenulls=True).over(w)


def held(entry: Column, n: int) -> Column:
    """1.0 while any of the last n rows entered; null entries count as absent."""
    return F.max(entry.cast("double")).over(last_rows(n))


def latch(enter: Column, leave: Column) -> Column:
    """1.0 from an entry row until an exit row, 0.0 before the first entry."""
    return F.coalesce(carry(F.when(enter, 1.0).when(leave, 0.0)), F.lit(0.0))


def span_decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def half_life_decay(half_life: float) -> float:
    return math.exp(-math.log(2.0) / half_life)


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], skip_null_steps: bool = False) -> DataFrame:
    """Exponentially weighted means (adjusted form) by windows alone.

    ``specs`` maps output name to (input column, per-step decay).  The weighted
    sum obeys S_t = x_t + decay * S_(t-1); rows are cut into blocks so that the
    power decay**-i stays finite inside a block, and the closing state of the
    previous block is carried in.  A block is long enough that the weight of
    anything before the previous block is under 1e-18 of the newest one, below
    double precision.  With ``skip_null_steps`` the decay only advances on rows
    that have a value, otherwise on every row.
    """
    names = list(specs)
    for name in names:
        source, decay = specs[name]
        block = max(2, math.ceil(math.log(1e-18) / math.log(decay)))
        x = F.col(source).cast("double")
        seen = x.isNotNull()
        upto = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
        step = (
            F.sum(seen.cast("long")).over(upto) - 1
            if skip_null_steps
            else F.row_number().over(by_ticker()).cast("long") - 1
        )
        df = df.withColumn("_i", F.greatest(step, F.lit(0)))
        df = df.withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_j", F.col("_i") % block)
        inside = Window.partitionBy("ticker", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        up = F.pow(F.lit(1.0 / decay), F.col("_j"))
        down = F.pow(F.lit(decay), F.col("_j"))
        df = df.withColumn("_n", F.coalesce(F.sum(F.when(seen, x * up)).over(inside), F.lit(0.0)) * down)
        df = df.withColumn("_d", F.coalesce(F.sum(F.when(seen, up)).over(inside), F.lit(0.0)) * down)
        # closing state of a block sits on its last row; read it through the
        # block before this one, found as the last closing row seen so far
        closing = F.when(F.lead("_b").over(by_ticker()) != F.col("_b"), F.struct("_b", "_n", "_d"))
        df = df.withColumn("_close", closing)
        before = by_ticker().rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_prev", F.last("_close", ignorenulls=True).over(before))
        reach = F.col("_prev._b") == F.col("_b") - 1
        fade = F.pow(F.lit(decay), F.col("_j") + 1)
        df = df.withColumn("_n", F.col("_n") + F.when(reach, F.col("_prev._n") * fade).otherwise(0.0))
        df = df.withColumn("_d", F.col("_d") + F.when(reach, F.col("_prev._d") * fade).otherwise(0.0))
        df = df.withColumn(name, F.when(F.col("_d") > 0, F.col("_n") / F.col("_d")))
    return df.drop("_i", "_b", "_j", "_n", "_d", "_close", "_prev")


def running_max(df: DataFrame, value: str, name: str, by: tuple[str, ...], order: tuple[str, ...], part: str) -> DataFrame:
    """Running maximum of ``value`` in two levels: inside parts of the order, and over the parts' maxima.

    ``part`` cuts the order into runs (an hour, a block of ids), so a group of
    any size is spread over its parts and only one row per part meets its
    neighbours.
    """
    tops = df.groupBy(*by, part).agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, part, F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.join(carried, [*by, part])
    return rows.withColumn(name, F.greatest(F.max(value).over(inside), F.col("_before"))).drop("_before")
