"""Option term structures and trading-day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_structure(quotes: DataFrame, spot: Column, nearest: int = 5) -> DataFrame:
    """Median volatility of each leg's five strikes nearest the money, per expiry.

    ``quotes``: chain, days, leg, strike, iv.  The rank limit keeps at most five
    rows of a leg before the shuffle, so the median sees ten values.
    """
    order = Window.partitionBy("chain", "days", "leg").orderBy(F.abs(F.col("strike") - spot), "strike", "iv")
    near = quotes.dropna(subset=["strike", "iv"]).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= nearest)
    return near.filter("iv > 0.01 and iv < 5").groupBy("chain", "days").agg(F.median("iv").alias("iv"))


def at_horizons(term: DataFrame, horizons: list[int]) -> DataFrame:
    """Linear interpolation at each horizon, flat beyond both ends."""
    rows = term.select("chain", "days", "iv", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    below, above = F.col("days") <= F.col("horizon"), F.col("days") >= F.col("horizon")
    ends = rows.groupBy("chain", "horizon").agg(
        F.max_by(F.struct("days", "iv"), F.when(below, F.col("days"))).alias("lo"), F.min_by(F.struct("days", "iv"), F.when(above, F.col("days"))).alias("hi"),
        F.max(below).alias("_b"), F.max(above).alias("_a"),
    )
    share = (F.col("horizon") - F.col("lo.days")) / F.nullif(F.col("hi.days") - F.col("lo.days"), F.lit(0))
    between = F.col("lo.iv") + (F.col("hi.iv") - F.col("lo.iv")) * F.coalesce(share, F.lit(0.0))
    value = F.when(~F.col("_b"), F.col("hi.iv")).when(~F.col("_a"), F.col("lo.iv")).otherwise(between)
    return ends.select("chain", "horizon", value.alias("iv"))


def add_trading_days(start: Column, n: int) -> Column:
    """The n-th weekday after a date, by arithmetic on week numbers."""
    day = F.weekday(start)
    base = F.when(day > 4, F.date_sub(start, (day - 4).cast("int"))).otherwise(start)
    total = F.least(day, F.lit(4)) + n
    return F.date_add(base, (F.floor(total / 5) * 7 + total % 5 - F.least(day, F.lit(4))).cast("int"))
