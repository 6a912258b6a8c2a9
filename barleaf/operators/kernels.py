"""Kernels that turn scores into target weights.

Ranks are taken inside one date.  A rule that only acts on rebalance dates ranks
only those dates: the kept dates are found first on a one-row-per-date table and
semi-joined before any ranking.  Holding a weight until the next rebalance is an
interval from one period to the next, expanded by an equi-join on the period
number, so no dates x tickers product is formed and then filled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Weigher = Callable[[DataFrame], DataFrame]


def expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def rank_in_date(score: str | Column, ascending: bool = False, by: tuple[str, ...] = ("date",)) -> Column:
    """Ordinal rank, ties by ticker, null where the score is null."""
    c = expr(score)
    order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return F.when(c.isNotNull(), F.row_number().over(Window.partitionBy(*by).orderBy(order, F.col("ticker").asc())))


def book(df: DataFrame, weight: Column) -> DataFrame:
    return df.select("date", "ticker", weight.cast("double").alias("weight"))


def top_k(df: DataFrame, score: str | Column, k: int, ascending: bool = False) -> DataFrame:
    """1/k for the k best names of each date, 0 for the rest."""
    return book(df, F.when(rank_in_date(score, ascending) <= k, 1.0 / k).otherwise(0.0))


def long_short(df: DataFrame, score: str, k: int) -> DataFrame:
    """+1/k for the k best, -1/k for the k worst; the long side wins overlaps."""
    ranked = df.withColumn("_rk", rank_in_date(score)).withColumn(
        "_n", F.count("*").over(Window.partitionBy("date"))
    )
    w = F.when(F.col("_rk") <= k, 1.0 / k).when(F.col("_rk") > F.col("_n") - k, -1.0 / k).otherwise(0.0)
    return book(ranked, w)


def inverse_share(df: DataFrame, value: Column, floor: float, cap: float) -> DataFrame:
    """Weight 1/max(value, floor), normalised within the date, then capped."""
    scaled = df.withColumn("_inv", 1.0 / F.greatest(value, F.lit(floor)))
    return share(scaled, F.col("_inv"), cap)


def share(df: DataFrame, value: Column, cap: float) -> DataFrame:
    whole = F.sum(value).over(Window.partitionBy("date"))
    return book(df, F.least(F.greatest(value / whole, F.lit(0.0)), F.lit(cap)))


def standardised(c: str, by: str = "date") -> Column:
    """Cross-section z-score with the sample deviation."""
    w = Window.partitionBy(by)
    return (F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + 1e-8)


def kept_dates(rows: DataFrame, every: int) -> DataFrame:
    """Every n-th distinct date of ``rows`` with its period number from 1.

    The numbering window runs on a table of one row per date.
    """
    order = Window.orderBy("date")
    dates = rows.select("date").distinct().withColumn("_i", F.row_number().over(order) - 1)
    return dates.filter(F.col("_i") % every == 0).select("date", (F.col("_i") / every + 1).cast("int").alias("_period"))


def hold_between(sparse: DataFrame, tickers: DataFrame, kept: DataFrame, features: DataFrame) -> DataFrame:
    """Carry each rebalance weight to the dates before the name's next one.

    ``sparse`` holds (date, ticker, weight) on kept dates.  Dates are numbered
    by the period they fall in, 0 before the first kept date.  A name absent
    from a rebalance date keeps its older weight; one without any holds 0.
    """
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cal = features.select("date").distinct().join(kept, "date", "left")
    cal = cal.select("date", F.coalesce(F.max("_period").over(upto), F.lit(0)).alias("_period"))
    marks = sparse.filter(F.col("weight").isNotNull()).join(kept, "date").select("ticker", "_period", "weight")
    start = tickers.select("ticker", F.lit(0).alias("_period"), F.lit(0.0).alias("weight"))
    upcoming = F.lead("_period").over(Window.partitionBy("ticker").orderBy("_period"))
    final = kept.agg(F.max("_period")).scalar()
    spans = marks.unionByName(start).withColumn("_to", F.coalesce(upcoming - 1, final)).filter("_to >= _period")
    spread = spans.select("ticker", "weight", F.explode(F.sequence("_period", "_to")).alias("_period"))
    return spread.join(cal, "_period").select("date", "ticker", "weight")


def rebalance(signal: DataFrame, features: DataFrame, every: int) -> DataFrame:
    """Keep every n-th signal date of finished weights and hold in between."""
    kept = kept_dates(signal, every)
    return hold_between(signal, signal.select("ticker").distinct(), kept, features)


def rebalance_rows(rows: DataFrame, weigh: Weigher, features: DataFrame, every: int) -> DataFrame:
    """As ``rebalance`` for weights that depend on one date's rows only.

    The rows of dates that are not kept are dropped before ``weigh`` ranks.
    """
    kept = kept_dates(rows, every)
    sparse = weigh(rows.join(kept.select("date"), "date", "left_semi"))
    return hold_between(sparse, rows.select("ticker").distinct(), kept, features)
