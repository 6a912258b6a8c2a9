"""Position sizing, limits, allocation and orders.

A book is the set of names that share a ``by`` key (a date, by default).  It
holds at most one row per name, so sums within a book are windows over that key:
one exchange serves every step of a sizing chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.operators.evaluate import drawdowns

BOOK = ("date",)


def total(df: DataFrame, value: Column, name: str, by=BOOK) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def equal_weight(weights: DataFrame) -> DataFrame:
    """1/n over the positive weights of each date."""
    live = weights.filter("weight > 0")
    return live.select("date", "ticker", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def vol_target(weights: DataFrame, vol: DataFrame, target: float = 0.15, column: str = "vol_20d") -> DataFrame:
    """Weight times target/volatility, clipped to [0, 5]; unknown vol leaves it."""
    df = weights.join(vol.select("date", "ticker", column), ["date", "ticker"], "left")
    scale = F.when(F.col(column).isNotNull(), F.least(F.greatest(target / F.greatest(column, F.lit(1e-4)), F.lit(0.0)), F.lit(5.0)))
    return df.select("date", "ticker", (F.col("weight") * F.coalesce(scale, F.lit(1.0))).alias("weight"))


def kill_switch(weights: DataFrame, daily: DataFrame, threshold: float) -> DataFrame:
    """Zero every weight from the first date whose drawdown passes the limit."""
    breach = drawdowns(daily).filter(F.col("drawdown") < -abs(threshold)).agg(F.min("date")).scalar()
    stopped = F.coalesce(F.col("date") >= breach, F.lit(False))
    return weights.withColumn("weight", F.when(stopped, 0.0).otherwise(F.col("weight")))


def band_sized(bands: DataFrame, fraction: float = 0.5, cap: float = 0.10, floor: float = 0.02, min_edge: float = 0.0, by=BOOK) -> DataFrame:
    """Reward-to-downside scores to capped fractional weights, gross at most 1."""
    edge = F.col("median")
    live = bands.filter(edge > min_edge).withColumn("_s", edge / F.greatest(F.lit(floor), -F.col("lo")))
    df = total(live, F.col("_s"), "_sum", by)
    df = df.withColumn("weight", F.least(fraction * F.col("_s") / F.col("_sum"), F.lit(cap)))
    df = total(df, F.col("weight"), "_gross", by)
    return df.withColumn("weight", F.when(F.col("_gross") > 1, F.col("weight") / F.col("_gross")).otherwise(F.col("weight"))).drop("_s", "_sum", "_gross")


def cap_and_redistribute(weights: DataFrame, cap: float, by=BOOK) -> DataFrame:
    """Cap weights and spread the excess pro rata, in closed form.

    Spreading pro rata scales all uncapped names by one factor, so the result is
    min(cap, factor * weight).  Names are capped from the largest down: the one
    at rank r is capped when the factor left after capping the r-1 above it
    still lifts it over the cap.  When even that cannot be met the rest stays
    uninvested.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "ticker")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    df = total(weights, F.col("weight"), "_all", by)
    df = df.withColumn("_r", F.row_number().over(order) - 1).withColumn("_above", F.coalesce(F.sum("weight").over(above), F.lit(0.0)))
    factor = (F.col("_all") - F.col("_r") * cap) / (F.col("_all") - F.col("_above"))
    df = df.withColumn("_capped", (factor * F.col("weight") > cap + 1e-12).cast("int"))
    # capped names form a prefix; the first one that is not fixes the factor
    df = df.withColumn("_factor", F.when(F.col("_capped") == 0, factor))
    book, free = Window.partitionBy(*by), F.when(F.col("_capped") == 0, F.col("_r"))
    df = df.withColumns({"_lift": F.min_by("_factor", free).over(book), "_k": F.min(free).over(book)})
    lifted = F.when(F.col("_k").isNull() | (F.col("_r") < F.col("_k")), F.lit(cap)).otherwise(F.col("_lift") * F.col("weight"))
    return df.withColumn("weight", lifted).drop("_all", "_r", "_above", "_capped", "_factor", "_lift", "_k")


def blend(conviction: DataFrame, parity: DataFrame, share: float = 0.5, cap: float = 0.25, by=BOOK) -> DataFrame:
    """(1-share) conviction + share parity, each normalised; books without a
    parity leg (too little history) use equal weights for it."""
    keys = [*by, "ticker"]
    k = total(conviction.withColumn("_k", F.greatest("score", F.lit(0.0))), F.col("_k"), "_ksum", by)
    k = k.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).join(parity.select(*keys, F.col("weight").alias("_h")), keys, "left")
    lead = F.when(F.col("_ksum") > 0, F.col("_k") / F.col("_ksum")).otherwise(1.0 / F.col("_n"))
    raw = k.withColumn("weight", (1.0 - share) * lead + share * F.coalesce("_h", 1.0 / F.col("_n")))
    raw = total(raw, F.col("weight"), "_wsum", by).withColumn("weight", F.col("weight") / F.col("_wsum"))
    return cap_and_redistribute(raw.select(*keys, "weight"), cap, by)


def to_positions(weights: DataFrame, deployable: Column, min_position: float = 50.0, by=BOOK) -> DataFrame:
    """Weights (with a price) to dollars and shares; positions under the minimum
    are dropped once and their weight shared among the rest."""
    live = weights.filter(F.col("price") > 0)
    df = total(live, F.col("weight"), "_sum", by).withColumn("weight", F.col("weight") / F.col("_sum"))
    df = df.withColumn("_big", F.col("weight") * deployable >= min_position)
    kept = F.sum(F.when(F.col("_big"), F.col("weight"))).over(Window.partitionBy(*by))
    df = df.withColumn("_kept", kept).filter(F.col("_big") | F.col("_kept").isNull())
    df = df.withColumn("weight", F.col("weight") / F.coalesce("_kept", F.lit(1.0)))
    df = df.withColumn("dollars", F.col("weight") * deployable)
    return df.withColumn("shares", F.col("dollars") / F.col("price")).withColumn("whole_shares", F.floor(F.col("dollars") / F.col("price"))).drop("_sum", "_big", "_kept")


def to_orders(target: DataFrame, holdings: DataFrame, prices: DataFrame, equity: Column, min_notional: float = 1.0) -> DataFrame:
    """Difference between target and held quantity as buy and sell orders."""
    both = target.select("ticker", "weight").join(holdings.select("ticker", F.col("qty").alias("_held")), "ticker", "full")
    df = both.join(prices.select("ticker", "price"), "ticker").filter(F.col("price") > 0)
    qty = F.coalesce("weight", F.lit(0.0)) * equity / F.col("price") - F.coalesce("_held", F.lit(0.0))
    df = df.withColumn("qty", qty).withColumn("notional", F.abs(F.col("qty") * F.col("price")))
    return df.filter(F.col("notional") >= min_notional).select(
        "ticker", "qty", F.when(F.col("qty") > 0, "buy").otherwise("sell").alias("side"), "notional"
    )


# Names per tier and the tier's largest share of the budget.
TIERS = ((5, 0.15), (10, 0.09), (5, 0.05))
CASH_RESERVE, SCORE_CAP, TOP_N = 0.25, 0.05, 20


def wanted_dollars(score: Column, vol: Column, share: Column, budget: float) -> Column:
    """Budget share scaled by score (to its cap) and by 20 % over volatility."""
    calm = F.least(0.20 / F.greatest(F.coalesce(vol, F.lit(0.20)), F.lit(0.04)), F.lit(2.5))
    return budget * share * F.least(score / SCORE_CAP, F.lit(1.0)) * calm


def spend_in_order(df: DataFrame, limit: float, stop_below: float, by=BOOK) -> DataFrame:
    """Give each name its wish while the running sum leaves room.

    A name gets min(wish, what is left); the first one that finds less than
    ``stop_below`` ends the book.  ``_wish`` is positive, so what is left before
    a name depends only on the wishes above it and one running sum decides.
    """
    above = Window.partitionBy(*by).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_left", limit - F.coalesce(F.sum("_wish").over(above), F.lit(0.0)))
    return df.filter(F.col("_left") >= stop_below).withColumn("allocated", F.least("_wish", "_left")).drop("_left")


def tiered_allocation(candidates: DataFrame, budget: float, by=BOOK) -> DataFrame:
    """Top 20 (ticker, score, price, vol_20d) of a book into three tiers.

    A wish is at least the smallest position and at most the tier's share; 25 %
    of the budget stays in cash.  Names without a price keep their rank.
    """
    smallest = max(50.0, budget * 0.005)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "ticker")
    df = candidates.withColumn("_rank", F.row_number().over(order) - 1).filter(F.col("_rank") < TOP_N).filter(F.col("price") > 0)
    tier, share = F.lit(len(TIERS)), F.lit(TIERS[-1][1])
    for number, (size, cap) in reversed(list(enumerate(TIERS, 1))):
        inside = F.col("_rank") < sum(n for n, _ in TIERS[:number])
        tier, share = F.when(inside, number).otherwise(tier), F.when(inside, cap).otherwise(share)
    wish = F.least(wanted_dollars(F.col("score"), F.col("vol_20d"), share, budget), budget * share)
    df = df.withColumn("tier", tier).withColumn("_wish", F.greatest(F.lit(smallest), wish))
    df = spend_in_order(df, budget * (1.0 - CASH_RESERVE), smallest, by)
    return df.withColumn("shares", F.col("allocated") / F.col("price")).drop("_wish", "_rank")


def top_up_allocation(candidates: DataFrame, held: DataFrame, budget: float, cash: float, min_score: float = 0.005, by=BOOK) -> DataFrame:
    """Spend cash above the reserve on names not held whose score clears a bar."""
    room = cash - budget * CASH_RESERVE
    df = candidates.filter((F.col("score") >= min_score) & (F.col("price") > 0)).join(held, [*by, "ticker"], "left_anti")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "ticker")
    wish = F.greatest(F.lit(50.0), wanted_dollars(F.col("score"), F.col("vol_20d"), F.lit(0.09), budget))
    df = df.withColumn("_rank", F.row_number().over(order)).withColumn("_wish", wish)
    df = spend_in_order(df, room, 50.0, by)
    return df.withColumn("shares", F.col("allocated") / F.col("price")).drop("_wish", "_rank")
