"""Latest-row selections, screens, rule scores, stances and tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_cross_section(df: DataFrame) -> DataFrame:
    """Rows at the newest date, found by a scalar subquery the scan can use."""
    return df.filter(F.col("date") == df.agg(F.max("date")).scalar())


def latest_per_ticker(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each ticker's newest row by a partial maximum, without sorting rows."""
    row = F.max_by(F.struct("date", *columns), "date").alias("_r")
    return df.groupBy("ticker").agg(row).select("ticker", "_r.*")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def screen(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]], sort_by: str, ascending: bool = False) -> DataFrame:
    """Keep rows inside every (low, high) bound whose column exists, sorted."""
    for column, (low, high) in bounds.items():
        if column in df.columns:
            df = df.filter(F.col(column) >= low) if low is not None else df
            df = df.filter(F.col(column) <= high) if high is not None else df
    order = F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last()
    return df.orderBy(order, "ticker")


def recent_events(events: DataFrame, days: int = 14, newest: int = 20) -> DataFrame:
    """Per ticker the newest 20 events of the trailing window (a report limit)."""
    last = events.agg(F.max("known_at")).scalar()
    near = events.filter(F.col("known_at") >= last - F.expr(f"interval {days} days"))
    rows = near.withColumn("ticker", F.explode("tickers"))
    order = Window.partitionBy("ticker").orderBy(F.desc("known_at"), F.desc("event_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= newest)


def place_in_universe(df: DataFrame, score: str = "mom_20d") -> DataFrame:
    """Rank and universe size at the newest date, nulls last."""
    today = latest_cross_section(df)
    by_score = Window.orderBy(F.col(score).desc_nulls_last(), "ticker")
    return today.select("date", "ticker", score, F.row_number().over(by_score).alias("rank_in_universe"), F.count("*").over(Window.partitionBy()).alias("universe_size"))


def top_and_bottom(df: DataFrame, score: str = "mom_20d", n: int = 10) -> DataFrame:
    """The n best and n worst names of the newest date as ordered lists."""
    ranked = place_in_universe(df, score)
    best = ranked.filter(F.col("rank_in_universe") <= n).withColumn("side", F.lit("top"))
    worst = ranked.filter(F.col("rank_in_universe") > F.col("universe_size") - n).withColumn("side", F.lit("bottom"))
    listed = F.array_sort(F.collect_list(F.struct("rank_in_universe", "ticker")))
    return best.unionByName(worst).groupBy("side").agg(F.transform(listed, lambda r: r["ticker"]).alias("tickers"))


# -- scores and stances -------------------------------------------------------


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def rule_points() -> dict[str, tuple[Column, float]]:
    """Condition and points of each part of the rule score."""
    rsi = F.col("rsi_14")
    return {
        "20d momentum positive": (zero("mom_20d") > 0, 0.0030),
        "60d momentum positive": (zero("mom_60d") > 0, 0.0020),
        "price above 200d SMA": (zero("sma_gap_200") > 0, 0.0020),
        "RSI oversold": (rsi < 30, 0.0040),
        "RSI overbought": (rsi > 75, -0.0040),
        "breakout above 20d high": (zero("breakout_20") > 0, 0.0020),
        "deep drawdown from 60d high": (zero("dd_from_high_60") < -0.20, -0.0020),
        "high realized vol": (zero("vol_20d") > 0.60, -0.0015),
    }


def rule_score(df: DataFrame) -> DataFrame:
    """Additive score and the list of reasons that fired."""
    score, reasons = F.lit(0.0), []
    for text, (condition, points) in rule_points().items():
        score = score + F.when(condition, points).otherwise(0.0)
        reasons.append(F.when(condition, text))
    return df.select("*", score.alias("score"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def confidence(df: DataFrame, from_spread: bool = False) -> DataFrame:
    """|score| against 3 population deviations of the date's scores (30 needed),
    or against 0.05 where no score distribution is available."""
    plain = F.least(F.lit(1.0), F.abs("score") / 0.05)
    if not from_spread:
        return df.withColumn("confidence", plain)
    side = df.groupBy("date").agg(F.stddev_pop("score").alias("_sd"), F.count("score").alias("_n"))
    out = F.when(F.col("_n") < 30, plain).when(F.col("_sd") <= 1e-9, 0.5).otherwise(F.least(F.lit(1.0), F.abs("score") / F.col("_sd") / 3.0))
    return df.join(side, "date").withColumn("confidence", out).drop("_sd", "_n")


def stance(df: DataFrame, buy: float = 0.005, sell: float = -0.005, overbought: float = 75.0, oversold: float = 25.0, min_adv: float = 5e6) -> DataFrame:
    """BUY / SELL / HOLD with a liquidity floor and an RSI veto, plus the reason."""
    rsi = F.col("rsi_14")
    thin = zero("avg_dollar_volume_20") < min_adv
    cases = [
        (thin, "HOLD", "liquidity below floor"),
        ((F.col("score") >= buy) & (rsi > overbought), "HOLD", "positive but overbought"),
        (F.col("score") >= buy, "BUY", "score above buy threshold"),
        ((F.col("score") <= sell) & (rsi < oversold), "HOLD", "negative but oversold"),
        (F.col("score") <= sell, "SELL", "score below sell threshold"),
    ]
    side, why = F.lit("HOLD"), F.lit("score within neutral band")
    for condition, value, text in reversed(cases):
        side = F.when(condition, value).otherwise(side)
        why = F.when(condition, text).otherwise(why)
    return df.select("*", side.alias("stance"), why.alias("stance_reason"))


def timing_hint(rsi: Column, gap: Column) -> Column:
    rsi, gap = F.coalesce(rsi, F.lit(50.0)), F.coalesce(gap, F.lit(0.0))
    return (
        F.when((rsi > 70) | (gap > 0.15), "extended, wait for a pullback")
        .when((rsi < 45) | (gap < -0.03), "pullback, accumulate now")
        .otherwise("neutral, scale in")
    )


def decision_panel(features: DataFrame, scores: DataFrame | None = None, **limits) -> DataFrame:
    """One decision per ticker at the newest date, in one projection.

    A supplied score (ticker, score) wins; names without one fall back to rules.
    """
    today = rule_score(latest_cross_section(features))
    if scores is not None:
        given = scores.select("ticker", F.col("score").alias("_given"))
        today = today.join(given, "ticker", "left")
        today = today.withColumn("source", F.when(F.col("_given").isNotNull(), "model").otherwise("rules"))
        today = today.withColumn("score", F.coalesce("_given", "score")).drop("_given")
    else:
        today = today.withColumn("source", F.lit("rules"))
    today = confidence(today, from_spread=scores is not None)
    today = stance(today, **limits)
    return today.withColumns(
        {
            "forecast_5d": F.col("score"),
            "forecast_20d": F.col("score") * 4.0 * 0.65,
            "timing": timing_hint(F.col("rsi_14"), F.col("sma_gap_50")),
        }
    )


def signal_table(decisions: DataFrame, side: str | None = None, min_confidence: float = 0.0, top: int | None = None) -> DataFrame:
    """Newest decision per ticker, filtered and ordered by confidence."""
    rest = [c for c in decisions.columns if c not in ("ticker", "date")]
    rows = latest_per_ticker(decisions, rest)
    rows = rows.filter(F.col("stance") == side) if side else rows
    rows = rows.filter(F.col("confidence") >= min_confidence).orderBy(F.desc("confidence"), "ticker")
    return rows.limit(top) if top else rows


def stance_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("stance").agg(F.count("*").alias("n"))


def breadth(features: DataFrame, bins: int = 30) -> DataFrame:
    """Bull and high-volatility counts with a histogram of mom_20d, newest date."""
    today = latest_cross_section(features).select("bull_regime", "high_vol_regime", "mom_20d")
    edge = today.agg(F.struct(F.min("mom_20d").alias("lo"), F.max("mom_20d").alias("hi"))).scalar()
    step = (edge["hi"] - edge["lo"]) / bins
    bucket = F.least(F.floor((F.col("mom_20d") - edge["lo"]) / step), F.lit(bins - 1)).cast("int")
    known = today.filter("mom_20d is not null")
    return known.groupBy(bucket.alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(F.col("bull_regime") == 1).alias("bull"), F.count_if(F.col("high_vol_regime") == 1).alias("high_vol")
    )
