"""Price features: one window specification, a handful of projections.

Columns are added in layers so that a window over a derived column sees it as an
input; every layer shares the (ticker, date) ordering and therefore one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.windows import back, by_date, by_ticker, carry, roll, spread

YEAR = math.sqrt(252.0)


def ratio(a: Column, b: Column) -> Column:
    return a / b - 1


def add(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(name) for name, c in cols.items()])


def technical_features(bars: DataFrame) -> DataFrame:
    px = F.col("adj_close")
    high, low, close, volume = F.col("high"), F.col("low"), F.col("close"), F.col("volume")
    prior = back(close)
    change = px - back(px)
    base = {
        "ret_1d": ratio(px, back(px)),
        "log_ret_1d": F.log(px / back(px)),
        **{f"mom_{n}d": ratio(px, back(px, n)) for n in (5, 10, 20, 60, 120)},
        "mom_12m1m": ratio(back(px, 21), back(px, 252)),
        **{f"sma_{n}": roll(F.avg, px, n) for n in (10, 20, 50, 200)},
        "dd_from_high_60": ratio(px, roll(F.max, px, 60)),
        "_range": F.greatest(high - low, F.abs(high - prior), F.abs(low - prior)),
        "_mean_volume": roll(F.avg, volume, 20),
        "_turnover": close * volume,
        "breakout_20": ratio(close, roll(F.max, high, 20)),
        "breakdown_20": ratio(close, roll(F.min, low, 20)),
        "_gain": F.when(change > 0, change).otherwise(0.0),
        "_loss": F.when(change < 0, -change).otherwise(0.0),
    }
    df = add(bars, base)
    up, down = roll(F.avg, "_gain", 14), roll(F.avg, "_loss", 14)
    derived = {
        **{f"sma_gap_{n}": ratio(px, F.col(f"sma_{n}")) for n in (10, 20, 50, 200)},
        **{f"vol_{n}d": roll(F.stddev_samp, "log_ret_1d", n) * YEAR for n in (10, 20, 60)},
        "atr_14": roll(F.avg, "_range", 14),
        "rel_vol_20": F.when(F.col("_mean_volume") > 0, volume / F.col("_mean_volume")),
        "avg_dollar_volume_20": roll(F.avg, "_turnover", 20),
        "_up": up,
        "_down": down,
    }
    df = add(df, derived)
    strength = (
        F.when((F.col("_down") == 0) & (F.col("_up") == 0), 50.0)
        .when(F.col("_down") == 0, 100.0)
        .when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.col("_down")))
    )
    return add(df, {"rsi_14": strength}).drop("_range", "_mean_volume", "_turnover", "_gain", "_loss", "_up", "_down")


def with_benchmark(df: DataFrame, benchmark: str, column: str, name: str) -> DataFrame:
    """Attach the benchmark's value by date: one row per date on the right."""
    side = df.filter(F.col("ticker") == benchmark).select("date", F.col(column).alias(name))
    return df.join(side, "date", "left")


def extended_features(df: DataFrame, benchmark: str | None) -> DataFrame:
    px, r, volume = F.col("adj_close"), F.col("ret_1d"), F.col("volume")
    losing = F.when(r < 0, r)
    df = add(
        df,
        {
            "_impact": F.abs(r) / (F.col("close") * volume + 1.0),
            "_losing": losing,
            "_mean60": roll(F.avg, r, 60),
            "_sd60": roll(F.stddev_samp, r, 60),
            "_top": roll(F.max, px, 252, 60),
            "_bottom": roll(F.min, px, 252, 60),
            "_mid": F.col("sma_20"),
            "_width": roll(F.stddev_samp, px, 20),
            "volume_z_60": (volume - roll(F.avg, volume, 60)) / (roll(F.stddev_samp, volume, 60) + 1e-9),
            "overnight_gap": ratio(F.col("open"), back("close")),
            "ret_skew_60": roll(F.skewness, r, 60),
            "vol_of_vol_60": roll(F.stddev_samp, "vol_20d", 60),
            "mom_accel": F.col("mom_20d") - F.col("mom_60d"),
        },
    )
    df = add(
        df,
        {
            "_fourth": F.pow((r - F.col("_mean60")) / (F.col("_sd60") + 1e-12), 4),
            "_drop": ratio(px, F.col("_top")),
            "amihud_illiq_20": roll(F.avg, "_impact", 20) * 1e9,
            **{f"downside_vol_{n}d": roll(F.stddev_samp, "_losing", n, max(5, n // 4)) * YEAR for n in (20, 60)},
            "dist_52w_high": ratio(px, F.col("_top")),
            "dist_52w_low": ratio(px, F.col("_bottom")),
            "bb_pctb_20": (px - (F.col("_mid") - 2 * F.col("_width"))) / (4 * F.col("_width") + 1e-9),
        },
    )
    df = add(df, {"ret_kurt_60": roll(F.avg, "_fourth", 60) - 3.0, "max_dd_252": roll(F.min, "_drop", 252, 60)})
    df = df.drop("_impact", "_losing", "_mean60", "_top", "_bottom", "_mid", "_width", "_fourth", "_drop")
    if benchmark is None:
        return add(df, {"beta_60": F.lit(1.0), "corr_bench_60": F.lit(0.0)}).drop("_sd60")
    if "bench_ret_1d" not in df.columns:
        df = with_benchmark(df, benchmark, "ret_1d", "bench_ret_1d")
    rb = F.col("bench_ret_1d")
    df = add(
        df,
        {
            "_cov": roll(F.avg, r * rb, 60) - roll(F.avg, r, 60) * roll(F.avg, rb, 60),
            "_var": roll(F.avg, rb * rb, 60) - F.pow(roll(F.avg, rb, 60), 2),
            "_sdb": roll(F.stddev_samp, rb, 60),
        },
    )
    return add(
        df,
        {
            "beta_60": F.col("_cov") / (F.col("_var") + 1e-12),
            "corr_bench_60": F.col("_cov") / (F.col("_sd60") * F.col("_sdb") + 1e-12),
        },
    ).drop("_cov", "_var", "_sdb", "_sd60")


def regime_features(df: DataFrame, benchmark: str | None) -> DataFrame:
    def median(c):
        return F.percentile(c, 0.5)

    if benchmark is not None and "bench_ret_1d" not in df.columns:
        df = with_benchmark(df, benchmark, "ret_1d", "bench_ret_1d")
    df = add(
        df,
        {
            "bull_regime": (F.col("adj_close") > F.col("sma_200")).cast("tinyint"),
            "high_vol_regime": (F.col("vol_20d") > roll(median, "vol_20d", 252)).cast("tinyint"),
            "excess_ret_1d": (F.col("ret_1d") - F.col("bench_ret_1d")) if benchmark else F.lit(None).cast("double"),
        },
    )
    return momentum_rank(df)


def momentum_rank(df: DataFrame) -> DataFrame:
    """Ordinal rank of mom_20d within the date, scaled to [0, 1].

    A date holds one row per ticker.  The count is a partial aggregate joined
    back by date; the rank itself is a window over one date's names.
    """
    by_score = by_date().orderBy(F.col("mom_20d").asc_nulls_last(), "ticker")
    known = F.col("mom_20d").isNotNull()
    ranked = add(
        df,
        {
            "_rank": F.when(known, F.row_number().over(by_score)),
            "_known": F.count("mom_20d").over(by_date()),
        },
    )
    scaled = (F.col("_rank") - 1) / F.greatest(F.col("_known") - 1, F.lit(1))
    return add(ranked, {"mom_20d_rank": scaled}).drop("_rank", "_known")


def add_targets(df: DataFrame, horizons=(5, 20)) -> DataFrame:
    """Forward returns; targets only, never inputs."""
    px = F.col("adj_close")
    return add(df, {f"forward_return_{h}d": ratio(F.lead(px, h).over(by_ticker()), px) for h in horizons})


def demean_by_date(df: DataFrame, column: str, name: str) -> DataFrame:
    """Market-neutral target: value minus its date mean (partial agg + join)."""
    mean = df.groupBy("date").agg(F.avg(column).alias("_mean"))
    return df.join(mean, "date", "left").withColumn(name, F.col(column) - F.col("_mean")).drop("_mean")


def price_features(bars: DataFrame, benchmark: str | None, horizons=(5, 20)) -> DataFrame:
    """Technical, extended, regime and target columns in one lazy plan."""
    df = technical_features(spread(bars))
    df = extended_features(df, benchmark)
    df = regime_features(df, benchmark)
    return add_targets(df, horizons)


def fill_forward(df: DataFrame, columns: list[str], by=("ticker",), order=("date",)) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], *[carry(c, by, order).alias(c) for c in columns])
