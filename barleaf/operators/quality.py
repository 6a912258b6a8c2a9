"""Bar and event checks, each a single aggregation pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
REQUIRED = ("date", "ticker", *PRICES, "volume")


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def range_broken() -> Column:
    low, high = F.col("low"), F.col("high")
    inner = [F.col("open"), F.col("close")]
    return _any([low > high, *[low > p for p in inner], *[high < p for p in inner]])


def sanitize_bars(df: DataFrame) -> DataFrame:
    """Keep bars with positive, present prices inside a consistent range."""
    if not set(PRICES) <= set(df.columns):
        return df
    return df.filter(_all([F.col(p) > 0 for p in PRICES]) & ~range_broken())


def check_bars(df: DataFrame, missing_limit: float = 0.05) -> DataFrame:
    """One row per check: (check_name, passed, failures).

    Key uniqueness pre-aggregates by (date, ticker); every other check shares
    the second aggregation over the same groups, so the bars are read once.
    """
    has_all = set(REQUIRED) <= set(df.columns)
    if not has_all:
        absent = sorted(set(REQUIRED) - set(df.columns))
        return df.sparkSession.createDataFrame(
            [("has_required_columns", False, len(absent))], "check_name string, passed boolean, failures long"
        )
    flags = {
        "ohlc_sanity": range_broken(),
        "volume_non_negative": F.col("volume") < 0,
        "prices_positive": _any([F.col(p) <= 0 for p in PRICES]),
    }
    nulls = {f"_null_{i}": F.count_if(F.col(c).isNull()) for i, c in enumerate(df.columns)}
    per_key = df.groupBy("date", "ticker").agg(
        F.count("*").alias("_n"),
        *[F.count_if(cond).alias(name) for name, cond in flags.items()],
        *[expr.alias(name) for name, expr in nulls.items()],
    )
    total = per_key.agg(
        F.sum("_n").alias("_rows"),
        F.count_if(F.col("_n") > 1).alias("no_duplicate_date_ticker"),
        *[F.sum(name).alias(name) for name in (*flags, *nulls)],
    )
    worst = F.greatest(*[F.col(n) for n in nulls], F.lit(0))
    return total.select(
        F.explode(
            F.array(
                F.struct(F.lit("has_required_columns").alias("check_name"), F.lit(True).alias("passed"), F.lit(0).cast("long").alias("failures")),
                *[
                    F.struct(F.lit(n).alias("check_name"), (F.col(n) == 0).alias("passed"), F.col(n).cast("long").alias("failures"))
                    for n in ("no_duplicate_date_ticker", *flags)
                ],
                F.struct(
                    F.lit("missing_under_5pct").alias("check_name"),
                    (worst / F.col("_rows") < missing_limit).alias("passed"),
                    worst.cast("long").alias("failures"),
                ),
            )
        ).alias("r")
    ).select("r.*")


def check_events(df: DataFrame) -> DataFrame:
    total = df.agg(
        F.count("*").alias("_rows"),
        F.count_if(F.col("known_at") < F.col("published_at")).alias("late"),
        F.count_if((F.col("sentiment") < -1.0) | (F.col("sentiment") > 1.0)).alias("wide"),
    )
    rows = [
        F.struct(F.lit(name).alias("check_name"), ok.alias("passed"))
        for name, ok in {
            "non_empty": F.col("_rows") > 0,
            "known_at_after_published": F.col("late") == 0,
            "sentiment_in_range": F.col("wide") == 0,
        }.items()
    ]
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
