"""Event, calendar, macro and attention features on a panel.

Raw events are aggregated to one row per (ticker, date) first (partial
aggregation runs map-side), so a ticker with a third of all events reaches the
windows as at most one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.windows import by_ticker, carry, ewm, half_life_decay, roll, spread

DECAY = 0.85


def day(c: Column | str) -> Column:
    return F.unix_date(F.col(c) if isinstance(c, str) else c)


# -- events -------------------------------------------------------------------


def daily_events(events: DataFrame) -> DataFrame:
    """Counts and means per (date, ticker), keyed by when the event was known."""
    exploded = events.select(
        F.to_date("known_at").alias("date"),
        F.explode("tickers").alias("ticker"),
        "sentiment", "magnitude", "novelty",
        F.size("risk_flags").alias("_flags"),
    )
    return exploded.groupBy("date", "ticker").agg(
        F.count("*").alias("event_count"),
        F.avg("sentiment").alias("event_sentiment_mean"),
        F.avg("magnitude").alias("event_magnitude_mean"),
        F.max("novelty").alias("event_novelty_max"),
        F.sum(F.greatest("_flags", F.lit(0))).alias("risk_flag_count"),
    )


def decayed(x: str, n: int, rate: float = DECAY, over=None) -> Column:
    """Weighted mean of the last n rows, weight rate**age, over rows that exist."""
    w = over if over is not None else by_ticker()
    num = den = F.lit(0.0)
    for age in range(n):
        past = F.lag(x, age).over(w) if age else F.col(x)
        num = num + F.coalesce(past * rate**age, F.lit(0.0))
        den = den + F.when(past.isNotNull(), rate**age).otherwise(0.0)
    return F.when(den > 0, num / den).otherwise(0.0)


def event_features(events: DataFrame) -> DataFrame:
    return decays(daily_events(events))


def decays(daily: DataFrame, over=None) -> DataFrame:
    """Decayed means of ``event_sentiment_mean`` over days with events."""
    out = daily.select("*", *[decayed("event_sentiment_mean", n, over=over).alias(f"sent_decay_{n}d") for n in (3, 7, 14)])
    return out.withColumn("sent_momentum", F.col("sent_decay_3d") - F.col("sent_decay_7d"))


def apprehension(events: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Risk score per ticker over the trailing days, from means and flag density."""
    known = F.to_date("known_at")
    window = events.filter((known >= F.date_sub(as_of, days)) & (known <= as_of))
    rows = window.select(F.explode("tickers").alias("ticker"), "sentiment", "magnitude", F.size("risk_flags").alias("_f"))
    agg = rows.groupBy("ticker").agg(
        F.coalesce(F.avg("sentiment"), F.lit(0.0)).alias("_s"),
        F.coalesce(F.avg("magnitude"), F.lit(0.0)).alias("_m"),
        F.sum(F.greatest("_f", F.lit(0))).alias("_flags"),
        F.count("*").alias("_n"),
    )
    density = F.least(F.lit(1.0), F.col("_flags") / F.col("_n"))
    raw = F.greatest(F.lit(0.0), -F.col("_s")) * 0.45 + F.col("_m") * 0.25 + density * 0.30
    return agg.select(
        as_of.alias("date"),
        "ticker",
        F.least(F.lit(1.0), raw).alias("apprehension_score"),
        F.when(F.col("_s") < -0.2, "deteriorating").when(F.col("_s") > 0.2, "improving").otherwise("stable").alias("outlook"),
    )


# -- nearest dates ------------------------------------------------------------


def nearest_dates(panel: DataFrame, events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Days to the next event (0 today) and from the last one before today.

    Panel rows and event dates are stacked and two running extremes taken, one
    up and one down the calendar; both frames grow, so the cost is linear.
    """
    marks = events.select(*by, "date").distinct().select(*by, "date", day("date").alias("_event"), F.lit(None).cast("boolean").alias("_row"))
    rows = panel.withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    return around(rows.withColumn("_day", day("date")), by).filter("_row").drop("_row", "_event", "_day")


def around(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``_past`` and ``_next``: days to the nearest ``_event`` before ``_day``, and on or after it."""
    back = Window.partitionBy(*by).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.col("_day").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_past", F.max("_event").over(back) - F.col("_day"))
    return rows.withColumn("_next", F.min("_event").over(ahead) - F.col("_day"))


def market_calendar_features(panel: DataFrame, calendar: DataFrame, imminent_days: int = 3) -> DataFrame:
    """days_to_fomc and macro_event_imminent, computed once per date."""
    dates = panel.select("date").distinct()
    meetings = calendar.filter(F.col("event_name").contains("FOMC"))
    near = nearest_dates(dates, meetings)
    signed = F.when(F.col("_next").isNull(), F.col("_past")).when(F.col("_past").isNull(), F.col("_next")).otherwise(
        F.when(F.col("_next") <= -F.col("_past"), F.col("_next")).otherwise(F.col("_past"))
    )
    near = near.select("date", F.coalesce(signed.cast("double"), F.lit(999.0)).alias("days_to_fomc"))
    soon = nearest_dates(dates, calendar).select(
        "date", F.coalesce(F.col("_next") <= imminent_days, F.lit(False)).alias("macro_event_imminent")
    )
    return panel.join(near.join(soon, "date"), "date", "left")


def earnings_features(panel: DataFrame, earnings: DataFrame, max_ahead: int = 90) -> DataFrame:
    """Days to the next known date up to 90 days out, else since the last one."""
    return until_earnings(nearest_dates(panel, earnings, by=("ticker",)), max_ahead)


def until_earnings(near: DataFrame, max_ahead: int = 90) -> DataFrame:
    signed = F.when(F.col("_next") <= max_ahead, F.col("_next")).otherwise(F.col("_past")).cast("double")
    return near.withColumn("days_to_earnings", F.coalesce(signed, F.lit(999.0))).withColumn(
        "hist_earnings_sentiment_mean", F.lit(None).cast("double")
    ).drop("_past", "_next")


# -- filings ------------------------------------------------------------------

# Insider report forms, matched exactly.
INSIDER = ("4", "4/A")


def filing_features(panel: DataFrame, filings: DataFrame) -> DataFrame:
    """Trailing calendar-day counts by form class and days since the last one."""
    daily = filings.groupBy("ticker", "date").agg(
        F.count("*").alias("_all"),
        F.count_if(F.col("form").startswith("8-K")).alias("_8k"),
        F.count_if(F.col("form").isin(*INSIDER)).alias("_f4"),
    )
    rows = panel.withColumn("_row", F.lit(True)).unionByName(daily, allowMissingColumns=True)
    rows = filing_counts(spread(rows).withColumn("_day", day("date")))
    return rows.filter("_row").drop("_row", "_all", "_8k", "_f4", "_day")


def filing_counts(rows: DataFrame) -> DataFrame:
    """Trailing counts from daily ``_all``, ``_8k`` and ``_f4`` on rows with ``_day``."""
    base = Window.partitionBy("ticker").orderBy("_day")
    covered = F.max(F.col("_all").isNotNull()).over(Window.partitionBy("ticker"))

    def trailing(c: str, days: int) -> Column:
        return F.when(covered, F.coalesce(F.sum(c).over(base.rangeBetween(-(days - 1), 0)), F.lit(0)))

    last = F.max(F.when(F.col("_all").isNotNull(), F.col("_day"))).over(base.rangeBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "*",
        trailing("_all", 30).cast("double").alias("sec_filings_30d"),
        trailing("_8k", 30).cast("double").alias("sec_8k_30d"),
        trailing("_f4", 90).cast("double").alias("sec_form4_90d"),
        (F.col("_day") - last).cast("double").alias("sec_days_since_filing"),
    )


# -- macro --------------------------------------------------------------------


def macro_wide(series: DataFrame, names: dict[str, str]) -> DataFrame:
    """Long (date, series_id, value) to one column per named series, carried.

    The pivot list is fixed, so this is one aggregation by date; the carry runs
    over one row per date.
    """
    wide = series.groupBy("date").pivot("series_id", list(names)).agg(F.max("value"))
    wide = wide.select("date", *[F.col(k).alias(v) for k, v in names.items()])
    return wide.select("date", *[carry(v, by=(), order=("date",)).alias(v) for v in names.values()])


def macro_features(series: DataFrame, names: dict[str, str]) -> DataFrame:
    wide = macro_wide(series, names)
    one = dict(by=(), order=("date",))
    out = []
    for c in names.values():
        sd = roll(F.stddev_samp, c, 252, 60, **one)
        z = (F.col(c) - roll(F.avg, c, 252, 60, **one)) / sd
        out.append((F.col(c) - F.lag(c, 20).over(Window.orderBy("date"))).alias(f"{c}_chg_20d"))
        out.append(F.when(sd > 0, z).otherwise(0.0).alias(f"{c}_z_252"))
    return wide.select("*", *out)


def join_macro(panel: DataFrame, macro: DataFrame) -> DataFrame:
    """Left join by date, carry within the ticker, zero before the first print."""
    return carried_macro(panel.join(macro, "date", "left"), [c for c in macro.columns if c != "date"])


def carried_macro(df: DataFrame, cols: list[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[F.coalesce(F.nanvl(carry(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols])


# -- attention and tone -------------------------------------------------------


def attach(panel: DataFrame, series: DataFrame, columns: list[str]) -> DataFrame:
    side = series.dropDuplicates(["ticker", "date"]).select("ticker", "date", *columns)
    return panel.join(side, ["ticker", "date"], "left")


def surprise(x: str) -> Column:
    """z against the last 60 rows (20 needed), null where the spread is nil."""
    sd = roll(F.stddev_samp, x, 60, 20)
    return F.when(sd > 1e-9, (F.col(x) - roll(F.avg, x, 60, 20)) / sd)


def covered(c: str) -> Column:
    return F.max(F.col(c).isNotNull()).over(Window.partitionBy("ticker"))


def tone_features(panel: DataFrame, tone: DataFrame, half_life: float = 7) -> DataFrame:
    return tone_of(attach(panel, tone, ["gdelt_tone", "gdelt_vol"]), half_life)


def tone_of(df: DataFrame, half_life: float = 7) -> DataFrame:
    """From daily ``gdelt_tone`` and ``gdelt_vol`` already on the panel."""
    df = df.withColumn("_cov", covered("gdelt_tone"))
    df = df.withColumn("_log", F.log(F.coalesce("gdelt_vol", F.lit(0)) + 1.0))
    df = ewm(
        df,
        {"news_tone": ("gdelt_tone", half_life_decay(half_life)), "_fast": ("gdelt_tone", half_life_decay(3))},
        skip_null_steps=True,
    )
    return df.withColumns(
        {
            "news_tone_mom": F.when(F.col("_cov"), F.col("_fast") - F.col("news_tone")),
            "news_buzz": F.when(F.col("_cov"), surprise("_log")),
        }
    ).drop("gdelt_tone", "gdelt_vol", "_cov", "_log", "_fast")


def attention_features(panel: DataFrame, views: DataFrame) -> DataFrame:
    return attention_of(attach(panel, views, ["wiki_views"]))


def attention_of(df: DataFrame) -> DataFrame:
    """From daily ``wiki_views`` already on the panel."""
    df = df.withColumn("_log", F.log(F.col("wiki_views") + 1.0))
    decays = {"_fast": ("_log", half_life_decay(3)), "_slow": ("_log", half_life_decay(20))}
    df = ewm(df, decays, skip_null_steps=True)
    return df.withColumns(
        {"wiki_attention_z": surprise("_log"), "wiki_attention_mom": F.col("_fast") - F.col("_slow")}
    ).drop("wiki_views", "_log", "_fast", "_slow")


def text_features(panel: DataFrame, scored: DataFrame, half_life: float = 7) -> DataFrame:
    """Decayed daily mean of scored news, zero on quiet days, null until covered."""
    rows = scored.filter("finbert_sentiment is not null").select(
        F.to_date("known_at").alias("date"), F.explode("tickers").alias("ticker"), "finbert_sentiment"
    )
    daily = rows.groupBy("ticker", "date").agg(F.avg("finbert_sentiment").alias("_fb"), F.count("*").alias("_n"))
    return sentiment_of(panel.join(daily, ["ticker", "date"], "left"), half_life)


def sentiment_of(df: DataFrame, half_life: float = 7) -> DataFrame:
    """From the daily mean ``_fb`` of ``_n`` scored items already on the panel."""
    df = df.fillna(0, ["_fb", "_n"])
    df = df.withColumn("finbert_news_30d", F.sum("_n").over(by_ticker().rowsBetween(-29, 0)))
    df = ewm(df, {"_slow": ("_fb", half_life_decay(half_life)), "_fast": ("_fb", half_life_decay(3))})
    seen = F.col("finbert_news_30d") > 0
    return df.withColumns(
        {
            "finbert_sent": F.when(seen, F.col("_slow")),
            "finbert_sent_mom": F.when(seen, F.col("_fast") - F.col("_slow")),
        }
    ).drop("_fb", "_n", "_slow", "_fast")


# -- sparse sources -----------------------------------------------------------

# Presence flag and neutral fill of every sparse column.
SPARSE = {
    "news_present": {"news_tone": 0.0, "news_tone_mom": 0.0, "news_buzz": 0.0},
    "sec_present": {"sec_filings_30d": 0.0, "sec_8k_30d": 0.0, "sec_form4_90d": 0.0, "sec_days_since_filing": 999.0},
    "wiki_present": {"wiki_attention_z": 0.0, "wiki_attention_mom": 0.0},
}


def densify(df: DataFrame) -> DataFrame:
    """Flag rows where a source reports anything, then fill with neutral values."""
    flags, fills = {}, {}
    for flag, columns in SPARSE.items():
        found = {c: v for c, v in columns.items() if c in df.columns}
        if found:
            flags[flag] = F.coalesce(*[F.col(c) for c in found]).isNotNull().cast("double")
            fills.update(found)
    return df.withColumns(flags).fillna(fills) if flags else df
