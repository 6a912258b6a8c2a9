"""The feature matrix: bars and any of the optional sources as one row per (ticker, date).

Every source keyed by ticker is stacked under the bars with its own columns and
summed by (ticker, date) in one aggregation, with partial sums inside the tasks;
no source is joined.  Dates that only a source has stay until everything that
looks back over calendar days is known, then the bars' rows go on.  Sources
keyed by date alone (calendar, macro, benchmark) meet in one table of a row per
date.  After that one partitioning by ticker serves all windows, and the only
other exchange is the rank within a date.

Missing sources leave their columns out, but for the neutral values that the
sources' own operators define.  Columns filled by ``densify`` come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.windows import by_ticker, spread
from barleaf.operators import events as E
from barleaf.operators import nonlinear as N
from barleaf.operators import prices as P

BAR = ["open", "high", "low", "close", "adj_close", "volume"]


def stacked(bars: DataFrame, events=None, apprehension=None, earnings=None, tone=None, filings=None, views=None, scored=None) -> DataFrame:
    """One row per (ticker, date) of any source, with every source's daily sums."""
    rows = bars.select("ticker", "date", *BAR, F.lit(1).alias("_bar"))
    sums = [F.max(c).alias(c) for c in [*BAR, "_bar"]]

    def under(source: DataFrame, aggregates: list) -> None:
        nonlocal rows
        rows = rows.unionByName(source, allowMissingColumns=True)
        sums.extend(aggregates)

    if events is not None:
        each = events.select(F.explode("tickers").alias("ticker"), F.to_date("known_at").alias("date"), "sentiment", "magnitude", "novelty", F.greatest(F.size("risk_flags"), F.lit(0)).alias("_flags"), F.lit(1).alias("_event_row"))
        under(each, [
            F.sum("_event_row").alias("event_count"), F.avg("sentiment").alias("event_sentiment_mean"), F.avg("magnitude").alias("event_magnitude_mean"),
            F.max("novelty").alias("event_novelty_max"), F.sum("_flags").alias("risk_flag_count"),
        ])
    if apprehension is not None:
        under(apprehension.select("ticker", "date", "apprehension_score", "outlook"), [F.max("apprehension_score").alias("apprehension_score"), F.max("outlook").alias("outlook")])
    if earnings is not None:
        under(earnings.select("ticker", "date", E.day("date").alias("_event")), [F.max("_event").alias("_event")])
    if tone is not None:
        under(tone.select("ticker", "date", "gdelt_tone", "gdelt_vol"), [F.max("gdelt_tone").alias("gdelt_tone"), F.max("gdelt_vol").alias("gdelt_vol")])
    if filings is not None:
        form = F.col("form")
        each = filings.select("ticker", "date", F.lit(1).alias("_all"), form.startswith("8-K").cast("int").alias("_8k"), form.isin(*E.INSIDER).cast("int").alias("_f4"))
        under(each, [F.sum(c).alias(c) for c in ("_all", "_8k", "_f4")])
    if views is not None:
        under(views.select("ticker", "date", "wiki_views"), [F.max("wiki_views").alias("wiki_views")])
    if scored is not None:
        each = scored.filter("finbert_sentiment is not null").select(F.explode("tickers").alias("ticker"), F.to_date("known_at").alias("date"), F.col("finbert_sentiment").alias("_fb"), F.lit(1).alias("_n"))
        under(each, [F.avg("_fb").alias("_fb"), F.sum("_n").alias("_n")])
    return rows.groupBy("ticker", "date").agg(*sums)


def by_calendar(bars: DataFrame, benchmark: str | None, calendar=None, macro=None) -> DataFrame | None:
    """Everything known per date: one row per date of the bars."""
    out = bars.select("date").distinct()
    if calendar is not None:
        out = E.market_calendar_features(out, calendar)
    if macro is not None:
        out = out.join(macro, "date", "left")
    if benchmark is not None:
        px = F.col("adj_close")
        side = bars.filter(F.col("ticker") == benchmark).select("date", P.ratio(px, F.lag(px).over(by_ticker())).alias("bench_ret_1d"))
        out = out.join(side, "date", "left")
    return out if len(out.columns) > 1 else None


def feature_matrix(
    bars: DataFrame, benchmark: str | None = None, horizons=(5, 20), *, events: DataFrame | None = None, apprehension: DataFrame | None = None, calendar: DataFrame | None = None,
    earnings: DataFrame | None = None, macro: DataFrame | None = None, tone: DataFrame | None = None, filings: DataFrame | None = None, views: DataFrame | None = None,
    scored: DataFrame | None = None, extended: bool = True, nonlinear: bool = False, market_mode: bool = False,
) -> DataFrame:
    """One row per (ticker, date) of ``bars`` with the features of every source given.

    bars(ticker, date, open, high, low, close, adj_close, volume) one row per key;
    events and scored as point-in-time rows with ``known_at`` and ``tickers``;
    apprehension, earnings, tone, filings and views keyed by (ticker, date); calendar
    (event_name, date); macro one row per date.
    """
    rows = stacked(bars, events, apprehension, earnings, tone, filings, views, scored)
    dated = by_calendar(bars, benchmark, calendar, macro)
    if dated is not None:
        rows = rows.join(dated, "date", "left")
    rows = spread(rows).withColumn("_day", E.day("date"))

    # what looks back over days, weekends and holidays of the bars included
    if events is not None:
        reported = Window.partitionBy("ticker", F.col("event_count").isNotNull()).orderBy("date")
        rows = E.decays(rows, reported)
        quiet = F.col("event_count").isNull()
        rows = rows.withColumns({c: F.when(~quiet, F.col(c)) for c in ("sent_decay_3d", "sent_decay_7d", "sent_decay_14d", "sent_momentum")})
    if filings is not None:
        rows = E.filing_counts(rows).drop("_all", "_8k", "_f4")
    if earnings is not None:
        rows = E.until_earnings(E.around(rows, ("ticker",))).drop("_event")

    df = rows.filter("_bar = 1").drop("_bar", "_day")
    df = P.technical_features(df)
    df = P.extended_features(df, benchmark) if extended else df
    df = P.add_targets(df, horizons)
    df = E.sentiment_of(df) if scored is not None else df
    df = E.tone_of(df) if tone is not None else df
    df = E.attention_of(df) if views is not None else df
    df = E.carried_macro(df, [c for c in macro.columns if c != "date"]) if macro is not None else df
    df = df.fillna({"outlook": "stable"}) if apprehension is not None else df
    if nonlinear:
        inside = bars.select("ticker", "date", "adj_close")
        df = df.join(N.nonlinear_features(inside).drop("adj_close"), ["ticker", "date"], "left")
    if market_mode:
        inside = bars.select("ticker", "date", "adj_close")
        df = df.join(N.eigen_features(inside).drop("adj_close"), ["ticker", "date"], "left")
    return E.densify(P.regime_features(df, benchmark))
