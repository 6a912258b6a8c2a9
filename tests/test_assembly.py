"""The feature matrix against the single operators, with any source absent."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barleaf.operators import assembly as A
from barleaf.operators import events as E
from barleaf.operators import prices as P
from tests.test_known_answers import START, walk

DAYS = 90


@pytest.fixture(scope="module")
def bars(spark):
    """Weekday bars of four names, so that weekend reports fall between rows."""
    rows = walk(4, DAYS)
    rows = rows[[d.weekday() < 5 for d in rows["date"]]]
    return spark.createDataFrame(rows).select("ticker", "date", *A.BAR).cache()


@pytest.fixture(scope="module")
def sources(spark):
    day = lambda i: START + dt.timedelta(days=i)
    at = lambda i: dt.datetime.combine(day(i), dt.time(9))
    news = [(at(i), [f"T0{i % 3}", "OTHER"], 0.1 * (i % 7) - 0.3, 0.2, 0.5, ["x"] * (i % 2), 0.05 * (i % 9) if i % 4 else None) for i in range(0, DAYS, 2)]
    events = spark.createDataFrame(news, "known_at timestamp, tickers array<string>, sentiment double, magnitude double, novelty double, risk_flags array<string>, finbert_sentiment double")
    daily = [(f"T0{k}", day(i), 0.1 * (i % 5), 3 + i % 4, 100 + 7 * i) for k in range(3) for i in range(0, DAYS, 3)]
    daily = spark.createDataFrame(daily, "ticker string, date date, gdelt_tone double, gdelt_vol long, wiki_views long")
    filings = spark.createDataFrame([("T00", day(i), f) for i in (5, 6, 7, 40, 41) for f in ("8-K", "4", "424B5")][1:], "ticker string, date date, form string")
    meetings = spark.createDataFrame([("FOMC Meeting", day(20)), ("CPI", day(47)), ("FOMC Meeting", day(60))], "event_name string, date date")
    macro = spark.createDataFrame([(day(i), float(i)) for i in range(3, DAYS, 10)], "date date, rate double")
    return {
        "events": events, "scored": events, "apprehension": E.apprehension(events, F.lit(day(88)), 30).withColumn("outlook", F.lit("improving")), "calendar": meetings,
        "earnings": spark.createDataFrame([("T01", day(25)), ("T01", day(55)), ("T02", day(4))], "ticker string, date date"),
        "macro": macro, "tone": daily.select("ticker", "date", "gdelt_tone", "gdelt_vol"), "filings": filings, "views": daily.select("ticker", "date", "wiki_views"),
    }


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1.0, abs(a)))


def same(left, right):
    """Equal rows on the columns of ``right``."""
    cols = right.columns
    a = {(r.ticker, r.date): r for r in left.select(*cols).collect()}
    b = {(r.ticker, r.date): r for r in right.collect()}
    assert a.keys() == b.keys() and len(a) > 200
    wrong = [(k, c, a[k][c], b[k][c]) for k in a for c in cols if not close(a[k][c], b[k][c])]
    assert not wrong, wrong[:5]


@pytest.fixture(scope="module")
def whole(bars, sources):
    return A.feature_matrix(bars, "T03", **sources).cache()


def test_equals_the_single_operators(bars, sources, whole):
    keys = bars.select("ticker", "date")
    same(whole, P.price_features(bars, "T03"))
    dense = E.densify(E.attention_features(E.tone_features(E.filing_features(keys, sources["filings"]), sources["tone"]), sources["views"]))
    same(whole, dense)
    same(whole, E.earnings_features(keys, sources["earnings"]))
    same(whole, E.market_calendar_features(keys, sources["calendar"]))
    same(whole, E.join_macro(keys, sources["macro"]))
    same(whole, E.text_features(keys, sources["scored"]))
    same(whole, keys.join(E.event_features(sources["events"]), ["ticker", "date"], "left"))


@pytest.mark.parametrize("absent", ["events", "scored", "apprehension", "calendar", "earnings", "macro", "tone", "filings", "views"])
def test_any_source_may_be_absent(bars, sources, whole, absent):
    out = A.feature_matrix(bars, "T03", **{k: v for k, v in sources.items() if k != absent})
    assert set(out.columns) < set(whole.columns)
    same(whole, out)


def test_prices_alone_and_optional_blocks(bars):
    out = A.feature_matrix(bars)
    assert out.count() == bars.count() and "beta_60" in out.columns and not {"news_tone", "sec_present"} & set(out.columns)
    more = A.feature_matrix(bars, "T03", (3,), extended=False, nonlinear=True, market_mode=True)
    assert {"perm_entropy_60", "rmt_market_beta", "rmt_systematic_frac", "forward_return_3d"} <= set(more.columns) and more.count() == bars.count()


def test_sources_do_not_add_exchanges(bars, sources):
    def shuffles(**given):
        plan = A.feature_matrix(bars, "T03", **given)._jdf.queryExecution().executedPlan().toString()
        return plan.count("hashpartitioning(ticker")

    keyed = {k: sources[k] for k in ("events", "scored", "tone", "filings", "views", "earnings")}
    assert shuffles(**keyed) <= shuffles(tone=sources["tone"]) + 1  # earnings are made distinct before


def test_nothing_in_nothing_out(spark, bars, sources):
    assert A.feature_matrix(bars.limit(0), "T03", **sources).count() == 0
    none = {k: v.limit(0) for k, v in sources.items()}
    out = A.feature_matrix(bars, "T03", **none)
    assert out.count() == bars.count() and out.filter("news_present = 1 or wiki_present = 1 or sec_present = 1 or event_count > 0").count() == 0
