"""Checks, decisions, sizing, ledger and table-rule queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barleaf.operators import calibration as C
from barleaf.operators import decisions as D
from barleaf.operators import evaluate as V
from barleaf.operators import quality as Q
from barleaf.operators import sizing as Z
from barleaf.operators import tablerules as R
from barleaf.plans.basesql import BARS, PRICE, W
from barleaf.plans.event_queries import NEWS
from barleaf.plans.price_queries import features
from barleaf.plans.registry import add_query
from barleaf.plans.rule_queries import METRICS_SQL, daily_sql, weights_of
from barleaf.plans.rule_sql import SQL
from barleaf.plans.source_queries import BLOTTER, blotter_frame
from barleaf.sources import tables as T

# -- checks -------------------------------------------------------------------


def rough_bars(s, d):
    """Bars with some values spoiled by a rule on volume, so checks can fail."""
    return T.bars(s, d).withColumns({
        "low": F.when(F.col("volume") % 97 == 0, F.col("high") + 1).otherwise(F.col("low")),
        "open": F.when(F.col("volume") % 89 == 0, -F.col("open")).otherwise(F.col("open")),
        "close": F.when(F.col("volume") % 11 == 0, F.lit(None)).otherwise(F.col("close")),
    })


ROUGH = """
rough as (select ticker, date, case when volume % 89 = 0 then -open else open end as open, high, case when volume % 97 = 0 then high + 1 else low end as low,
   case when volume % 11 = 0 then null else close end as close, adj_close, volume from bars)"""
add_query(
    "quality_sanitized", "date:d ticker close", lambda s, d: Q.sanitize_bars(rough_bars(s, d)), BARS, ROUGH,
    "out as (select date, ticker, close from rough where close > 0 and open > 0 and high > 0 and low > 0 and high >= low and high >= open and high >= close and low <= open and low <= close)",
)
add_query(
    "quality_bar_checks", "check_name passed failures:i", lambda s, d: Q.check_bars(rough_bars(s, d)), BARS, ROUGH,
    """t as (select count(*) as n, count(*) filter (low > open or low > close or high < open or high < close or low > high) as sane, count(*) filter (volume < 0) as vol,
        count(*) filter (open <= 0 or close <= 0 or high <= 0 or low <= 0) as pos, count(*) - count(close) as nul from rough)""",
    "dup as (select count(*) as k from (select date, ticker from rough group by all having count(*) > 1))",
    """out as (select 'has_required_columns' as check_name, true as passed, 0 as failures union all select 'no_duplicate_date_ticker', k = 0, k from dup
        union all select 'ohlc_sanity', sane = 0, sane from t union all select 'volume_non_negative', vol = 0, vol from t union all select 'prices_positive', pos = 0, pos from t
        union all select 'missing_under_5pct', nul / n < 0.05, nul from t)""",
)
add_query(
    "quality_event_checks", "check_name passed", lambda s, d: Q.check_events(T.news(s, d).withColumn("sentiment", F.col("sentiment") * 1.005)), NEWS,
    "out as (select 'non_empty' as check_name, count(*) > 0 as passed from news0 union all select 'known_at_after_published', true union all select 'sentiment_in_range', not bool_or(abs(sentiment * 1.005) > 1) from news0)",
)

# -- selections and decisions -------------------------------------------------

_CUT = "lastd as (select max(date) as d from feat)"
_TODAY = "today as (select feat.* from feat, lastd where date = d)"
add_query("select_complete_cases", "date:d ticker mom_120d:6 vol_60d:6", lambda s, d: D.complete_cases(features(s, d), ["mom_120d", "vol_60d", "sma_200"]), PRICE,
          "out as (select date, ticker, mom_120d, vol_60d from feat where mom_120d is not null and vol_60d is not null and sma_200 is not null)")
add_query("select_latest_cross_section", "date:d ticker mom_20d:6 rsi_14:6", lambda s, d: D.latest_cross_section(features(s, d)), PRICE, _CUT, _TODAY, relation="today")
add_query("select_latest_per_ticker", "date:d ticker mom_20d:6 rsi_14:6", lambda s, d: D.latest_per_ticker(features(s, d), ["mom_20d", "rsi_14"]), PRICE,
          "out as (select * from (select *, row_number() over (partition by ticker order by date desc) as rn from feat) where rn = 1)")
add_query(
    "select_screener", "ticker mom_20d:6 vol_20d:6", lambda s, d: D.screen(D.latest_cross_section(features(s, d)), {"mom_20d": (-0.9, None), "vol_20d": (None, 60.0), "rsi_14": (20, 80)}, "mom_20d"),
    PRICE, _CUT, _TODAY, "out as (select * from today where mom_20d >= -0.9 and vol_20d <= 60 and rsi_14 between 20 and 80)",
)
add_query(
    "select_recent_events", "ticker event_id:i rank:i", lambda s, d: D.recent_events(T.news(s, d)), NEWS,
    """out as (select * from (select ticker, doc_id as event_id, row_number() over (partition by ticker order by known_at desc, doc_id desc) as rank from news
        where known_at >= (select max(known_at) from news) - interval 14 days) where rank <= 20)""",
)
_PLACED = "placed as (select date, ticker, mom_20d, row_number() over (order by mom_20d desc nulls last, ticker) as rank_in_universe, count(*) over () as universe_size from today)"
add_query("select_place_in_universe", "date:d ticker mom_20d:6 rank_in_universe:i universe_size:i", lambda s, d: D.place_in_universe(features(s, d)), PRICE, _CUT, _TODAY, _PLACED, relation="placed")
add_query(
    "select_top_and_bottom", "side names", lambda s, d: D.top_and_bottom(features(s, d)).withColumn("names", F.array_join("tickers", ",")), PRICE, _CUT, _TODAY, _PLACED,
    """out as (select 'top' as side, string_agg(ticker, ',' order by rank_in_universe) as names from placed where rank_in_universe <= 10
        union all select 'bottom', string_agg(ticker, ',' order by rank_in_universe) from placed where rank_in_universe > universe_size - 10)""",
)
add_query(
    "select_breadth", "bin:i n:i bull:i high_vol:i", lambda s, d: D.breadth(features(s, d)), PRICE, _CUT, _TODAY,
    "edge as (select min(mom_20d) as lo, max(mom_20d) as hi from today)",
    "out as (select least(floor((mom_20d - lo) / ((hi - lo) / 30)), 29) as bin, count(*) as n, count(*) filter (bull_regime = 1) as bull, count(*) filter (high_vol_regime = 1) as high_vol from today, edge where mom_20d is not null group by 1)",
)


def pts(c, p):
    return f"(case when {c} then cast({p} as double) else 0 end)"


SCORE = " + ".join([
    pts("coalesce(mom_20d, 0) > 0", 0.003), pts("coalesce(mom_60d, 0) > 0", 0.002), pts("coalesce(sma_gap_200, 0) > 0", 0.002), pts("rsi_14 < 30", 0.004),
    pts("rsi_14 > 75", -0.004), pts("coalesce(breakout_20, 0) > 0", 0.002), pts("coalesce(dd_from_high_60, 0) < -0.2", -0.002), pts("coalesce(vol_20d, 0) > 0.6", -0.0015),
])
_SCORED = f"sc as (select *, {SCORE} as score from feat)"
add_query("decide_rule_score", "date:d ticker score:6 n_reasons:i", lambda s, d: D.rule_score(features(s, d)).withColumn("n_reasons", F.size("reasons")), PRICE, _SCORED,
          f"out as (select *, {SCORE.replace('cast(0.0015 as double)', '1').replace('cast(-0.0015 as double)', '1').replace('cast(-0.002 as double)', '1').replace('cast(-0.004 as double)', '1').replace('cast(0.002 as double)', '1').replace('cast(0.003 as double)', '1').replace('cast(0.004 as double)', '1')} as n_reasons from sc)")
_STANCE = """
case when coalesce(avg_dollar_volume_20, 0) < 50000 then 'HOLD' when score >= 0.005 and rsi_14 > 52 then 'HOLD' when score >= 0.005 then 'BUY'
     when score <= -0.0015 and rsi_14 < 40 then 'HOLD' when score <= -0.0015 then 'SELL' else 'HOLD' end"""
_TIMING = """
case when coalesce(rsi_14, 50) > 70 or coalesce(sma_gap_50, 0) > 0.15 then 'extended, wait for a pullback'
     when coalesce(rsi_14, 50) < 45 or coalesce(sma_gap_50, 0) < -0.03 then 'pullback, accumulate now' else 'neutral, scale in' end"""
_LIMITS = dict(sell=-0.0015, overbought=52.0, oversold=40.0, min_adv=50000.0)


def stances(s, d):
    return D.stance(D.confidence(D.rule_score(features(s, d))), **_LIMITS)


add_query("decide_stance", "date:d ticker stance confidence:6", stances, PRICE, _SCORED, f"out as (select date, ticker, {_STANCE} as stance, least(1, abs(score) / 0.05) as confidence from sc)")
add_query("decide_stance_counts", "stance n:i", lambda s, d: D.stance_counts(stances(s, d)), PRICE, _SCORED, f"st as (select {_STANCE} as stance from sc)", "out as (select stance, count(*) as n from st group by 1)")
add_query("decide_timing_hint", "date:d ticker timing", lambda s, d: features(s, d).withColumn("timing", D.timing_hint(F.col("rsi_14"), F.col("sma_gap_50"))), PRICE, f"out as (select date, ticker, {_TIMING} as timing from feat)")
add_query(
    "decide_confidence_spread", "date:d ticker confidence:8", lambda s, d: D.confidence(features(s, d).filter("mom_20d is not null").selectExpr("date", "ticker", "mom_20d as score"), True), PRICE,
    """out as (select date, ticker, case when count(*) over (partition by date) < 30 then least(1, abs(mom_20d) / 0.05)
        else least(1, abs(mom_20d) / stddev_pop(mom_20d) over (partition by date) / 3) end as confidence from feat where mom_20d is not null)""",
)
add_query(
    "decide_panel", "date:d ticker source score:8 forecast_20d:8 confidence:8 stance timing",
    lambda s, d: D.decision_panel(features(s, d), D.latest_cross_section(features(s, d)).filter("mom_60d > 0").selectExpr("ticker", "mom_60d / 1000 as score"), **_LIMITS),
    PRICE, _SCORED, _CUT, "td0 as (select sc.* exclude (score), case when mom_60d > 0 then mom_60d / 1000 else score end as score, case when mom_60d > 0 then 'model' else 'rules' end as source from sc, lastd where date = d)",
    f"out as (select date, ticker, source, score, score * 4 * 0.65 as forecast_20d, least(1, abs(score) / 0.05) as confidence, {_STANCE} as stance, {_TIMING} as timing from td0)",
)
add_query(
    "decide_signal_table", "date:d ticker stance confidence:6", lambda s, d: D.signal_table(stances(s, d).select("date", "ticker", "stance", "confidence"), min_confidence=0.05), PRICE, _SCORED,
    f"st as (select date, ticker, {_STANCE} as stance, least(1, abs(score) / 0.05) as confidence, row_number() over (partition by ticker order by date desc) as rn from sc)",
    "out as (select * from st where rn = 1 and confidence >= 0.05)",
)

# -- sizing -------------------------------------------------------------------

_MOMW = [PRICE, *SQL["momentum_rotation"]]


def mom(s, d):
    return weights_of("momentum_rotation")(s, d)


add_query("size_equal_weight", "date:d ticker weight:9", lambda s, d: Z.equal_weight(mom(s, d)), *_MOMW,
          "eq as (select date, ticker, 1.0 / count(*) over (partition by date) as weight from out where weight > 0)", relation="eq")
add_query("size_vol_target", "date:d ticker weight:9", lambda s, d: Z.vol_target(mom(s, d), features(s, d), 3.0), *_MOMW,
          "vt as (select o.date, o.ticker, o.weight * coalesce(case when vol_20d is not null then least(greatest(3.0 / greatest(vol_20d, 0.0001), 0), 5) end, 1) as weight from out o left join feat f using (date, ticker))", relation="vt")
add_query("size_risk_limits", "date:d ticker weight:9", lambda s, d: V.cap_weights(weights_of("mean_reversion")(s, d).filter("weight is not null"), 0.08, 0.5), PRICE, *SQL["mean_reversion"],
          "cl as (select date, ticker, greatest(least(weight, 0.08), -0.08) as w from out where weight is not null)",
          "lim as (select date, ticker, w * case when sum(abs(w)) over (partition by date) > 0.5 then 0.5 / sum(abs(w)) over (partition by date) else 1 end as weight from cl)", relation="lim")
add_query("size_gross_exposure", "date:d gross:9", lambda s, d: mom(s, d).groupBy("date").agg(F.sum(F.abs("weight")).alias("gross")), *_MOMW, "gr as (select date, sum(abs(weight)) as gross from out group by 1)", relation="gr")
add_query(
    "size_kill_switch", "date:d ticker weight:9",
    lambda s, d: Z.kill_switch(weights_of("min_vol_portfolio")(s, d), V.daily_results(T.panel(s, d), weights_of("min_vol_portfolio")(s, d)), 0.3),
    PRICE, *SQL["min_vol_portfolio"], daily_sql(), "off as materialized (select min(date) as at from dd where drawdown < -0.3)",
    "ks as (select o.date, o.ticker, case when o.date >= off.at then 0 else o.weight end as weight from out o, off)", relation="ks",
)


def bands(s, d):
    f = features(s, d).filter("mom_20d is not null and vol_20d is not null")
    return f.selectExpr("date", "ticker", "mom_20d / 100 as median", "mom_20d / 100 - vol_20d / 200 as lo", "adj_close as price", "mom_60d / 100 as score", "vol_20d / 100 as vol_20d")


BANDS = "bands as (select date, ticker, mom_20d / 100 as median, mom_20d / 100 - vol_20d / 200 as lo, adj_close as price, mom_60d / 100 as score, vol_20d / 100 as vol_20d from feat where mom_20d is not null and vol_20d is not null)"
SIZED = [
    PRICE, BANDS, "b1 as (select date, ticker, price, median / greatest(0.02, -lo) as s from bands where median > 0)",
    "b2 as (select *, least(cast(0.5 as double) * s / sum(s) over (partition by date), cast(0.1 as double)) as w from b1)",
    "sized as (select date, ticker, price, case when sum(w) over (partition by date) > 1 then w / sum(w) over (partition by date) else w end as weight from b2)",
]
add_query("size_by_band", "date:d ticker weight:9", lambda s, d: Z.band_sized(bands(s, d)), *SIZED, relation="sized")


def shares(s, d):
    """Each date's momentum leaders weighted by dollar volume, uncapped."""
    f = features(s, d).filter("avg_dollar_volume_20 is not null and mom_20d > 0")
    return Z.total(f, F.col("avg_dollar_volume_20"), "_w").select("date", "ticker", (F.col("avg_dollar_volume_20") / F.col("_w")).alias("weight"))


def passes(cap: float, n: int = 32) -> list[str]:
    """The iterative definition, unrolled: cap, spread the excess, repeat."""
    out = ["p0 as (select date, ticker, avg_dollar_volume_20 / sum(avg_dollar_volume_20) over (partition by date) as w from feat where avg_dollar_volume_20 is not null and mom_20d > 0)"]
    for i in range(n):
        out.append(
            f"p{i + 1} as materialized (select date, ticker, case when w > {cap} + 1e-12 then {cap} when r > 1e-12 then w + x * w / r else w end as w from "
            f"(select *, sum(greatest(w - {cap}, 0)) over (partition by date) as x, coalesce(sum(case when w <= {cap} + 1e-12 then w end) over (partition by date), 0) as r from p{i}))"
        )
    return out


add_query("size_cap_redistribute", "date:d ticker weight:6", lambda s, d: Z.cap_and_redistribute(shares(s, d), 0.25), PRICE, *passes(0.25, 60), "out as (select date, ticker, case when count(*) over (partition by date) * 0.25 <= 1 then 0.25 else w end as weight from p60)")
add_query(
    "size_budget_positions", "date:d ticker weight:9 dollars:5 whole_shares:i", lambda s, d: Z.to_positions(Z.band_sized(bands(s, d)), F.lit(10000.0), 600.0), *SIZED,
    "q0 as (select *, weight / sum(weight) over (partition by date) as w from sized)",
    "q1 as (select *, sum(w) filter (w * 10000 >= 600) over (partition by date) as kept from q0)",
    "q2 as (select date, ticker, price, w / coalesce(kept, 1) as weight from q1 where w * 10000 >= 600 or kept is null)",
    "out as (select *, weight * 10000 as dollars, floor(weight * 10000 / price) as whole_shares from q2)",
)
add_query(
    "size_tiered_allocation", "date:d ticker tier:i allocated:5", lambda s, d: Z.tiered_allocation(bands(s, d).filter("score >= 0.003"), 10000.0), PRICE, BANDS,
    "r as (select *, row_number() over (partition by date order by score desc, ticker) - 1 as k from bands where score >= 0.003)",
    "t as (select *, case when k < 5 then 1 when k < 15 then 2 else 3 end as tier, case when k < 5 then cast(0.15 as double) when k < 15 then 0.09 else 0.05 end as pct from r where k < 20)",
    "u as (select *, greatest(50, least(10000 * pct * least(score / cast(0.05 as double), 1) * least(cast(0.2 as double) / greatest(vol_20d, 0.04), 2.5), 10000 * pct)) as wish from t)",
    "v as (select *, 7500 - coalesce(sum(wish) over (partition by date order by k rows between unbounded preceding and 1 preceding), 0) as room from u)",
    "out as (select date, ticker, tier, least(wish, room) as allocated from v where room >= 50)",
)
add_query(
    "size_top_up", "date:d ticker allocated:5",
    lambda s, d: Z.top_up_allocation(bands(s, d), mom(s, d).filter("weight > 0").select("date", "ticker"), 10000.0, 6000.0), PRICE, *SQL["momentum_rotation"], BANDS,
    "c as (select *, row_number() over (partition by date order by score desc, ticker) as k from bands b where score >= 0.005 and not exists (select 1 from out o where o.date = b.date and o.ticker = b.ticker and o.weight > 0))",
    "u as (select *, greatest(50, 10000 * cast(0.09 as double) * least(score / cast(0.05 as double), 1) * least(cast(0.2 as double) / greatest(vol_20d, 0.04), 2.5)) as wish from c)",
    "v as (select *, 3500 - coalesce(sum(wish) over (partition by date order by k rows between unbounded preceding and 1 preceding), 0) as room from u)",
    "tu as (select date, ticker, least(wish, room) as allocated from v where room >= 50)", relation="tu",
)


def last_prices(s, d):
    return D.latest_per_ticker(T.panel(s, d), ["adj_close"]).select("ticker", F.col("adj_close").alias("price"))


def holdings(s, d):
    lots = blotter_frame(s, d).filter("side = 'BUY'")
    return lots.groupBy("ticker").agg(F.sum("qty").alias("qty"), F.max("price").alias("last_price"))


HOLD = [BARS, BLOTTER, "lastp as (select ticker, arg_max(adj_close, date) as price from panel group by 1)",
        "hold as (select ticker, sum(qty) as qty, max(price) as last_price from blotter where side = 'BUY' group by 1)"]
add_query(
    "size_orders", "ticker qty:4 side notional:3",
    lambda s, d: Z.to_orders(D.latest_cross_section(mom(s, d)).filter("weight > 0"), holdings(s, d), last_prices(s, d), F.lit(1e6)), *_MOMW, *[h for h in HOLD if h is not BARS],
    "tgt as (select ticker, weight from out where date = (select max(date) from out) and weight > 0)",
    "dl as (select coalesce(t.ticker, h.ticker) as ticker, coalesce(weight, 0) * 1e6 / price - coalesce(qty, 0) as qty, price from tgt t full join hold h on t.ticker = h.ticker join lastp p on p.ticker = coalesce(t.ticker, h.ticker))",
    "ord as (select ticker, qty, case when qty > 0 then 'buy' else 'sell' end as side, abs(qty * price) as notional from dl where abs(qty * price) >= 1)", relation="ord",
)

# -- leakage ------------------------------------------------------------------

_SH = "sharpe as (select avg(net_ret) / stddev_samp(net_ret) * sqrt(252) as v from daily)"


def both_sharpes(first: str, second: str) -> str:
    return f"(select v from {first}) as a, (select v from {second}) as b"


def suffixed(sql: str, tag: str) -> str:
    for name in ("rets", "days", "names", "g0", "g1", "g2", "g3", "g4", "g5", "daily", "curve", "dd", "sharpe"):
        sql = re.sub(rf"\b{name}\b", f"{name}{tag}", sql)
    return sql


add_query(
    "leakage_shift", "base_sharpe:6 shifted_sharpe:6 delta:6 leak_suspect", lambda s, d: C.shift_test(T.panel(s, d), mom(s, d)), *_MOMW, daily_sql(), _SH,
    "early as (select date, ticker, coalesce(lead(weight) over (partition by ticker order by date), 0) as weight from out)", suffixed(daily_sql(weights="early"), "_e"), suffixed(_SH, "_e"),
    f"res as (select a as base_sharpe, b as shifted_sharpe, b - a as delta, b - a > 0.3 as leak_suspect from (select {both_sharpes('sharpe', 'sharpe_e')}))", relation="res",
)
add_query(
    "leakage_delay", "base_sharpe:6 delayed_sharpe:6 robust", lambda s, d: C.delay_test(T.panel(s, d), mom(s, d)), *_MOMW, daily_sql(), _SH, suffixed(daily_sql(3), "_e"), suffixed(_SH, "_e"),
    f"res as (select a as base_sharpe, b as delayed_sharpe, b > 0 and a - b < 0.5 * abs(a + 1e-6) + 1 as robust from (select {both_sharpes('sharpe', 'sharpe_e')}))", relation="res",
)
# hash order is Spark's own, so the shuffle has no SQL twin; tests check it
add_query("leakage_shuffle", "shuffled_sharpe:6", lambda s, d: C.shuffle_test(T.panel(s, d), mom(s, d)))

# -- portfolio and blotter ----------------------------------------------------

add_query("book_realised_profit", "year:i realized_pnl:2 n:i", lambda s, d: R.realised_profit(blotter_frame(s, d)), BLOTTER,
          "out as (select year(trade_date) as year, sum((price - avg_cost_basis) * qty) as realized_pnl, count(*) as n from blotter where side = 'SELL' and avg_cost_basis is not null group by 1)")
_PW = "pw as (select h.ticker, qty, qty * coalesce(price, last_price) as value, 100 * qty * coalesce(price, last_price) / (sum(qty * coalesce(price, last_price)) over () + 1000000) as weight_pct from hold h left join lastp using (ticker))"


def pweights(s, d):
    return R.portfolio_weights(holdings(s, d), last_prices(s, d), 1e6)


add_query("book_portfolio_weights", "ticker qty:2 value:2 weight_pct:8", pweights, *HOLD, _PW, relation="pw")
add_query("book_drawdown", "invested:2 drawdown:9", lambda s, d: R.drawdown_from(5e7, pweights(s, d)), *HOLD, _PW, "out as (select sum(value) as invested, 1 - sum(value) / 5e7 as drawdown from pw)")


def name_lists(s, d):
    """Lists per brand from its number, rating and price from the panel."""
    no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    base = T.table(s, d, "part").select(F.col("p_brand").alias("ticker"), no.alias("no")).distinct()
    px = D.latest_per_ticker(features(s, d), ["adj_close", "sma_50"]).selectExpr("ticker", "adj_close as price", "sma_50 as sma50")
    return base.join(px, "ticker", "left").selectExpr(
        "ticker", "no % 5 = 0 as semi", "no % 7 = 0 as defensive", "no % 11 = 0 as never_buy", "no % 6 = 0 as lockout", "no % 4 = 1 as hold_winner",
        "cast(no % 10 as double) as rating", "case when no % 3 = 0 then 2.0D end as cap_pct", "price", "sma50",
    )


LISTS = """
lists as (select ticker, no % 5 = 0 as is_semi, no % 7 = 0 as defensive, no % 11 = 0 as never_buy, no % 6 = 0 as lockout, no % 4 = 1 as hold_winner, no % 10 as rating,
   case when no % 3 = 0 then 2.0 end as cap_pct, price, sma50 from (select distinct p_brand as ticker, cast(regexp_extract(p_brand, '(\\d+)', 1) as int) as no from part)
   left join (select ticker, arg_max(adj_close, date) as price, arg_max(coalesce(sma_50, -1), date) as sma50 from feat group by 1) using (ticker))"""
add_query("book_cap_watch", "ticker weight_pct:8 cap_pct:2 barred", lambda s, d: R.cap_watch(pweights(s, d), name_lists(s, d)), PRICE, *[h for h in HOLD if h is not BARS], _PW, LISTS,
          "out as (select ticker, weight_pct, coalesce(cap_pct, 13) as cap_pct, weight_pct >= coalesce(cap_pct, 13) as barred from pw left join lists using (ticker) where weight_pct >= coalesce(cap_pct, 13) - 1.5)")
add_query("book_top_weights", "ticker weight_pct:8", lambda s, d: R.top_weights(pweights(s, d)), *HOLD, _PW, "out as (select ticker, weight_pct from pw order by weight_pct desc, ticker limit 8)")
add_query("book_upcoming", "o_orderkey:i date:d", lambda s, d: R.upcoming(T.table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), F.to_date(F.lit("1998-06-15"))),
          "out as (select o_orderkey, cast(o_orderdate as date) as date from orders where cast(o_orderdate as date) between date '1998-06-15' and date '1998-06-29')")
add_query("book_mark_to_market", "deployed_mtm:2 equity:2 return_pct:9", lambda s, d: R.mark_to_market(holdings(s, d).selectExpr("ticker", "qty as shares", "last_price as entry_price"), last_prices(s, d).filter("price < 2000"), 5e5, 1e7),
          *HOLD, "m as (select sum(qty * coalesce(case when price < 2000 then price end, last_price)) as deployed_mtm from hold left join lastp using (ticker))",
          "out as (select deployed_mtm, deployed_mtm + 500000 as equity, (deployed_mtm + 500000) / 1e7 - 1 as return_pct from m)")


def equity_log(s, d):
    return T.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("equity"))


add_query("book_horizon_pnl", "pnl_1m:8 pnl_3m:8 pnl_6m:8 pnl_1y:8", lambda s, d: R.horizon_pnl(equity_log(s, d)),
          "eq as (select cast(o_orderdate as date) as date, sum(o_totalprice) as equity from orders group by 1)", "l as (select max(date) as d, arg_max(equity, date) as e from eq)",
          "out as (select " + ", ".join(f"(select l.e / arg_max(equity, date) - 1 from eq where date <= l.d - {k}) as pnl_{n}" for n, k in (("1m", 30), ("3m", 91), ("6m", 182), ("1y", 365))) + " from l)")

# -- flags --------------------------------------------------------------------

KEYS = {"click": "O", "view": "F", "purchase": "I", "signup": "C", "error": "S"}


def flag_series(s, d):
    """Daily mean value of each event type as a dated series."""
    e = T.table(s, d, "events")
    flag = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in KEYS.items()])
    return e.groupBy(flag.alias("series_id"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))


SERIES = """
ser as (select case event_type when 'click' then 'O' when 'view' then 'F' when 'purchase' then 'I' when 'signup' then 'C' else 'S' end as series_id,
   cast(ts as date) as date, avg(value) as value from events group by 1, 2),
rd as (select series_id, arg_max(value, date) as value, arg_max(m5, date) as mean5, arg_max(m20, date) as mean20, arg_max(coalesce(p1, -1), date) as prior1, arg_max(coalesce(p12, -1), date) as prior12,
   arg_max(value, date) filter (date <= lastd - 9) as before from (select *, avg(value) over (partition by series_id order by date rows 4 preceding) as m5,
   avg(value) over (partition by series_id order by date rows 19 preceding) as m20, lag(value) over (partition by series_id order by date) as p1,
   lag(value, 12) over (partition by series_id order by date) as p12, max(date) over (partition by series_id) as lastd from ser) group by 1)"""


def readings_now(s, d):
    return R.series_readings(flag_series(s, d), 9)


add_query("flags_series_readings", "series_id value:8 mean5:8 mean20:8 before:8 change1_pct:6 change12_pct:6", lambda s, d: readings_now(s, d), SERIES,
          "out as (select *, (value / prior1 - 1) * 100 as change1_pct, (value / prior12 - 1) * 100 as change12_pct from rd)")


def colours(s, d):
    r = readings_now(s, d)
    c = F.col
    return r.select(
        "series_id", R.oil_colour(c("value"), c("mean5"), c("mean20"), None, 49.0, 52.0).alias("oil"), R.policy_colour(c("value"), c("before")).alias("policy"),
        R.inflation_colour(c("change1_pct"), c("change12_pct"), 0.2, 0.4, 5.0).alias("inflation"), R.tape_colour(c("value"), 51.0, 49.0).alias("tape"),
    )


add_query("flags_colours", "series_id oil policy inflation tape", colours, SERIES,
          "ch as (select *, (value / prior1 - 1) * 100 as c1, (value / prior12 - 1) * 100 as c12 from rd)",
          """out as (select series_id, case when mean5 > 52 and value > 52 then 'RED' when value > 52 then 'YELLOW' when value < 49 and value < mean20 then 'GREEN' else 'YELLOW' end as oil,
              case when value > before + 1e-9 then 'RED' when value < before - 1e-9 then 'GREEN' else 'YELLOW' end as policy,
              case when c12 > 5 then 'RED' when round(c1, 1) >= 0.4 then 'RED' when round(c1, 1) <= 0.2 then 'GREEN' else 'YELLOW' end as inflation,
              case when value > 51 then 'GREEN' when value < 49 then 'RED' else 'YELLOW' end as tape from ch)""")


def daily_readings(s, d):
    """One colour per flag and day from the day's mean value."""
    c = R.tape_colour(F.col("value"), 49.0, 46.0)
    return flag_series(s, d).select(F.col("date").alias("snapshot_at"), F.col("series_id").alias("flag"), F.when(F.col("value") > 56, "UNKNOWN").otherwise(c).alias("color"))


READ = "rdg as (select date as snapshot_at, series_id as flag, case when value > 56 then 'UNKNOWN' when value > 49 then 'GREEN' when value < 46 then 'RED' else 'YELLOW' end as color from ser)"
COMP = """comp as (select *, case color when 'RED' then 0.25 when 'GREEN' then 1.0 else 0.5 end as deployment_fraction, color = 'RED' as defensives_only from (
   select *, 5 - n_green - n_red as n_yellow, case when n_red > 0 then 'RED' when n_green >= 3 then 'GREEN' else 'YELLOW' end as color from (
   select snapshot_at, count(*) filter (color = 'GREEN') as n_green, count(*) filter (color = 'RED') as n_red, bool_or(flag in ('C', 'S') and color = 'RED') as semi_freeze from rdg group by 1)))"""
add_query("flags_composite", "snapshot_at:d n_green:i n_yellow:i n_red:i color deployment_fraction:2 semi_freeze defensives_only", lambda s, d: R.composite(daily_readings(s, d), green_min=3), SERIES, READ, COMP, relation="comp")


def overrides(s, d):
    n = T.table(s, d, "nation")
    flag = F.element_at(F.array(*[F.lit(f) for f in R.FLAGS]), F.col("n_nationkey") % 5 + 1)
    colour = F.element_at(F.array(F.lit("green"), F.lit("Red"), F.lit("purple")), F.col("n_regionkey") % 3 + 1)
    day = F.date_add(F.lit("2023-12-01").cast("date"), F.col("n_nationkey"))
    told = n.select(flag.alias("flag"), colour.alias("color"), day.alias("as_of"))
    return told.groupBy("flag").agg(F.max_by("color", "as_of").alias("color"), F.max("as_of").alias("as_of"))


add_query("flags_overrides", "snapshot_at:d flag color source stale", lambda s, d: R.apply_overrides(daily_readings(s, d), overrides(s, d), F.lit("2024-01-18").cast("date")), SERIES, READ,
          "ov as (select ['O', 'F', 'I', 'C', 'S'][n_nationkey % 5 + 1] as flag, arg_max(['GREEN', 'RED', 'PURPLE'][n_regionkey % 3 + 1], n_nationkey) as forced, date '2023-12-01' + max(n_nationkey) as as_of from nation group by 1)",
          """out as (select snapshot_at, flag, coalesce(forced, color) as color, case when forced is not null then 'override' else 'live' end as source,
              coalesce(date '2024-01-18' - as_of > 45, false) as stale from rdg left join (select * from ov where forced <> 'PURPLE') ov using (flag))""")


def light(s, d):
    """The newest day's composite, one row."""
    c = R.composite(daily_readings(s, d), green_min=3)
    return c.filter(F.col("snapshot_at") == c.agg(F.max("snapshot_at")).scalar())


LIGHT = "light as (select * from comp where snapshot_at = (select max(snapshot_at) from comp))"
_DEP = [SERIES, READ, COMP, LIGHT]
add_query("flags_deployment_overlay", "date:d ticker weight:9 dropped", lambda s, d: R.deployment_overlay(weights_of("weekly_mom_rotation")(s, d), name_lists(s, d), light(s, d)), PRICE, *SQL["weekly_mom_rotation"], LISTS, *_DEP,
          """ov1 as (select o.date, o.ticker, o.weight as w, deployment_fraction as f, case when weight > 0 and never_buy then 'never-buy list' when weight > 0 and semi_freeze and is_semi then 'semi freeze'
              when weight > 0 and defensives_only and not defensive then 'defensives only' end as dropped from out o left join lists using (ticker), light)""",
          "ov2 as (select date, ticker, case when dropped is not null then 0 when w > 0 then w * f else w end as weight, dropped from ov1)", relation="ov2")

# -- table rules --------------------------------------------------------------


def requests(s, d):
    return blotter_frame(s, d).select("trade_date", "ticker", "side", (F.col("qty") * F.col("price")).alias("dollars"))


def checked(s, d):
    return R.check_trades(requests(s, d), name_lists(s, d), pweights(s, d).filter("ticker <> 'Brand#2'"), light(s, d), R.drawdown_from(5e7, pweights(s, d)), default_cap=9.0)


def listing(cases):
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{t}' end" for t, c in cases.items()) + "], lambda v: v is not null), ';')"


_BROKEN = {
    "defensives only": "side = 'BUY' and defensives_only and not defensive", "semi freeze": "side = 'BUY' and semi_freeze and is_semi", "never-buy list": "side = 'BUY' and never_buy",
    "re-entry lockout": "side = 'BUY' and lockout and not coalesce(rating > 6 and l.price > sma50 and sma50 > 0, false)", "position cap": "side = 'BUY' and coalesce(weight_pct, 0) >= coalesce(cap_pct, 9)",
    "drawdown semi freeze": "side = 'BUY' and is_semi and (select 1 - sum(value) / 5e7 from pw) > 0.15",
}
_ADVISED = {
    "cap tranche at 25%": "side = 'BUY' and defensives_only and defensive", "approaching cap": "side = 'BUY' and coalesce(weight_pct, 0) < coalesce(cap_pct, 9) and coalesce(weight_pct, 0) >= coalesce(cap_pct, 9) - 1.5",
    "no held position": "side = 'SELL' and weight_pct is null", "hold-winner": "side = 'SELL' and weight_pct is not null and hold_winner",
}
add_query(
    "rules_compliance", "trade_date:d ticker side dollars:2 allowed broken advised",
    lambda s, d: checked(s, d).select("trade_date", "ticker", "side", "dollars", "allowed", F.array_join("violations", ";").alias("broken"), F.array_join("warnings", ";").alias("advised")).withColumn("ticker", F.initcap("ticker")),
    PRICE, *[h for h in HOLD if h is not BARS], _PW, LISTS, *_DEP,
    f"""chk as (select b.trade_date, b.ticker, b.side, b.qty * b.price as dollars, {listing(_BROKEN)} as broken, {listing(_ADVISED)} as advised
        from blotter b left join lists l using (ticker) left join (select * from pw where ticker <> 'Brand#2') w using (ticker), light)""",
    "out as (select *, broken = '' as allowed from chk)",
)


def threshold_rules(s, d):
    """One rule per part: kind from its size, levels from its list price."""
    kinds = ["stop_and_trim", "floor", "probation_band", "exit_band", "event_kill_switch", "rating_review", "hold", "probation_floor"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("p_size") % 8 + 1)
    key = F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("raise")), F.col("p_partkey").cast("int") % 3 + 1)
    p = F.col("p_retailprice")
    return T.table(s, d, "part").select(
        "p_partkey", F.when(F.col("p_size") % 13 != 0, F.col("p_brand")).otherwise("Brand#none").alias("ticker"), kind.alias("kind"),
        (p * 2).alias("stop_below"), (p * 6).alias("trim_above"), (p * 2.5).alias("floor"), (p * 2).alias("sell_below"), (p * 3).alias("strength_lo"), (p * 3.5).alias("strength_hi"),
        (p * 5).alias("recovery_lo"), (p * 5.5).alias("recovery_hi"), (p * 1.5).alias("capitulation_below"), F.when(F.col("p_partkey") % 4 != 0, key).alias("event_key"),
        F.lit("true").alias("event_sell_value"), F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 7).cast("double")).alias("rating"), F.lit(2.0).alias("rating_below"),
    )


def event_values(s, d):
    e = T.table(s, d, "events").groupBy(F.col("event_type").alias("event_key")).agg(F.avg("value").alias("_m"))
    return e.select("event_key", F.when(F.col("_m") > 49, "true").otherwise("false").alias("event_value"))


def near(level):
    return f"abs(price - {level}) / {level} <= 0.03"


TRULES = """
tr as (select p_partkey, case when p_size % 13 <> 0 then p_brand else 'Brand#none' end as ticker,
   ['stop_and_trim', 'floor', 'probation_band', 'exit_band', 'event_kill_switch', 'rating_review', 'hold', 'probation_floor'][p_size % 8 + 1] as kind, p_retailprice as p,
   case when p_partkey % 4 <> 0 then ['click', 'view', 'raise'][p_partkey % 3 + 1] end as event_key, case when p_size % 5 <> 0 then p_size % 7 end as rating from part),
ev as (select event_type as event_key, case when avg(value) > 49 then 'true' else 'false' end as event_value from events group by 1),
tj as (select * from tr left join lastp using (ticker) left join ev using (event_key))"""
add_query(
    "rules_standing", "ticker kind status n:i",
    lambda s, d: R.standing_rules(threshold_rules(s, d), last_prices(s, d), event_values(s, d)).groupBy("ticker", "kind", "status").agg(F.count("*").alias("n")), *HOLD, TRULES,
    f"""st as (select ticker, kind, case when kind = 'hold' then 'OK' when price is null and kind <> 'event_kill_switch' then 'NO_DATA'
        when kind = 'stop_and_trim' then case when price < p * 2 or price > p * 6 then 'TRIGGERED' when {near('(p * 2)')} then 'NEAR' else 'OK' end
        when kind in ('floor', 'probation_floor') then case when price < p * 2.5 or event_value = 'true' then 'TRIGGERED' when {near('(p * 2.5)')} then 'NEAR' when event_key is not null and event_value is null then 'AWAITING' else 'OK' end
        when kind = 'probation_band' then case when price < p * 2 or price between p * 3 and p * 3.5 or event_value = 'true' then 'TRIGGERED' when {near('(p * 2)')} then 'NEAR' else 'OK' end
        when kind = 'exit_band' then case when price >= p * 5 or price < p * 1.5 then 'TRIGGERED' when {near('(p * 1.5)')} or {near('(p * 5)')} then 'NEAR' else 'OK' end
        when kind = 'event_kill_switch' then case when event_value = 'true' then 'TRIGGERED' else 'OK' end
        when kind = 'rating_review' then case when rating is null then 'NO_DATA' when rating < 2 then 'TRIGGERED' else 'OK' end end as status from tj)""",
    "out as (select ticker, kind, status, count(*) as n from st group by all)",
)


def cycles(s, d):
    """One dated rule per order: window, conditions and two legs."""
    o = T.table(s, d, "orders")
    k, day = F.col("o_orderkey").cast("int"), F.to_date("o_orderdate")
    flag = F.element_at(F.array(*[F.lit(f) for f in R.FLAGS]), k % 5 + 1)
    brand = F.concat(F.lit("Brand#"), (k % 27 + 1).cast("string"))
    leg = F.struct(brand.alias("ticker"), F.col("o_totalprice").alias("dollars"), F.when(k % 3 == 0, F.lit(1000.0)).alias("min_price"), F.when(k % 4 == 0, F.lit(4000.0)).alias("max_price"))
    other = F.struct(F.concat(F.lit("Brand#"), (k % 19 + 1).cast("string")).alias("ticker"), F.lit(100.0).alias("dollars"), F.lit(None).cast("double").alias("min_price"), F.when(k % 5 == 0, F.lit(6000.0)).alias("max_price"))
    return o.select(
        F.col("o_orderkey").alias("rule_id"), day.alias("start"), F.when(k % 10 != 0, F.date_add(day, 200)).alias("end"),
        F.when(k % 2 == 0, flag).alias("flag"), F.array(F.lit("GREEN"), F.lit("YELLOW")).alias("flag_allowed"), F.when(k % 7 == 0, flag).alias("bad_flag"), F.array(F.lit("RED")).alias("flag_banned"),
        F.when(k % 11 == 0, F.array(F.lit("GREEN"), F.lit("YELLOW"))).alias("composite_in"), F.when(k % 13 == 0, F.element_at(F.array(F.lit("click"), F.lit("raise")), k % 2 + 1)).alias("event_key"), F.lit("true").alias("event_equals"),
        F.when(k % 6 == 0, brand).alias("guard_ticker"), F.lit(3000.0).alias("price_below"), F.when(k % 8 == 0, brand).alias("weight_ticker"), F.lit(4.0).alias("weight_below"), F.array(leg, other).alias("orders"),
    )


def newest_readings(s, d):
    r = daily_readings(s, d)
    return r.filter(F.col("snapshot_at") == r.agg(F.max("snapshot_at")).scalar())


_FLAG = "['O', 'F', 'I', 'C', 'S'][o_orderkey % 5 + 1]"
_BRAND = "'Brand#' || (o_orderkey % 27 + 1)"
add_query(
    "rules_cycles", "rule_id:i status n_orders:i dollars:2",
    lambda s, d: R.cycle_rules(cycles(s, d), newest_readings(s, d), light(s, d).select("color").scalar(), event_values(s, d), last_prices(s, d), pweights(s, d), F.lit("1998-06-15").cast("date")),
    *HOLD, _PW, *_DEP, TRULES, "nr as (select * from rdg where snapshot_at = (select max(snapshot_at) from rdg))",
    f"""cy as (select o.o_orderkey as k, o_totalprice as dollars, {_BRAND} as brand, 'Brand#' || (o_orderkey % 19 + 1) as brand2, r.color as fc, event_value, lp.price as gp, lp2.price as gp2, coalesce(weight_pct, 0) as gw, light.color as lc
        from orders o left join nr r on r.flag = {_FLAG} left join ev on ev.event_key = ['click', 'raise'][o_orderkey % 2 + 1] left join lastp lp on lp.ticker = {_BRAND}
        left join lastp lp2 on lp2.ticker = 'Brand#' || (o_orderkey % 19 + 1) left join pw on pw.ticker = {_BRAND}, light
        where date '1998-06-15' >= cast(o_orderdate as date) and (o_orderkey % 10 = 0 or date '1998-06-15' <= cast(o_orderdate as date) + 200))""",
    """s1 as (select *, case when k % 2 = 0 and (fc is null or fc = 'UNKNOWN') then 'AWAITING_EVENT' when k % 2 = 0 and fc = 'RED' then 'BLOCKED_FLAGS' when k % 7 = 0 and fc = 'RED' then 'BLOCKED_FLAGS'
        when k % 11 = 0 and lc = 'RED' then 'BLOCKED_FLAGS' when k % 13 = 0 and event_value is null then 'AWAITING_EVENT' when k % 13 = 0 and event_value <> 'true' then 'BLOCKED_FLAGS'
        when k % 6 = 0 and gp is null then 'AWAITING_EVENT' when k % 6 = 0 and gp >= 3000 then 'BLOCKED_FLAGS' when k % 8 = 0 and gw >= 4 then 'BLOCKED_FLAGS'
        when not ((k % 3 <> 0 and k % 4 <> 0 or coalesce((k % 3 <> 0 or gp >= 1000) and (k % 4 <> 0 or gp <= 4000), false)) and (k % 5 <> 0 or coalesce(gp2 <= 6000, false))) then 'PRICE_GUARD' else 'FIRES' end as status from cy)""",
    "out as (select k as rule_id, status, case when status in ('FIRES', 'PRICE_GUARD') then 2 else 0 end as n_orders, case when status in ('FIRES', 'PRICE_GUARD') then dollars + 100 else 0 end as dollars from s1)",
)
