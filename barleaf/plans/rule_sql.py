"""DuckDB text of the rule library, one entry per rule name."""

from __future__ import annotations

from barleaf.plans.basesql import AVG, BENCH, MAX, MIN, SD, SUM, VAR, W, carry, lag, rank, rebalance, roll

SQL: dict[str, list[str]] = {}
D = "cast({} as double)"


def present(cols: str) -> str:
    return " and ".join(f"{c} is not null" for c in cols.split())


def book(weight: str, source: str = "feat", where: str = "true") -> str:
    return f"sig as (select date, ticker, cast({weight} as double) as weight from {source} where {where})"


def final() -> str:
    return "out as (select * from sig)"


def top(score: str, k: int, ascending: bool = False) -> str:
    return f"case when {rank(score, ascending)} <= {k} then cast(1 as double) / {k} else 0 end"


def pick(name, needs, k, every, score=None, where="true", ascending=False, source="feat", prep=()):
    score = score or needs.split()[0]
    need = present(needs) if needs else "true"
    SQL[name] = [
        *prep,
        f"rows0 as (select date, ticker, {score} as s from {source} where {need} and ({where}))",
        book(top("s", k, ascending), "rows0"),
        rebalance(every),
    ]


def hold(name, entry, days, weight, source="feat", prep=()):
    SQL[name] = [
        *prep,
        f"ent as (select date, ticker, cast({entry} as int) as e from {source})",
        f"out as (select date, ticker, cast(max(e) over ({W} rows between {days - 1} preceding and current row) as double) * {weight} as weight from ent)",
    ]


def latch(name, enter, leave, weight, source="feat", prep=()):
    SQL[name] = [
        *prep,
        f"ent as (select date, ticker, case when {enter} then 1.0 when {leave} then 0.0 end as e from {source})",
        f"out as (select date, ticker, cast(coalesce({carry('e')}, 0) as double) * {weight} as weight from ent)",
    ]


SQL["buy_and_hold"] = [f"out as (select distinct date, '{BENCH}' as ticker, 1.0 as weight from feat)"]
SQL["ma_crossover"] = [
    f"b as (select *, {roll(AVG, 'adj_close', 50)} as f, {roll(AVG, 'adj_close', 200)} as s from panel where ticker = '{BENCH}')",
    "out as (select date, ticker, case when f > s then 1.0 else 0.0 end as weight from b)",
]
pick("momentum_rotation", "mom_120d", 4, 21)
pick("ml_ranker", "mom_20d", 4, 5)
SQL["dual_momentum_absolute"] = [
    book(f"case when {rank('mom_12m1m')} <= 5 and mom_12m1m > 0 then 0.2 else 0 end", where="mom_12m1m is not null"),
    rebalance(21),
]
pick("triple_ma", "mom_20d", 8, 5, where="sma_gap_10 > 0 and sma_gap_50 > 0 and sma_gap_200 > 0")
pick("mom_vol_filter", "mom_120d vol_20d", 6, 21, where="vol_20d < 0.35")
pick("adaptive_trend_regime", "mom_20d", 5, 10, where="bull_regime = 1")
pick("roc_momentum", "mom_60d", 6, 21)
pick("weekly_mom_rotation", "mom_5d", 10, 5)
SQL["time_series_momentum"] = [
    book(f"case when {rank('abs(mom_120d)')} <= 15 and mom_120d > 0 then 0.067 else 0 end", where="mom_120d is not null"),
    final(),
]
pick("min_vol_portfolio", "vol_20d", 10, 21, ascending=True)
pick("vix_contrarian", "mom_20d", 8, 5, where="high_vol_regime = 0")
pick("high_vol_cash", "mom_20d", 8, 5, where="high_vol_regime = 0")
pick("trend_strength_filter", "mom_20d", 8, 5, where="sma_gap_50 > 0 and sma_gap_200 > 0 and mom_20d > 0")
pick("sector_rotation_proxy", "mom_60d", 5, 21)
pick("contra_momentum_high_vol", "mom_20d", 6, 5, where="high_vol_regime = 1", ascending=True)
pick("momentum_anomaly_filter", "mom_12m1m mom_20d", 8, 21, score="mom_12m1m - mom_20d / 2")
pick("acceleration_momentum", "mom_5d mom_20d", 8, 5, score="mom_5d - mom_20d / 4")
pick("fractal_momentum", "mom_5d mom_20d mom_60d", 6, 10, score="mom_5d + mom_20d + mom_60d", where="least(mom_5d, mom_20d, mom_60d) > 0")
pick("vol_normalised_momentum", "mom_60d vol_20d", 8, 21, score="mom_60d / greatest(vol_20d, 0.05)")
pick("short_term_reversal", "mom_20d", 10, 21, ascending=True)
pick("value_factor", "sma_gap_200", 10, 21, ascending=True)
pick("size_factor", "avg_dollar_volume_20", 20, 21, where="avg_dollar_volume_20 >= 1000000", ascending=True)
pick("investment_factor", "vol_60d mom_60d", 10, 21, where="mom_60d > 0", ascending=True)
pick("index_rebalance_arb", "mom_120d", 5, 63)
pick("vol_arbitrage", "vol_20d mom_20d sma_gap_50", 8, 10, where="mom_20d > 0 and sma_gap_50 > 0", ascending=True)
pick("calendar_spread_momentum", "mom_20d mom_120d", 8, 10, score="mom_20d - mom_120d", where="mom_20d > 0")
pick("analyst_revision_proxy", "mom_20d mom_60d", 8, 21, score="mom_20d - mom_60d", where="mom_20d > 0 and mom_60d > 0")


def sign(c):
    return f"(case when {c} > 0 then cast(1 as double) else -1 end)"


_agree = "(" + " + ".join(sign(f"mom_{n}d") for n in (5, 10, 20, 60)) + ") / 4"
_size = "(abs(mom_5d) + abs(mom_10d) + abs(mom_20d) + abs(mom_60d)) / 4"
pick("adx_trend", "mom_5d mom_10d mom_20d mom_60d", 8, 5, score=f"abs({_agree}) * ({_size})", where=f"{_agree} > 0")
pick("managed_futures_cta", "mom_10d", 10, 5, score=sign("mom_10d"), where="mom_10d > 0")

hold("mean_reversion", "ret_1d < -0.03 and bull_regime = 1", 5, 0.10)
hold("breakout_20d_high", "breakout_20 >= -0.005 and rel_vol_20 > 1.5", 10, 0.10)
hold("sma_stretch_reversion", "sma_gap_10 < -0.05", 5, 0.07)
hold("drawdown_bounce", "dd_from_high_60 < -0.15 and bull_regime = 1", 10, 0.07)
hold("low_rsi_mom_combo", "rsi_14 < 35 and mom_20d > 0", 7, 0.08)
hold("vol_breakout", "rel_vol_20 > 2 and ret_1d > 0", 3, 0.07)
hold("momentum_volume_surge", "mom_20d > 0.05 and rel_vol_20 > 1.3", 10, 0.08)
hold("event_momentum_confluence", "rel_vol_20 > 1.5 and mom_20d > 0.02", 5, 0.09)
hold("bollinger_reversion", "adj_close <= sma_20 - 2 * sd20", 5, 0.08)
hold("bb_breakout", "adj_close > sma_20 + 2 * sd20", 5, 0.08)
_gap = f"g as (select *, open / {lag('adj_close')} - 1 as gap from feat)"
_gap_known = "g2 as (select * from g where gap is not null)"
hold("overnight_gap_fill", "gap < -0.02", 3, 0.06, "g", [_gap])
hold("orb_proxy", "gap > 0.005 and rel_vol_20 > 1.5", 3, 0.07, "g2", [_gap, _gap_known])
hold("gap_fill", "abs(gap) > 0.015", 2, 0.06, "g2", [_gap, _gap_known])
hold(
    "vwap_reversion", "adj_close / (pv / (vv + 1)) - 1 < -0.02", 3, 0.07, "v",
    [
        "v0 as (select *, (open + high + low + adj_close) / 4 * volume as pv0 from feat)",
        f"v as (select *, {roll(SUM, 'pv0', 5)} as pv, {roll(SUM, 'volume', 5)} as vv from v0)",
    ],
)
hold(
    "variance_ratio_pairs", "v2 / (2 * v1 + 1e-9) < 0.9 and ret_1d < -0.01", 5, 0.07, "v",
    [
        f"v0 as (select *, adj_close / {lag('adj_close', 2)} - 1 as ret2 from feat)",
        f"v as (select *, {roll(VAR, 'ret_1d', 20)} as v1, {roll(VAR, 'ret2', 20)} as v2 from v0)",
    ],
)
hold(
    "hf_mean_reversion", "ret_1d < -0.04 and coalesce(m > 0, false)", 2, 0.06, "v",
    ["v as (select *, avg(mom_5d) over (partition by date) as m from feat)"],
)
hold(
    "cross_sectional_reversal", "rk <= 8", 5, 0.10, "v",
    [
        f"v0 as (select date, ticker, {lag('ret_1d')} as p from feat where ret_1d is not null)",
        f"v as (select *, {rank('p', True)} as rk from v0 where p is not null)",
    ],
)
latch("rsi_oversold_bounce", "rsi_14 < 30", "rsi_14 > 50", 0.08)
latch(
    "turtle_donchian", "close >= hi", "close <= lo", 0.08, "v",
    [f"v as (select *, {roll(MAX, 'high', 20)} as hi, {roll(MIN, 'low', 10)} as lo from feat)"],
)
latch("zscore_reversion", "(adj_close - sma_20) / (sd20 + 1e-8) < -2", "(adj_close - sma_20) / (sd20 + 1e-8) > 0", 0.08)
latch(
    "stochastic_reversion", "pk < 20", "pk > 80", 0.07, "v2",
    [
        f"v as (select *, {roll(MIN, 'low', 14)} as lo, {roll(MAX, 'high', 14)} as hi from feat)",
        "v2 as (select *, (adj_close - lo) / (hi - lo + 1e-8) * 100 as pk from v)",
    ],
)
latch(
    "cci_reversion", "cci < -100", "cci > 100", 0.07, "v3",
    [
        "v as (select *, (high + low + adj_close) / 3 as tp from feat)",
        f"v2 as (select *, {roll(AVG, 'tp', 20)} as tm, {roll(SD, 'tp', 20)} as ts from v)",
        "v3 as (select *, (tp - tm) / (cast(0.015 as double) * ts + 1e-8) as cci from v2)",
    ],
)
latch(
    "etf_mean_reversion", "z < -1.5", "z > 0.5", 0.10, "v",
    ["v as (select *, (mom_20d - avg(mom_20d) over (partition by date)) / (stddev_samp(mom_20d) over (partition by date) + 1e-8) as z from feat)"],
)


def sized(name, needs, k, every, weight, prep_score="mom_20d"):
    SQL[name] = [
        f"r0 as (select date, ticker, {', '.join(needs.split())}, {rank(prep_score)} as rk from feat where {present(needs)})",
        f"r1 as (select *, {weight} as raw from r0 where rk <= {k})",
    ]


def inverse(name, needs, k, every, value, floor, cap):
    sized(name, needs, k, every, f"1.0 / greatest({value}, {floor})")
    SQL[name] += [book(f"least(raw / sum(raw) over (partition by date), {cap})", "r1"), rebalance(every)]


inverse("risk_parity_vol_target", "vol_20d mom_20d", 20, 21, "vol_20d", 0.05, 0.15)
inverse("atr_position_sizing", "mom_20d atr_14 adj_close", 10, 10, "atr_14 / adj_close", 0.005, 0.15)
inverse("equal_risk_contribution", "vol_60d mom_20d", 15, 21, "vol_60d", 0.05, 0.15)
sized("mkt_cap_weighted_mom", "mom_20d avg_dollar_volume_20", 10, 21, "avg_dollar_volume_20")
SQL["mkt_cap_weighted_mom"] += [book("least(raw / sum(raw) over (partition by date), 0.20)", "r1"), rebalance(21)]
SQL["vol_targeting"] = [
    f"r0 as (select date, ticker, vol_20d, {rank('mom_20d')} <= 10 as chosen from feat where mom_20d is not null and vol_20d is not null)",
    "r1 as (select *, avg(vol_20d) filter (chosen) over (partition by date) as m from r0)",
    book("case when chosen then least(0.1 * least(greatest(cast(0.15 as double) / (m + 1e-8), 0.5), 2.0), 0.2) else 0 end", "r1"),
    rebalance(5),
]


def blend(name, needs, ranks, combine, k, every, after="true"):
    made = ", ".join(f"{rank(c, up)} as r_{c}" for c, up in ranks.items())
    SQL[name] = [
        f"r0 as (select *, {made} from feat where {present(needs)})",
        f"rows0 as (select date, ticker, {combine} as s from r0 where {after})",
        book(top("s", k, True), "rows0"),
        rebalance(every),
    ]


blend("mom_quality_combo", "mom_20d avg_dollar_volume_20", dict(mom_20d=False, avg_dollar_volume_20=False), "r_mom_20d + r_avg_dollar_volume_20", 8, 10)
blend("momentum_value_mix", "mom_120d sma_gap_200", dict(mom_120d=False, sma_gap_200=True), "cast(0.6 as double) * r_mom_120d + cast(0.4 as double) * r_sma_gap_200", 8, 21)
blend("quality_factor", "vol_20d avg_dollar_volume_20 sma_gap_50", dict(vol_20d=True, avg_dollar_volume_20=False), "r_vol_20d + r_avg_dollar_volume_20", 10, 21, "sma_gap_50 > 0")
blend("quality_minus_junk", "vol_20d avg_dollar_volume_20 mom_20d", dict(vol_20d=True, avg_dollar_volume_20=False, mom_20d=False), "r_vol_20d + r_avg_dollar_volume_20 + r_mom_20d", 10, 21)
blend(
    "multi_factor_5", "mom_20d sma_gap_200 vol_20d avg_dollar_volume_20",
    dict(mom_20d=False, sma_gap_200=True, vol_20d=True, avg_dollar_volume_20=False),
    "r_mom_20d + r_sma_gap_200 + r_vol_20d + r_avg_dollar_volume_20", 10, 21,
)
SQL["low_vol_momentum"] = [
    f"r0 as (select date, ticker, mom_20d as s, {rank('vol_20d', True)} as rv, count(*) over (partition by date) as n from feat where mom_20d is not null and vol_20d is not null)",
    "rows0 as (select * from r0 where rv <= floor(n * cast(0.4 as double)))",
    book(top("s", 8), "rows0"),
    rebalance(21),
]
SQL["trend_plus_reversion"] = [
    f"t as (select date, ticker, case when {rank('mom_20d')} <= 5 then cast(0.1 as double) else 0 end as wt from feat where mom_20d is not null)",
    f"r as (select date, ticker, case when {rank('rsi_14', True)} <= 5 and rsi_14 < 35 then cast(0.1 as double) else 0 end as wr from feat where rsi_14 is not null)",
    "sig as (select t.date, t.ticker, wt + coalesce(wr, 0) as weight from t left join r using (date, ticker))",
    rebalance(10),
]
SQL["multi_hold_blend"] = [
    "sig as (select date, ticker, ("
    + " + ".join(f"(case when {rank(c)} <= 5 then cast(0.2 as double) else 0 end)" for c in ("mom_5d", "mom_20d", "mom_60d"))
    + ") / 3 as weight from feat)",
    rebalance(5),
]


def z(c):
    return f"(({c} - avg({c}) over (partition by date)) / (stddev_samp({c}) over (partition by date) + 1e-8))"


def scored(name, needs, score, k, every, where="true", source="feat", prep=()):
    SQL[name] = [
        *prep,
        f"rows0 as (select date, ticker, {score} as s from {source} where {present(needs)} and ({where}))",
        book(top("s", k), "rows0"),
        rebalance(every),
    ]


scored("cross_sectional_rankz", "mom_20d mom_60d vol_20d rsi_14", f"{z('mom_20d')} + {z('mom_60d')} - {z('vol_20d')} - {z('rsi_14')}", 8, 10)
scored(
    "adaptive_regime_blend", "mom_20d rsi_14 high_vol_regime",
    f"(case when high_vol_regime = 1 then cast(0.3 as double) else 0.7 end) * {z('mom_20d')} - (case when high_vol_regime = 1 then cast(0.7 as double) else 0.3 end) * {z('rsi_14')}", 6, 5,
)
scored(
    "liquidity_weighted_momentum", "mom_20d avg_dollar_volume_20", f"{z('mom_20d')} / 2 + {z('liq')} / 2", 8, 10, "avg_dollar_volume_20 > 5000000", "l",
    ["l as (select *, ln(avg_dollar_volume_20) as liq from feat)"],
)


def regimes(name, on, off, k_on, col_on, k_off, col_off, every):
    SQL[name] = [
        f"a as (select date, ticker, {top(col_on, k_on)} as weight from feat where ({on}) and {col_on} is not null)",
        f"b as (select date, ticker, {top(col_off, k_off, True)} as weight from feat where ({off}) and {col_off} is not null)",
        "sig as (select * from a union all select * from b)",
        rebalance(every),
    ]


regimes("regime_switching_momentum", "bull_regime = 1", "bull_regime = 0", 6, "mom_20d", 5, "vol_20d", 10)
regimes(
    "global_macro_trend", "bull_regime = 1 and high_vol_regime = 0", "not (bull_regime = 1 and high_vol_regime = 0)",
    8, "mom_60d", 5, "vol_20d", 21,
)
pick("yield_curve_adaptive", "mom_20d", 6, 21)
for _name in ("market_neutral_momentum", "long_short_equity"):
    SQL[_name] = [
        f"r0 as (select date, ticker, {rank('mom_20d')} as rk, count(*) over (partition by date) as n from feat where mom_20d is not null)",
        book("case when rk <= 8 then 0.125 when rk > n - 8 then -0.125 else 0 end", "r0"),
        rebalance(10),
    ]
_near = f"v as (select *, adj_close / {roll(MAX, 'adj_close', 252, 100)} - 1 as near from feat)"
pick("52wk_high_momentum", "near", 8, 21, where="near >= -0.05", source="v", prep=[_near])
pick("merger_arb_proxy", "near", 5, 21, where="near >= -0.15 and near <= 0", source="v", prep=[_near])
_rs = f"v as (select *, {roll(SUM, 'excess_ret_1d', 63, 20)} as rs, {roll(AVG, 'excess_ret_1d', 63, 20)} as ra from feat)"
pick("profitability_factor", "rs", 10, 21, where="mom_20d > 0", source="v", prep=[_rs])
pick("relative_strength_rotation", "rs", 8, 21, source="v", prep=[_rs])
pick("carry_factor", "ra", 10, 21, source="v", prep=[_rs])
pick(
    "relative_momentum_spread", "cum", 8, 5, source="v",
    prep=[f"v as (select date, ticker, sum(excess_ret_1d) over ({W}) as cum from feat where excess_ret_1d is not null)"],
)


def mid(n):
    return f"(({roll(MAX, 'high', n)}) + ({roll(MIN, 'low', n)})) / 2"


pick(
    "ichimoku_proxy", "", 8, 5, score="te / ki - 1", where="te > ki and adj_close > greatest(te, ki)", source="v",
    prep=[f"v as (select *, {mid(9)} as te, {mid(26)} as ki from feat)"],
)
_mom0 = "coalesce(mom_20d, 0)"
pick(
    "parabolic_sar_proxy", "", 8, 5, score=_mom0, where="adj_close > lvl", source="v2",
    prep=[f"v as (select *, {roll(MAX, 'high', 5)} as hi from feat)", f"v2 as (select *, {lag('hi')} * cast(0.98 as double) as lvl from v)"],
)
pick(
    "heikin_ashi_trend", "", 8, 5, score=_mom0, where="streak >= 3", source="v2",
    prep=[
        f"v as (select *, cast((open + high + low + close) / 4 > ({lag('open')} + {lag('close')}) / 2 as int) as hb from feat)",
        f"v2 as (select *, {roll(SUM, 'hb', 3)} as streak from v)",
    ],
)
pick(
    "earnings_momentum", "", 6, 5, score=_mom0, where="seen = 1", source="v",
    prep=[f"v0 as (select *, cast(rel_vol_20 > 2.5 and ret_1d > 0.02 as int) as e from feat)",
          f"v as (select *, max(e) over ({W} rows between 14 preceding and current row) as seen from v0)"],
)
pick(
    "pead", "", 6, 5, score=_mom0, where="seen = 1 and up = 1", source="v",
    prep=["v0 as (select *, cast(rel_vol_20 > 3 and abs(ret_1d) > 0.03 as int) as e from feat)",
          "v1 as (select *, case when e = 1 then cast(ret_1d > 0 as int) end as p from v0)",
          f"v as (select *, max(e) over ({W} rows between 19 preceding and current row) as seen, coalesce({carry('p')}, 0) as up from v1)"],
)
pick(
    "dispersion_trading", "", 8, 10, score=_mom0, where="vol_20d > m", source="v",
    prep=["v as (select *, avg(vol_20d) over (partition by date) as m from feat where high_vol_regime = 0)"],
)


def vote(c):
    return f"(case when {c} then cast(1 as double) else 0 end)"


pick(
    "ensemble_voting", "", 8, 5,
    score="(" + " + ".join(map(vote, ["mom_20d > 0", "sma_gap_50 > 0", "rsi_14 > 40 and rsi_14 < 70", "vol_20d < 0.30", "mom_60d > 0"])) + ") / 5",
)
pick("news_sentiment", "", 8, 5, score=f"case when rel_vol_20 > 2 and ret_1d > 0.01 then {_mom0} when not (rel_vol_20 > 2 and ret_1d > 0.01) then 0 end")


def ewm(out: str, x: str, decay: float, source: str) -> str:
    """Weighted mean of all rows so far, weights decay**age, by a pair join."""
    return f"""
{out}_n as (select *, row_number() over ({W}) as rn from {source}),
{out}_e as (select a.ticker, a.date, sum(b.{x} * pow(cast({decay!r} as double), a.rn - b.rn)) / sum(pow(cast({decay!r} as double), a.rn - b.rn)) as {out}
  from {out}_n a join {out}_n b on a.ticker = b.ticker and b.rn <= a.rn where b.{x} is not null group by a.ticker, a.date),
{out}_t as (select s.*, e.{out} from {source} s left join {out}_e e using (ticker, date))"""


def span(n):
    return 1 - 2 / (n + 1)


SQL["trend_ema_cross"] = [
    ewm("fast", "adj_close", span(21), "panel"), ewm("slow", "adj_close", span(63), "fast_t"),
    book("case when fast > slow then 0.1 else 0 end", "slow_t"), rebalance(5),
]
SQL["macd_crossover"] = [
    ewm("fast", "adj_close", span(12), "panel"), ewm("slow", "adj_close", span(26), "fast_t"),
    "m as (select *, fast - slow as macd from slow_t)", ewm("line", "macd", span(9), "m"),
    book("case when macd > line and macd > 0 then 0.125 else 0 end", "line_t"), rebalance(5),
]
_feat_cut = "cutf as (select date, ticker, adj_close, atr_14, mom_20d from feat)"
hold("keltner_breakout", "adj_close > mid + 2 * atr_14", 5, 0.08, "mid_t", [_feat_cut, ewm("mid", "adj_close", span(20), "cutf")])
SQL["supertrend"] = [
    _feat_cut, ewm("mid", "adj_close", span(10), "cutf"),
    "u as (select *, cast(adj_close > mid - 3 * atr_14 as int) as up from mid_t)",
    "rows0 as (select *, case when up = 1 then coalesce(mom_20d, 0) when up = 0 then 0 end as s from u)",
    book(f"case when {rank('s')} <= 10 and up = 1 then 0.1 else 0 end", "rows0"), rebalance(5),
]
