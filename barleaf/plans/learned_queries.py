"""Learned rules, event rules on sparse columns, and term-structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barleaf.operators import evaluate as V
from barleaf.operators import events as E
from barleaf.operators import learned as L
from barleaf.operators import rules
from barleaf.operators import termstructure as TS
from barleaf.plans.basesql import PRICE, W, rank, rebalance, roll
from barleaf.plans.price_queries import features
from barleaf.plans.registry import add_query
from barleaf.plans.rule_queries import SPEC, weights_of
from barleaf.plans.rule_sql import SQL, book, top
from barleaf.sources import tables as T

LEARNED = {
    "random_forest_signal": lambda f: L.tree_signal(f, L.FOREST, True),
    "gradient_boosting_signal": lambda f: L.tree_signal(f, L.BOOSTED, False),
    "shap_signal": L.attribution_signal,
    "hrp": L.cluster_parity,
    "anomaly_detection": L.normal_names,
    "thompson_sampling_rl": L.bandit,
    "genetic_momentum": L.evolving,
}
for _name, _build in LEARNED.items():
    rules.RULES[_name] = rules.Rule(_name, _build, ("adj_close", "ret_1d", "mom_20d"))


def learned(name):
    return lambda s, d: rules.RULES[name].weights(features(s, d))


_ND = "nd as (select date, row_number() over (order by date) - 1 as i from (select distinct date from feat))"
SQL["hrp"] = [
    _ND, "rw as (select f.ticker, f.ret_1d, f.mom_20d, nd.i, a.i as a, a.date as adate from feat f join nd using (date) join nd a on a.i % 63 = 0 and nd.i between a.i - 252 and a.i)",
    "st as (select adate, a, ticker, sum(coalesce(ret_1d, 0)) filter (a - i < 252) as s1, sum(pow(coalesce(ret_1d, 0), 2)) filter (a - i < 252) as s2, coalesce(avg(mom_20d), 0) as mom from rw group by 1, 2, 3)",
    "vl as (select *, sqrt(greatest(coalesce(s2, 0) / least(a + 1, 252) - pow(coalesce(s1, 0) / least(a + 1, 252), 2), 0)) + 1e-8 as vol, count(*) over (partition by a) as n from st)",
    "lo as (select *, row_number() over (partition by a order by vol, ticker) <= n // 2 as low from vl where n >= 4 and least(a + 1, 252) >= 30)",
    "wt as (select *, 0.5 / vol / sum(1.0 / vol) over (partition by a, low) as w, row_number() over (partition by a order by mom desc, ticker desc) as m from lo)",
    "sig as (select adate as date, ticker, w / sum(w) over (partition by a) as weight from wt where m <= 20)", rebalance(63),
]
_SIX = "mom_20d vol_20d rsi_14 rel_vol_20 sma_gap_50 dd_from_high_60".split()
_U = "cast(cast('0x' || substr({h}, 1, 13) as bigint) as double) / 4503599627370496"


def _isolation_levels(levels: int) -> list[str]:
    """Trees grown level by level: the ranges of a node, then the step of every row."""
    out = [
        "it0 as materialized (select d.date, d.ticker, " + ", ".join(f"cast({c} as double) as x{j}" for j, c in enumerate(_SIX)) + ", tree, least(n, 256) as psi, cast(1 as bigint) as node, cast(null as double) as path, "
        f"row_number() over (partition by d.date, tree order by {_U.format(h=f"md5('42|' || d.date || '|' || tree || '|' || d.ticker)")}, d.ticker) <= 256 as inn from d0 d, range(0, 100) t(tree))",
    ]
    for depth in range(levels):
        w = "(partition by date, tree, node)"
        ranges = ", ".join(f"struct_pack(x := x{j}, lo := min(x{j}) filter (inn) over {w}, hi := max(x{j}) filter (inn) over {w})" for j in range(len(_SIX)))
        out.append(f"ir{depth} as (select *, list_filter([{ranges}], lambda r: r.hi > r.lo) as live, count(*) filter (inn) over {w} as size, md5('42|' || date || '|' || tree || '|' || node) as h from it{depth})")
        mean = "case when size <= 1 then 0 when size = 2 then 1 else 2 * (ln(greatest(size - 1, 1)) + 0.5772156649015329) - 2 * (size - 1) / cast(size as double) end"
        leaf = f"size <= 1 or {depth} >= ceil(log2(greatest(psi, 2)) - 1e-9) or len(live) = 0"
        out.append(f"ip{depth} as (select *, coalesce(path, case when {leaf} then {depth} + {mean} end) as path2, live[cast('0x' || substr(h, 14, 8) as bigint) % greatest(len(live), 1) + 1] as pk from ir{depth})")
        step = f"case when path2 is null then 2 * node + cast(pk.x > pk.lo + {_U.format(h='h')} * (pk.hi - pk.lo) as bigint) else node end"
        xs = ", ".join(f"x{j}" for j in range(len(_SIX)))
        out.append(f"it{depth + 1} as materialized (select date, ticker, {xs}, tree, psi, {step} as node, path2 as path, inn from ip{depth})")
    return out


SQL["anomaly_detection"] = [
    f"cr as (select date, ticker, {', '.join(_SIX)} from feat where {' and '.join(c + ' is not null' for c in _SIX)})",
    "k0 as (select date from (select date, row_number() over (order by date) - 1 as i from (select distinct date from cr)) where i % 21 = 0)",
    "d0 as materialized (select * from (select cr.*, count(*) over (partition by date) as n from cr semi join k0 on k0.date = cr.date) where n >= 10)",
    *_isolation_levels(9),
    "ie as (select date, ticker, avg(path) as e, any_value(psi) as size from it9 group by 1, 2)",
    "isc as (select date, ticker, round(-pow(2.0, -e / greatest(case when size <= 1 then 0 when size = 2 then 1 else 2 * (ln(size - 1) + 0.5772156649015329) - 2 * (size - 1) / cast(size as double) end, 1e-12)), 10) as score from ie)",
    "nm as (select d0.* from d0 join (select *, quantile_cont(score, 0.1) over (partition by date) as lim from isc) s using (date, ticker) where score >= lim - 1e-9)",
    "tp as (select * from (select *, row_number() over (partition by date order by mom_20d desc, ticker) as r from nm) where r <= 8)",
    "sig as (select date, ticker, cast(1 as double) / count(*) over (partition by date) as weight from tp)", rebalance(21),
]
_QUINT = "least(floor(cast(row_number() over (partition by date order by mom_20d nulls last, ticker) - 1 as double) / n * 5), 4)"
SQL["thompson_sampling_rl"] = [
    _ND, "dy0 as (select date, ticker, mom_20d, i, count(*) over (partition by date) as n from feat join nd using (date) where mom_20d is not null)",
    f"dy as (select *, {_QUINT} as bucket from dy0 where i % 5 = 0 and n >= 10)",
    "pd0 as (select date, ticker, mom_20d, ret_1d, i, count(*) over (partition by date) as n from feat join nd using (date) where ret_1d is not null)",
    f"pd as (select *, case when mom_20d is not null then {_QUINT} end as bucket from pd0 where (i + 1) % 5 = 0)",
    "sg as (select i + 1 as i, bucket, cast(avg(ret_1d) > 0 as int) as won from pd where bucket is not null group by 1, 2)",
    "aq as (select i, b as bucket from (select distinct i from dy), range(0, 5) r(b))",
    "st0 as (select a.i, a.bucket, count(*) filter (s.won = 1) as wins, count(s.won) as seen from aq a left join sg s on s.bucket = a.bucket and s.i < a.i and s.i in (select i from aq) group by 1, 2)",
    f"stt as (select *, list_sort(list_transform(range(1, seen + 2), lambda j: {_U.format(h="md5('42|' || i || '|' || bucket || '|' || j)")}))[wins + 1] as m from st0)",
    "bs as (select i, bucket from (select *, row_number() over (partition by i order by m desc, bucket) as r from stt) where r = 1)",
    "tp as (select * from (select dy.*, row_number() over (partition by date order by mom_20d desc, ticker) as r from dy join bs using (i, bucket)) where r <= 8)",
    "sig as (select date, ticker, cast(1 as double) / count(*) over (partition by date) as weight from tp)", rebalance(5),
]
_LONG = " union all ".join(f"select i, date, ticker, ret_1d, {j} as c, {m} as v from feat join nd using (date) where {m} is not null" for j, m in enumerate(L.MOMENTA))
SQL["genetic_momentum"] = [
    _ND, f"lg as ({_LONG})", "ld as (select * from (select *, row_number() over (partition by date, c order by v desc, ticker) as r from lg where ret_1d is not null) where r <= 8)",
    "an as (select date, i as a, (i - 63) // 21 as g from nd where i >= 63 and (i - 63) % 21 = 0)",
    "sm as (select g, c, avg(ret_1d) / stddev_samp(ret_1d) as x from an join ld on ld.i >= a - 63 and ld.i < a group by 1, 2)",
    "gc as (select g, c, x, row_number() over (partition by c order by g) as t from sm)",
    "sc as (select an.g, cc.c, coalesce(sum(0.1 * x * pow(cast(0.9 as double), k.m - gc.t)), 0) as s from an cross join range(0, 5) cc(c) left join (select an.g, gc.c, count(*) as m from an join gc on gc.g < an.g group by 1, 2) k on k.g = an.g and k.c = cc.c left join gc on gc.c = cc.c and gc.g < an.g group by 1, 2)",
    "bs as (select g, c from (select *, row_number() over (partition by g order by round(s, 12) desc, c) as r from sc) where r = 1)",
    "tp as (select * from (select lg.date, lg.ticker, row_number() over (partition by lg.date order by v desc, lg.ticker) as r from lg join an on an.date = lg.date join bs on bs.g = an.g and bs.c = lg.c) where r <= 8)",
    "sig as (select date, ticker, cast(1 as double) / count(*) over (partition by date) as weight from tp)", rebalance(21),
]
for _name in LEARNED:
    if _name in SQL:
        add_query(f"rule_{_name}", SPEC, learned(_name), PRICE, *SQL[_name])
    else:
        add_query(f"rule_{_name}", SPEC, learned(_name))

# -- rules that need sparse or rescaled columns -------------------------------


def with_events(s, d):
    """Features with event columns taken from each brand's own returned lines."""
    tone = T.tone_series(s, d).select("ticker", "date", (F.col("gdelt_tone") * 10).alias("event_sentiment_mean"), (F.col("gdelt_vol") / 3.0).alias("event_novelty_max"))
    return features(s, d).join(tone, ["ticker", "date"], "left")


TONE = "tone as (select p_brand as ticker, cast(l_shipdate as date) as date, avg(l_discount - l_tax) * 10 as event_sentiment_mean, count(*) / 3.0 as event_novelty_max from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1, 2)"
FE = "fe as (select feat.*, event_sentiment_mean, event_novelty_max from feat left join tone using (ticker, date))"


def held(entry, days, weight):
    return [f"ent as (select date, ticker, cast({entry} as int) as e from fe)", f"out as (select date, ticker, cast(max(e) over ({W} rows between {days - 1} preceding and current row) as double) * {weight} as weight from ent)"]


def on_events(name):
    return lambda s, d: rules.RULES[name].weights(with_events(s, d))


add_query("rule_event_driven", SPEC, on_events("event_driven"), PRICE, TONE, FE, *held("event_sentiment_mean > 0.3 and event_novelty_max > 0.5", 3, 0.05))
add_query("rule_event_momentum_with_events", SPEC, on_events("event_momentum_confluence"), PRICE, TONE, FE, *held("event_sentiment_mean > 0.2 and mom_20d > 0.02", 5, 0.09))
add_query("rule_news_sentiment_with_events", SPEC, on_events("news_sentiment"), PRICE, TONE, FE,
          "rows0 as (select date, ticker, event_sentiment_mean * (1 + coalesce(mom_20d, 0)) as s from fe where event_sentiment_mean is not null)", book(top("s", 8), "rows0"), rebalance(5))


def scaled(s, d):
    """Volatility and turnover brought to the size the thresholds assume."""
    return features(s, d).withColumn("vol_20d", F.col("vol_20d") / 70).withColumn("avg_dollar_volume_20", F.col("avg_dollar_volume_20") * 30)


SCALED = "sc as (select * exclude (vol_20d, avg_dollar_volume_20), vol_20d / 70 as vol_20d, avg_dollar_volume_20 * 30 as avg_dollar_volume_20 from feat)"
for _name in ("mom_vol_filter", "size_factor", "liquidity_weighted_momentum"):
    add_query(f"rule_{_name}_scaled", SPEC, (lambda n: lambda s, d: rules.RULES[n].weights(scaled(s, d)))(_name), PRICE, SCALED, *[p.replace("from feat where", "from sc where").replace("from feat)", "from sc)") for p in SQL[_name]])


def with_curve(s, d):
    macro = E.macro_features(T.macro_series(s, d), {"level": "lvl", "peak": "pk"}).select("date", F.col("lvl_chg_20d").alias("macro_yield_curve"))
    return features(s, d).join(macro, "date", "left")


add_query(
    "rule_yield_curve_with_curve", SPEC, lambda s, d: rules.RULES["yield_curve_adaptive"].weights(with_curve(s, d)), PRICE,
    "mc as (select date, l - lag(l, 20) over (order by date) as cv from (select cast(o_orderdate as date) as date, avg(o_totalprice) as l from orders group by 1))",
    "fc as (select feat.*, cv from feat left join mc using (date))",
    f"a as (select date, ticker, {top('mom_20d', 6)} as weight from fc where cv >= 0 and mom_20d is not null)", f"b as (select date, ticker, {top('vol_20d', 6, True)} as weight from fc where cv < 0 and vol_20d is not null)",
    "sig as (select * from a union all select * from b)", rebalance(21),
)

# -- side by side and term structures -----------------------------------------

_THREE = ["momentum_rotation", "min_vol_portfolio", "fractal_momentum"]


def compared(s, d):
    out = V.compare_rules(T.panel(s, d), {n: weights_of(n)(s, d) for n in _THREE})
    return out.selectExpr("rule", "n", "ln(1 + cagr) as log_cagr", "sharpe", "max_drawdown", "annual_vol")


add_query("evaluate_compare_rules", "rule n:i log_cagr:6 sharpe:6 max_drawdown:8 annual_vol:5", compared)


def benchmark_curve(s, d):
    b = V.benchmark_returns(T.panel(s, d), T.BENCHMARK).select("date", F.col("ret").alias("net_ret"))
    return V.drawdowns(V.with_equity(b))


add_query("evaluate_benchmark_curve", "date:d log_growth:6 drawdown:8", benchmark_curve, PRICE,
          f"b as (select date, sum(ln(1 + ret_1d)) over (order by date) as log_growth from feat where ticker = '{T.BENCHMARK}' and ret_1d is not null)",
          "out as (select *, exp(log_growth - max(log_growth) over (order by date)) - 1 as drawdown from b)")


def quotes(s, d):
    """Lines as option quotes: part as underlying, quantity as days to expiry."""
    return T.table(s, d, "lineitem").selectExpr("l_suppkey as chain", "cast(l_quantity as int) as days", "l_linenumber % 2 as leg", "l_extendedprice as strike", "l_discount * 10 as iv")


def term(s, d):
    return TS.term_structure(quotes(s, d), F.lit(50000.0))


QUOTES = """
q as (select l_suppkey as chain, cast(l_quantity as int) as days, l_linenumber % 2 as leg, l_extendedprice as strike, l_discount * 10 as iv from lineitem),
near as (select *, row_number() over (partition by chain, days, leg order by abs(strike - 50000), strike, iv) as r from q where iv is not null),
term as (select chain, days, median(iv) as iv from near where r <= 5 and iv > 0.01 and iv < 5 group by 1, 2)"""
add_query("term_atm_volatility", "chain:i days:i iv:9", term, QUOTES, relation="term")
add_query(
    "term_interpolated", "chain:i horizon:i iv:9", lambda s, d: TS.at_horizons(term(s, d), [7, 21, 33, 90]), QUOTES, "hz as (select unnest([7, 21, 33, 90]) as horizon)",
    "sd as (select chain, horizon, max(days) filter (days <= horizon) as lo, min(days) filter (days >= horizon) as hi, arg_max(iv, days) filter (days <= horizon) as ilo, arg_min(iv, days) filter (days >= horizon) as ihi from term, hz group by 1, 2)",
    "out as (select chain, horizon, case when lo is null then ihi when hi is null then ilo when lo = hi then ilo else ilo + (ihi - ilo) * (horizon - lo) / cast(hi - lo as double) end as iv from sd)",
)
add_query("term_trading_days", "o_orderkey:i due:d", lambda s, d: T.table(s, d, "orders").select("o_orderkey", TS.add_trading_days(F.to_date("o_orderdate"), 21).alias("due")),
          "out as (select o_orderkey, (select max(x) from (select x from (select cast(o_orderdate as date) + cast(k as int) as x from range(1, 40) r(k)) where isodow(x) < 6 order by x limit 21)) as due from orders)")
