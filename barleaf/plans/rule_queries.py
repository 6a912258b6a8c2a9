"""Rule queries: target weights over the written feature table."""

from __future__ import annotations

from barleaf.operators import evaluate, rules
from barleaf.plans.basesql import PRICE
from barleaf.plans.price_queries import features
from barleaf.plans.registry import add_query
from barleaf.plans.rule_sql import SQL
from barleaf.sources.tables import BENCHMARK, panel

SPEC = "date:d ticker weight:9"


def weights_of(name: str):
    """Weights of a rule from (spark, folder)."""

    def build(spark, folder):
        f = features(spark, folder)
        if name == "buy_and_hold":
            return rules.buy_and_hold(BENCHMARK).weights(f)
        if name == "ma_crossover":
            return rules.ma_crossover(BENCHMARK).weights(f)
        if name == "ml_ranker":
            scores = f.filter("mom_20d is not null").selectExpr("date", "ticker", "mom_20d as score")
            return rules.ml_ranker(scores).weights(f)
        return rules.RULES[name].weights(f)

    return build


for _name in ("buy_and_hold", "ma_crossover", "ml_ranker", *rules.RULES):
    if _name in SQL:
        add_query(f"rule_{_name}", SPEC, weights_of(_name), PRICE, *SQL[_name])


def daily(name: str, **options):
    return lambda s, d: evaluate.daily_results(panel(s, d), weights_of(name)(s, d), **options)


def daily_sql(delay: int = 1, weights: str = "out") -> str:
    """From weights to daily(date, gross_ret, turnover, cost, net_ret) on a dense grid."""
    return f"""
rets as (select * from (select date, ticker, adj_close / lag(adj_close) over (partition by ticker order by date) - 1 as ret from panel) where ret is not null),
days as (select date, row_number() over (order by date) - 1 as i from (select date from rets intersect select date from {weights})),
names as (select ticker from rets intersect select ticker from {weights}),
g0 as (select d.i, d.date, n.ticker, coalesce(w.weight, 0) as w, coalesce(r.ret, 0) as ret from days d cross join names n
       left join {weights} w on w.date = d.date and w.ticker = n.ticker left join rets r on r.date = d.date and r.ticker = n.ticker),
g1 as (select *, greatest(least(w, 0.2), -0.2) as c from g0),
g2 as (select *, sum(abs(c)) over (partition by i) as gross from g1),
g3 as (select *, case when gross > 1 then c / gross else c end as cw from g2),
g4 as (select *, coalesce(lag(cw, {delay}) over (partition by ticker order by i), 0) as used from g3),
g5 as (select *, used - coalesce(lag(used) over (partition by ticker order by i), 0) as moved from g4),
daily as (select date, sum(used * ret) as gross_ret, sum(abs(moved)) as turnover, sum(abs(moved)) * 0.00035 as cost,
          sum(used * ret) - sum(abs(moved)) * 0.00035 as net_ret from g5 group by date),
curve as (select *, sum(ln(abs(1 + net_ret))) over (order by date) as log_growth from daily),
dd as (select *, exp(log_growth - max(log_growth) over (order by date)) - 1 as drawdown from curve)"""


METRICS_SQL = """
figs as (select count(*) as n, exp(sum(ln(1 + net_ret)) * 252 / count(*)) - 1 as cagr, stddev_samp(net_ret) * sqrt(252) as annual_vol,
   avg(net_ret) / stddev_samp(net_ret) * sqrt(252) as sharpe,
   avg(net_ret) / (stddev_samp(net_ret) filter (net_ret < 0)) * sqrt(252) as sortino,
   min(drawdown) as max_drawdown, avg(cast(net_ret > 0 as int)) as hit_rate, quantile_cont(net_ret, 0.05) as var_5pct,
   sum(turnover) as total_turnover from dd),
perf as (select *, cagr / abs(max_drawdown) as calmar,
   (select avg(net_ret) from dd where net_ret <= (select var_5pct from figs)) as cvar_5pct,
   ln(1 + cagr) as log_cagr from figs)"""

DAILY = "date:d gross_ret:6 turnover:6 cost:9 net_ret:6 log_growth:5"
PERF = "n:i log_cagr:6 annual_vol:5 sharpe:6 sortino:6 max_drawdown:8 hit_rate:8 var_5pct:8 cvar_5pct:8 total_turnover:5"


def perf(daily_frame):
    return evaluate.metrics(daily_frame).selectExpr("*", "ln(1 + cagr) as log_cagr")


_MOM = [PRICE, *SQL["momentum_rotation"], daily_sql()]
add_query("evaluate_momentum_rotation", PERF, lambda s, d: perf(daily("momentum_rotation")(s, d)), *_MOM, METRICS_SQL, relation="perf")
add_query("evaluate_daily_results", DAILY, daily("momentum_rotation"), *_MOM, relation="curve")
add_query("evaluate_two_day_delay", DAILY, daily("momentum_rotation", delay=2), PRICE, *SQL["momentum_rotation"], daily_sql(2), relation="curve")
add_query("evaluate_drawdown", "date:d drawdown:8", lambda s, d: evaluate.drawdowns(daily("risk_parity_vol_target")(s, d)),
          PRICE, *SQL["risk_parity_vol_target"], daily_sql(), relation="dd")
add_query(
    "evaluate_long_short", "date:d gross_ret:5 turnover:6 net_ret:5", daily("market_neutral_momentum"),
    PRICE, *SQL["market_neutral_momentum"], daily_sql(), relation="daily",
)
add_query(
    "evaluate_attribution", "ticker total_contribution:5 days_held:i",
    lambda s, d: evaluate.attribution(panel(s, d), weights_of("momentum_rotation")(s, d)),
    *_MOM, "att as (select ticker, sum(used * ret) as total_contribution, count(*) filter (abs(used) > 1e-6 and ret <> 0) as days_held from g5 group by ticker)",
    relation="att",
)
