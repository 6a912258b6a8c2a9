"""Strided estimator queries and eigenvalue features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barleaf.functions.windows import carry, spread
from barleaf.operators import decisions as D
from barleaf.operators import nonlinear as N
from barleaf.operators.evaluate import returns_of
from barleaf.plans.basesql import BARS
from barleaf.plans.registry import add_query
from barleaf.session import staged
from barleaf.sources import tables as T

SRC = """
src0 as (select ticker, date, ln(adj_close) as logprice, ln(adj_close) - lag(ln(adj_close)) over (partition by ticker order by date) as logret,
   row_number() over (partition by ticker order by date) as rn, count(*) over (partition by ticker) as n from panel),
src as (select *, case when count(logret) over f >= 2 then stddev_pop(logret) over f end as volproxy from src0 window f as (partition by ticker order by date rows 4 preceding))"""


def win(source: str, w: int, stride: int) -> str:
    return f"""
win as (select a.ticker, a.date, s.{source} as v, row_number() over (partition by a.ticker, a.date order by s.rn) - 1 as i, count(*) over (partition by a.ticker, a.date) as n
  from (select ticker, date, rn as a from src where rn >= {w} and ((rn - {w}) % {stride} = 0 or rn = n)) a
  join src s on s.ticker = a.ticker and s.rn between a.a - {w} + 1 and a.a where s.{source} is not null)"""


add_query("nonlinear_sources", "date:d ticker logprice:9 logret:8 volproxy:8", lambda s, d: N.sources(spread(T.panel(s, d))), BARS, SRC, relation="src")


def mean_of(x):
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def strided_mean(s, d):
    """The stride and carry machinery with a plain mean as the estimator."""
    p = T.panel(s, d).select("ticker", "date", "adj_close")
    values = N.strided(p, [N.Estimator("tmean", "logprice", 120, 7, "test", mean_of)])
    return p.join(values, ["ticker", "date"], "left").select("ticker", "date", carry("tmean").alias("tmean"))


add_query(
    "nonlinear_strided_carry", "date:d ticker tmean:9", strided_mean, BARS, SRC, win("logprice", 120, 7),
    "m as (select ticker, date, avg(v) as tmean from win group by 1, 2)",
    "out as (select ticker, date, last_value(tmean ignore nulls) over (partition by ticker order by date) as tmean from (select ticker, date from src) left join m using (ticker, date))",
)


def one(name):
    return lambda s, d: N.strided(T.panel(s, d), [N.named(name)]).withColumnRenamed(name, "value")


def estimator(name: str, digits: int, *parts: str) -> None:
    e = N.named(name)
    sql = (BARS, SRC, win(e.source, e.window, e.stride), *parts) if parts else ()
    add_query(f"nonlinear_{name}", f"date:d ticker value:{digits}", one(name), *sql)


P = "partition by ticker, date order by i"
estimator(
    "perm_entropy_60", 9, f"c as (select ticker, date, v, lead(v) over ({P}) as b, lead(v, 2) over ({P}) as c from win)",
    "k as (select ticker, date, (v <= b)::int * 4 + (b <= c)::int * 2 + (v <= c)::int as code, count(*) as m from c where c is not null group by 1, 2, 3)",
    "p as (select *, m / sum(m) over (partition by ticker, date) as p from k)", "out as (select ticker, date, -sum(p * ln(p)) / ln(6) as value from p group by 1, 2)",
)
estimator(
    "hill_tail_alpha_250", 7, "r as (select ticker, date, abs(v) as a, row_number() over (partition by ticker, date order by abs(v) desc) as rk, count(*) over (partition by ticker, date) as m from win where v <> 0)",
    "k as (select *, least(greatest(5, cast(floor(m * cast(0.1 as double)) as int)), m - 1) as k from r)",
    "t as (select ticker, date, any_value(k) as k, any_value(m) as m, sum(ln(a)) filter (rk <= k) - any_value(k) * ln(max(a) filter (rk = k + 1)) as s from k group by 1, 2)",
    "out as (select ticker, date, case when m >= 20 then k / s end as value from t)",
)


def haar(level: int, source: str) -> str:
    return f"""
h{level} as (select ticker, date, i // 2 as i, any_value(n) // 2 as n, sum(case when i % 2 = 0 then v else -v end) / sqrt(2) as detail, sum(v) / sqrt(2) as v from {source} where i < n - n % 2 group by ticker, date, i // 2)"""


estimator(
    "wavelet_hf_60", 9, haar(1, "win"), haar(2, "h1"), haar(3, "h2"),
    "e as (" + " union all ".join(f"select ticker, date, sum(detail * detail) as hi, {'sum(v * v)' if k == 3 else '0'} as lo from h{k} group by 1, 2" for k in (1, 2, 3)) + ")",
    "out as (select ticker, date, sum(hi) / (sum(hi) + sum(lo)) as value from e group by 1, 2)",
)
estimator(
    "rough_vol_h_120", 7, f"lv as (select ticker, date, ln(v) as v, row_number() over ({P}) - 1 as i, count(*) over (partition by ticker, date) as n from win where v > 0)",
    "m as (select a.ticker, a.date, b.i - a.i as lag, any_value(a.n) as n, avg(pow(b.v - a.v, 2)) as m from lv a join lv b on a.ticker = b.ticker and a.date = b.date and b.i - a.i between 1 and least(20, a.n // 4) group by 1, 2, 3)",
    "out as (select a.ticker, a.date, any_value(v) as value from (select distinct ticker, date from win) a left join (select ticker, date, case when any_value(n) >= 30 and count(*) >= 4 then regr_slope(ln(m), ln(lag)) / 2 end as v from m where m > 0 group by 1, 2) m using (ticker, date) group by 1, 2)",
)
estimator("hist_entropy_60", 8, "b as (select *, min(v) over (partition by ticker, date) as lo, max(v) over (partition by ticker, date) as hi from win)",
          "k as (select ticker, date, least(floor((v - lo) / (hi - lo) * 16), 15) as bin, count(*) as m from b group by 1, 2, 3)", "p as (select *, m / sum(m) over (partition by ticker, date) as p from k)",
          "out as (select ticker, date, -sum(p * ln(p)) / ln(16) as value from p group by 1, 2)")
estimator("ar1_60", 7, f"c as (select ticker, date, v, lead(v) over ({P}) as b from win)", "out as (select ticker, date, corr(v, b) as value from c where b is not null group by 1, 2)")

def fast(s, d):
    return staged(s, f"nonlinear:{d}", lambda: N.nonlinear_features(T.panel(s, d).select("ticker", "date", "adj_close")))


add_query("nonlinear_features_all", "date:d ticker " + " ".join(f"{e.name}:6" for e in N.REGISTRY), fast)
add_query("nonlinear_fingerprint", "ticker metric value:6 reading warning", lambda s, d: N.fingerprint(fast(s, d)))


def dense(s, d):
    """Bars on the full dates x brands grid, prices carried: one row per date of
    the calendar per brand, expanded from each brand's own spans."""
    p = T.panel(s, d).select("ticker", "date", "adj_close")
    from pyspark.sql import Window

    cal = p.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))
    last = cal.agg(F.max("_i")).scalar()
    spans = p.join(cal, "date").withColumn("_to", F.coalesce(F.lead("_i").over(Window.partitionBy("ticker").orderBy("_i")) - 1, last))
    rows = spans.select("ticker", "adj_close", F.explode(F.sequence("_i", "_to")).alias("_i"))
    return rows.join(cal, "_i").select("ticker", "date", "adj_close")


DENSE = """
cal as (select date, row_number() over (order by date) as i from (select distinct date from panel)),
dense0 as (select c.date, c.i, t.ticker, last_value(p.adj_close ignore nulls) over (partition by t.ticker order by c.date) as adj_close from cal c cross join (select distinct ticker from panel) t left join panel p on p.date = c.date and p.ticker = t.ticker),
dense as (select * from dense0 where adj_close is not null)"""
add_query("bars_dense", "date:d ticker adj_close", dense, BARS, DENSE, relation="dense")
add_query("nonlinear_eigen_features", "date:d ticker rmt_systematic_frac:6 rmt_market_beta:6", lambda s, d: N.eigen_features(dense(s, d)))


def modes(s, d):
    """The spectrum's invariants: the trace, and whether the leading vector is one."""
    found = N.market_modes(N.standard_windows(dense(s, d)))
    return found.select("date", "names", "trace", (F.col("residual") < 1e-8 * F.col("top")).alias("sound"), ((F.col("frac") >= 0) & (F.col("frac") <= 1)).alias("share"))


add_query(
    "nonlinear_market_modes", "date:d names:i trace:6 sound share", modes, BARS, DENSE,
    "rr as (select ticker, date, i, ln(adj_close / lag(adj_close) over (partition by ticker order by i)) as r from dense)",
    "rw as (select ticker, date, i, count(r) over w as nfull, i - lag(i, 251) over (partition by ticker order by i) as span, var_pop(r) over w as v from rr window w as (partition by ticker order by i rows 251 preceding))",
    "an as (select i from cal where i >= 252 and ((i - 252) % 5 = 0 or i = (select max(i) from cal)))",
    "out as (select date, count(*) as names, sum(v / pow(sqrt(v) + 1e-12, 2)) as trace, true as sound, true as share from rw semi join an using (i) where nfull = 252 and span = 251 group by 1 having count(*) >= 20)",
)


add_query("select_returns", "date:d ticker ret:6", lambda s, d: returns_of(T.panel(s, d)), BARS,
          "r as (select date, ticker, adj_close / lag(adj_close) over (partition by ticker order by date) - 1 as ret from panel)", "out as (select * from r where ret is not null)")
add_query("select_newest_names", "ticker date:d", lambda s, d: D.latest_per_ticker(T.panel(s, d), []), BARS, "out as (select ticker, max(date) as date from panel group by 1)")
