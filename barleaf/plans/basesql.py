"""DuckDB text of the shared inputs: bars, price features, rebalancing.

Written from the definitions, not generated from the Spark code.
"""

from __future__ import annotations

BENCH = "Brand#1"

BARS = """
lines as (
  select p_brand as ticker, cast(l_shipdate as date) as date, l_quantity as qty,
         l_extendedprice / l_quantity as price,
         row_number() over (partition by p_brand, cast(l_shipdate as date)
            order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as first_no,
         row_number() over (partition by p_brand, cast(l_shipdate as date)
            order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as last_no
  from lineitem join part on l_partkey = p_partkey),
bars as (
  select ticker, date, max(price) filter (first_no = 1) as open, max(price) as high, min(price) as low,
         max(price) filter (last_no = 1) as close, max(price) filter (last_no = 1) as adj_close,
         cast(sum(qty) as bigint) as volume
  from lines group by ticker, date),
panel as (
  select * from bars where close > 0 and open > 0 and high > 0 and low > 0 and high >= low
    and high >= open and high >= close and low <= open and low <= close)
"""

W = "partition by ticker order by date"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over ({W})"


def roll(agg: str, x: str, n: int, need: int | None = None) -> str:
    """``agg`` holds {x}; null until ``need`` non-null values are in the frame."""
    frame = f"over ({W} rows between {n - 1} preceding and current row)"
    parts = agg.format(x=x).replace("@", frame)
    if "@" not in agg:
        parts = f"{parts} {frame}"
    return f"case when count({x}) {frame} >= {need or n} then {parts} end"


AVG, SUM, SD, VAR, MAX, MIN = "avg({x})", "sum({x})", "stddev_samp({x})", "var_samp({x})", "max({x})", "min({x})"
SKEW = (
    "(avg(pow({x}, 3)) @ - 3 * avg({x}) @ * avg(pow({x}, 2)) @ + 2 * pow(avg({x}) @, 3))"
    " / pow(avg(pow({x}, 2)) @ - pow(avg({x}) @, 2), 1.5)"
)

FEATURES = f"""
f1 as (
  select *, adj_close / {lag('adj_close')} - 1 as ret_1d,
    ln(adj_close / {lag('adj_close')}) as log_ret_1d,
    {", ".join(f"adj_close / {lag('adj_close', n)} - 1 as mom_{n}d" for n in (5, 10, 20, 60, 120))},
    {lag('adj_close', 21)} / {lag('adj_close', 252)} - 1 as mom_12m1m,
    {", ".join(f"{roll(AVG, 'adj_close', n)} as sma_{n}" for n in (10, 20, 50, 200))},
    adj_close / {roll(MAX, 'adj_close', 60)} - 1 as dd_from_high_60,
    greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) as tr,
    {roll(AVG, 'volume', 20)} as mean_volume,
    close * volume as dollars,
    (close - {roll(MAX, 'high', 20)}) / {roll(MAX, 'high', 20)} as breakout_20,
    (close - {roll(MIN, 'low', 20)}) / {roll(MIN, 'low', 20)} as breakdown_20,
    coalesce(greatest(adj_close - {lag('adj_close')}, 0), 0) as gain,
    coalesce(greatest({lag('adj_close')} - adj_close, 0), 0) as loss,
    open / {lag('close')} - 1 as overnight_gap,
    (volume - {roll(AVG, 'volume', 60)}) / ({roll(SD, 'volume', 60)} + 1e-9) as volume_z_60,
    {roll(SD, 'adj_close', 20)} as sd20,
    adj_close / {roll(MAX, 'adj_close', 252, 60)} - 1 as dist_52w_high,
    adj_close / {roll(MIN, 'adj_close', 252, 60)} - 1 as dist_52w_low
  from panel),
f2 as (
  select f1.*,
    {", ".join(f"adj_close / sma_{n} - 1 as sma_gap_{n}" for n in (10, 20, 50, 200))},
    {", ".join(f"{roll(SD, 'log_ret_1d', n)} * sqrt(252) as vol_{n}d" for n in (10, 20, 60))},
    {roll(AVG, 'tr', 14)} as atr_14,
    case when mean_volume > 0 then volume / mean_volume end as rel_vol_20,
    {roll(AVG, 'dollars', 20)} as avg_dollar_volume_20,
    {roll(AVG, 'gain', 14)} as up14, {roll(AVG, 'loss', 14)} as down14,
    {roll(AVG, '(abs(ret_1d) / (dollars + 1.0))', 20)} * 1e9 as amihud_illiq_20,
    {roll(SD, '(case when ret_1d < 0 then ret_1d end)', 20, 5)} * sqrt(252) as downside_vol_20d,
    {roll(SD, '(case when ret_1d < 0 then ret_1d end)', 60, 15)} * sqrt(252) as downside_vol_60d,
    {roll(SKEW, 'ret_1d', 60)} as ret_skew_60,
    {roll(AVG, 'ret_1d', 60)} as mean60, {roll(SD, 'ret_1d', 60)} as sd60,
    (adj_close - (sma_20 - 2 * sd20)) / (4 * sd20 + 1e-9) as bb_pctb_20,
    mom_20d - mom_60d as mom_accel,
    {roll(MIN, 'dist_52w_high', 252, 60)} as max_dd_252
  from f1),
f3 as (
  select f2.*, b.ret_1d as bench_ret_1d, f2.ret_1d - b.ret_1d as excess_ret_1d,
    f2.ret_1d * b.ret_1d as rrb, b.ret_1d * b.ret_1d as rb2
  from f2 left join (select date, ret_1d from f2 where ticker = '{BENCH}') b using (date)),
feat as (
  select *,
    case when down14 = 0 and up14 = 0 then 50.0 when down14 = 0 then 100.0
         else 100 - 100 / (1 + up14 / down14) end as rsi_14,
    {roll(SD, 'vol_20d', 60)} as vol_of_vol_60,
    {roll(AVG, '(pow((ret_1d - mean60) / (sd60 + 1e-12), 4))', 60)} - 3 as ret_kurt_60,
    case when sma_200 is not null then cast(adj_close > sma_200 as int) end as bull_regime,
    case when {roll('median({x})', 'vol_20d', 252)} is not null
         then cast(vol_20d > {roll('median({x})', 'vol_20d', 252)} as int) end as high_vol_regime,
    ({roll(AVG, 'rrb', 60)} - {roll(AVG, 'ret_1d', 60)} * {roll(AVG, 'bench_ret_1d', 60)})
      / ({roll(AVG, 'rb2', 60)} - pow({roll(AVG, 'bench_ret_1d', 60)}, 2) + 1e-12) as beta_60,
    ({roll(AVG, 'rrb', 60)} - {roll(AVG, 'ret_1d', 60)} * {roll(AVG, 'bench_ret_1d', 60)})
      / (sd60 * {roll(SD, 'bench_ret_1d', 60)} + 1e-12) as corr_bench_60,
    case when mom_20d is not null then
      (row_number() over (partition by date order by mom_20d nulls last, ticker) - 1)
      / cast(greatest(count(mom_20d) over (partition by date) - 1, 1) as double) end as mom_20d_rank,
    lead(adj_close, 5) over ({W}) / adj_close - 1 as forward_return_5d,
    lead(adj_close, 20) over ({W}) / adj_close - 1 as forward_return_20d
  from f3)
"""

PRICE = f"{BARS.strip()},\n{FEATURES.strip()}"


def rebalance(every: int, signal: str = "sig", features: str = "feat") -> str:
    """From sig(date, ticker, weight) to out: every n-th signal date, carried."""
    return f"""
kd as (select date from (select date, row_number() over (order by date) - 1 as i
       from (select distinct date from {signal})) where i % {every} = 0),
held as (select s.date, s.ticker, s.weight from {signal} s semi join kd on s.date = kd.date),
grid as (select d.date, t.ticker from (select distinct date from {features}) d, (select distinct ticker from {signal}) t),
out as (select g.date, g.ticker, coalesce(last_value(h.weight ignore nulls) over (partition by g.ticker order by g.date
         rows between unbounded preceding and current row), 0) as weight
        from grid g left join held h on g.date = h.date and g.ticker = h.ticker)"""


def rank(score: str, ascending: bool = False, by: str = "date") -> str:
    way = "asc" if ascending else "desc"
    return f"case when {score} is not null then row_number() over (partition by {by} order by {score} {way} nulls last, ticker) end"


def carry(x: str) -> str:
    return f"last_value({x} ignore nulls) over ({W} rows between unbounded preceding and current row)"
