"""Event, calendar, macro and attention queries with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from barleaf.functions.windows import half_life_decay
from barleaf.operators import assembly as A
from barleaf.operators import events as E
from barleaf.plans.basesql import AVG, BARS, PRICE, SD, W, lag, roll
from barleaf.plans.registry import add_query
from barleaf.session import staged
from barleaf.sources import tables as T

NEWS = """
news0 as (select doc_id, source, lang, cast(timestamp '2020-01-01' + to_hours(cast(doc_id as integer)) as date) as date, n_chars, text,
    timestamp '2020-01-01' + to_hours(cast(doc_id as integer)) as known_at,
    cast(n_chars % 201 as double) / 100 - 1 as sentiment, cast(doc_id % 10 as double) / 10 as novelty,
    cast(n_chars % 100 as double) / 100 as magnitude,
    case when n_chars > 4000 then 2 when n_chars > 2000 then 1 else 0 end as flags from documents),
news as (select *, source as ticker from news0 union all select *, lang as ticker from news0),
daily as (select date, ticker, count(*) as event_count, avg(sentiment) as event_sentiment_mean, avg(magnitude) as event_magnitude_mean,
    max(novelty) as event_novelty_max, sum(flags) as risk_flag_count from news group by date, ticker)"""


def decay_sql(n: int) -> str:
    num = " + ".join(f"coalesce({lag('event_sentiment_mean', i) if i else 'event_sentiment_mean'} * pow(0.85, {i}), 0)" for i in range(n))
    den = " + ".join(f"(case when {lag('event_sentiment_mean', i) if i else 'event_sentiment_mean'} is not null then pow(0.85, {i}) else 0 end)" for i in range(n))
    return f"({num}) / ({den})"


_EV = "date:d ticker event_count:i event_sentiment_mean:9 event_magnitude_mean:9 event_novelty_max:9 risk_flag_count:i"
add_query("events_daily", _EV, lambda s, d: E.daily_events(T.news(s, d)), NEWS, relation="daily")
add_query(
    "events_sentiment_decay", "date:d ticker sent_decay_3d:9 sent_decay_7d:9 sent_decay_14d:9 sent_momentum:9",
    lambda s, d: E.event_features(T.news(s, d)), NEWS,
    f"dec as (select *, {', '.join(f'{decay_sql(n)} as sent_decay_{n}d' for n in (3, 7, 14))} from daily)",
    "out as (select *, sent_decay_3d - sent_decay_7d as sent_momentum from dec)",
)


def latest_day(s, d):
    return T.news(s, d).agg(F.max(F.to_date("known_at"))).scalar()


add_query(
    "events_apprehension", "date:d ticker apprehension_score:9 outlook",
    lambda s, d: E.apprehension(T.news(s, d), latest_day(s, d), 14), NEWS,
    "top as (select max(date) as d from news)",
    "agg as (select ticker, avg(sentiment) as s, avg(magnitude) as m, sum(flags) as f, count(*) as n from news, top where date >= d - 14 group by ticker)",
    """out as (select (select d from top) as date, ticker, least(1, greatest(0, -s) * cast(0.45 as double) + m * cast(0.25 as double) + least(1, f / n) * cast(0.3 as double)) as apprehension_score,
       case when s < -0.2 then 'deteriorating' when s > 0.2 then 'improving' else 'stable' end as outlook from agg)""",
)

# calendars: days with a pending order at an end of the price range stand in for
# meetings and the filers' urgent orders of mid-month for reporting dates

def earnings(s, d):
    o = T.filings(s, d).filter("form = '8-K'").filter(F.dayofmonth("date") == 15)
    return o.select("ticker", "date").distinct()


CAL = """
cal as (select event_name, date from (select cast(o_orderdate as date) as date, arg_max(o_orderstatus, row(o_totalprice, o_orderkey)) as hi, arg_min(o_orderstatus, row(o_totalprice, o_orderkey)) as lo from orders group by 1),
  (select unnest(['FOMC Meeting', 'CPI']) as event_name) where case when event_name = 'CPI' then lo else hi end = 'P')"""
FILINGS = """
filings as (select c_mktsegment as ticker, cast(o_orderdate as date) as date,
   case o_orderpriority when '1-URGENT' then '8-K' when '2-HIGH' then '4' when '3-MEDIUM' then '4/A' when '4-NOT SPECIFIED' then '424B5' else '10-Q' end as form
   from orders join customer on o_custkey = c_custkey),
fpanel as (select date, ticker from (select distinct cast(o_orderdate as date) as date from orders where o_orderpriority = '1-URGENT'),
   (select distinct c_mktsegment as ticker from customer))"""
add_query(
    "events_market_calendar", "date:d ticker days_to_fomc:1 macro_event_imminent",
    lambda s, d: E.market_calendar_features(T.filing_panel(s, d), T.meetings(s, d)), CAL, FILINGS,
    """dist as (select p.date, min(c.date - p.date) filter (c.date >= p.date and event_name like '%FOMC%') as nxt,
        max(c.date - p.date) filter (c.date < p.date and event_name like '%FOMC%') as pst,
        coalesce(bool_or(c.date - p.date between 0 and 3), false) as macro_event_imminent
        from (select distinct date from fpanel) p, cal c group by p.date)""",
    """out as (select date, ticker, coalesce(case when nxt is null then pst when pst is null then nxt when abs(nxt) <= abs(pst) then nxt else pst end, 999) as days_to_fomc,
        macro_event_imminent from fpanel join dist using (date))""",
)
add_query(
    "events_days_to_earnings", "date:d ticker days_to_earnings:1",
    lambda s, d: E.earnings_features(T.filing_panel(s, d), earnings(s, d)), FILINGS,
    "earn as (select distinct ticker, date from filings where form = '8-K' and day(date) = 15)",
    """dist as (select p.date, p.ticker, min(e.date - p.date) filter (e.date >= p.date and e.date - p.date <= 90) as nxt, max(e.date - p.date) filter (e.date < p.date) as pst
        from fpanel p left join earn e on e.ticker = p.ticker group by p.date, p.ticker)""",
    "out as (select date, ticker, coalesce(nxt, pst, 999) as days_to_earnings from dist)",
)
add_query(
    "events_filings", "date:d ticker sec_filings_30d:1 sec_8k_30d:1 sec_form4_90d:1 sec_days_since_filing:1",
    lambda s, d: E.filing_features(T.filing_panel(s, d), T.filings(s, d)), FILINGS,
    """fday as (select ticker, date, count(*) as n, count(*) filter (form like '8-K%') as k, count(*) filter (form in ('4', '4/A')) as f from filings group by ticker, date)""",
    """out as (select p.date, p.ticker, coalesce(sum(n) filter (f.date > p.date - 30), 0) as sec_filings_30d, coalesce(sum(k) filter (f.date > p.date - 30), 0) as sec_8k_30d,
        coalesce(sum(f) filter (f.date > p.date - 90), 0) as sec_form4_90d, p.date - max(f.date) as sec_days_since_filing
        from fpanel p left join fday f on f.ticker = p.ticker and f.date <= p.date group by p.date, p.ticker)""",
)

# -- macro --------------------------------------------------------------------

NAMES = {"level": "macro_level", "peak": "macro_peak"}
MACRO = f"""
mac0 as (select cast(o_orderdate as date) as date, avg(o_totalprice) as level, max(o_totalprice) filter (o_orderstatus = 'P') as peak from orders group by 1),
mac1 as (select date, last_value(level ignore nulls) over (order by date) as macro_level, last_value(peak ignore nulls) over (order by date) as macro_peak from mac0),
mac2 as (select '1' as ticker, * from mac1),
macro as (select date, macro_level, macro_peak,
   macro_level - lag(macro_level, 20) over (order by date) as macro_level_chg_20d,
   macro_peak - lag(macro_peak, 20) over (order by date) as macro_peak_chg_20d,
   case when {roll(SD, 'macro_level', 252, 60)} > 0 then (macro_level - {roll(AVG, 'macro_level', 252, 60)}) / {roll(SD, 'macro_level', 252, 60)} else 0 end as macro_level_z_252,
   case when {roll(SD, 'macro_peak', 252, 60)} > 0 then (macro_peak - {roll(AVG, 'macro_peak', 252, 60)}) / {roll(SD, 'macro_peak', 252, 60)} else 0 end as macro_peak_z_252
   from mac2)"""
_COLS = ["macro_level", "macro_peak", "macro_level_chg_20d", "macro_peak_chg_20d", "macro_level_z_252", "macro_peak_z_252"]
# averages of cents tie at a rounding digit, so levels are compared as logs and
# changes as shares of the level
_SPEC = "log_level:9 macro_peak:2 chg_share:8 macro_peak_chg_20d:2 macro_level_z_252:8 macro_peak_z_252:8"
_SHOW = ["ln(macro_level + 1) as log_level", "macro_level_chg_20d / (macro_level + 1) as chg_share"]
add_query(
    "macro_features", f"date:d {_SPEC}", lambda s, d: E.macro_features(T.macro_series(s, d), NAMES).selectExpr("*", *_SHOW),
    MACRO, f"out as (select *, {', '.join(_SHOW)} from macro)",
)
_CARRY = ", ".join(f"coalesce(last_value({c} ignore nulls) over ({W}), 0) as {c}" for c in _COLS)
add_query(
    "macro_on_panel", f"date:d ticker {_SPEC}",
    lambda s, d: E.join_macro(T.panel(s, d).select("date", "ticker"), E.macro_features(T.macro_series(s, d), NAMES)).selectExpr("*", *_SHOW), BARS, MACRO,
    f"out0 as (select date, ticker, {_CARRY} from (select p.ticker, m.*, p.date as date from panel p left join (select * exclude (date), date as mdate from macro) m on p.date = m.mdate))",
    f"out as (select *, {', '.join(_SHOW)} from out0)",
)

# -- tone, attention, text ----------------------------------------------------

SERIES = """
tone as (select p_brand as ticker, cast(l_shipdate as date) as date, avg(l_discount - l_tax) as tone, count(*) as vol
   from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1, 2),
views as (select p_brand as ticker, cast(l_shipdate as date) as date, cast(sum(l_quantity) as bigint) as views
   from lineitem join part on l_partkey = p_partkey where l_linestatus = 'O' group by 1, 2)"""


def ewm_sql(out: str, x: str, half_life: float, source: str, skip: bool = True) -> str:
    """Weighted mean by a pair join; age counts rows with a value when skipping."""
    step = f"count({x}) over ({W})" if skip else f"row_number() over ({W})"
    r = repr(half_life_decay(half_life))
    return f"""
{out}_n as (select *, {step} as st from {source}),
{out}_e as (select a.ticker, a.date, sum(b.{x} * pow(cast({r} as double), a.st - b.st)) / sum(pow(cast({r} as double), a.st - b.st)) as {out}
  from {out}_n a join {out}_n b on a.ticker = b.ticker and b.date <= a.date where b.{x} is not null group by a.ticker, a.date),
{out}_t as (select s.*, e.{out} from {source} s left join {out}_e e using (ticker, date))"""


def zed(x: str) -> str:
    sd, m = roll(SD, x, 60, 20), roll(AVG, x, 60, 20)
    return f"case when {sd} > 1e-9 then ({x} - {m}) / {sd} end"


_TONE = [
    BARS, SERIES,
    "tp as (select p.ticker, p.date, tone, vol, ln(coalesce(vol, 0) + 1) as lv from panel p left join tone t using (ticker, date))",
    ewm_sql("slow", "tone", 7, "tp"), ewm_sql("fast", "tone", 3, "slow_t"),
    f"tonef as (select ticker, date, slow as news_tone, fast - slow as news_tone_mom, {zed('lv')} as news_buzz from fast_t)",
]
_VIEWS = [
    SERIES.replace("\ntone as", "\ntone2 as"),
    "vp as (select p.ticker, p.date, ln(views + 1) as lv from panel p left join views v using (ticker, date))",
    ewm_sql("vf", "lv", 3, "vp"), ewm_sql("vs", "lv", 20, "vf_t"),
    f"viewf as (select ticker, date, {zed('lv')} as wiki_attention_z, vf - vs as wiki_attention_mom from vs_t)",
]


def keys(s, d):
    return T.panel(s, d).select("ticker", "date")


add_query("attention_tone", "date:d ticker news_tone:9 news_tone_mom:9 news_buzz:8", lambda s, d: E.tone_features(keys(s, d), T.tone_series(s, d)), *_TONE, relation="tonef")
add_query("attention_views", "date:d ticker wiki_attention_z:8 wiki_attention_mom:8", lambda s, d: E.attention_features(keys(s, d), T.view_series(s, d)), BARS, *_VIEWS, relation="viewf")
add_query(
    "attention_densified", "date:d ticker news_tone:9 news_tone_mom:9 news_buzz:8 wiki_attention_z:8 wiki_attention_mom:8 news_present:1 wiki_present:1",
    lambda s, d: E.densify(E.attention_features(E.tone_features(keys(s, d), T.tone_series(s, d)), T.view_series(s, d))),
    *_TONE, *[p.replace("views as", "views2 as") if p.startswith("\ntone2") else p for p in _VIEWS],
    """out as (select date, ticker, coalesce(news_tone, 0) as news_tone, coalesce(news_tone_mom, 0) as news_tone_mom, coalesce(news_buzz, 0) as news_buzz,
        coalesce(wiki_attention_z, 0) as wiki_attention_z, coalesce(wiki_attention_mom, 0) as wiki_attention_mom,
        cast(coalesce(news_tone, news_tone_mom, news_buzz) is not null as int) as news_present,
        cast(coalesce(wiki_attention_z, wiki_attention_mom) is not null as int) as wiki_present from tonef join viewf using (ticker, date))""",
)
add_query(
    "text_sentiment", "date:d ticker finbert_sent:9 finbert_sent_mom:9 finbert_news_30d:i",
    lambda s, d: E.text_features(T.news_panel(s, d), T.news(s, d)), NEWS,
    "np as (select date, ticker from (select distinct date from news0), (select distinct source as ticker from news0))",
    "sc as (select ticker, date, avg(sentiment) as fb, count(*) as n from news where n_chars % 3 <> 0 group by ticker, date)",
    f"tp as (select np.ticker, np.date, coalesce(fb, 0) as fb, coalesce(n, 0) as n, sum(coalesce(n, 0)) over ({W} rows between 29 preceding and current row) as finbert_news_30d from np left join sc using (ticker, date))".replace("partition by ticker order by date", "partition by np.ticker order by np.date"),
    ewm_sql("slow", "fb", 7, "tp", False), ewm_sql("fast", "fb", 3, "slow_t", False),
    """out as (select ticker, date, finbert_news_30d, case when finbert_news_30d > 0 then slow end as finbert_sent,
        case when finbert_news_30d > 0 then fast - slow end as finbert_sent_mom from fast_t)""",
)

# -- the feature matrix --------------------------------------------------------

SOURCES = {
    "events": T.brand_news,
    "apprehension": lambda s, d: E.apprehension(T.brand_news(s, d), T.brand_news(s, d).agg(F.max(F.to_date("known_at"))).scalar(), 365),
    "calendar": T.meetings,
    "earnings": lambda s, d: T.brand_filings(s, d).filter("form = '8-K' and dayofmonth(date) = 15").select("ticker", "date").distinct(),
    "macro": lambda s, d: E.macro_features(T.macro_series(s, d), NAMES),
    "tone": T.tone_series,
    "filings": T.brand_filings,
    "views": T.view_series,
    "scored": T.brand_news,
}


def assembled(*absent):
    def build(s, d):
        given = {k: f(s, d) for k, f in SOURCES.items() if k not in absent}
        return staged(s, f"matrix:{d}:{','.join(absent)}", lambda: A.feature_matrix(T.panel(s, d), T.BENCHMARK, **given))

    return build


_BNEWS = NEWS.replace("cast(timestamp '2020-01-01' + to_hours(cast(doc_id as integer)) as date) as date", "date '1995-01-01' + cast(doc_id * 37 % 2400 as int) as date").replace(
    "news as (select *, source as ticker from news0 union all select *, lang as ticker from news0)", "news as (select *, 'Brand#' || (doc_id % 25 + 1) as ticker from news0)")
_MATRIX = [
    PRICE, _BNEWS,
    f"dec as (select *, {', '.join(f'{decay_sql(n)} as sent_decay_{n}d' for n in (3, 7, 14))} from daily)",
    "apt as (select max(date) as d from news)",
    "apa as (select ticker, avg(sentiment) as s, avg(magnitude) as m, sum(flags) as f, count(*) as n from news, apt where date >= d - 365 group by ticker)",
    """apr as (select (select d from apt) as date, ticker, least(1, greatest(0, -s) * cast(0.45 as double) + m * cast(0.25 as double) + least(1, f / n) * cast(0.3 as double)) as apprehension_score,
       case when s < -0.2 then 'deteriorating' when s > 0.2 then 'improving' else 'stable' end as outlook from apa)""",
    CAL,
    """mdist as (select p.date, min(c.date - p.date) filter (c.date >= p.date and event_name like '%FOMC%') as nxt, max(c.date - p.date) filter (c.date < p.date and event_name like '%FOMC%') as pst,
        coalesce(bool_or(c.date - p.date between 0 and 3), false) as macro_event_imminent from (select distinct date from panel) p, cal c group by p.date)""",
    "mcal as (select date, coalesce(case when nxt is null then pst when pst is null then nxt when abs(nxt) <= abs(pst) then nxt else pst end, 999) as days_to_fomc, macro_event_imminent from mdist)",
    """bfil as (select p_brand as ticker, cast(o_orderdate as date) as date,
        case o_orderpriority when '1-URGENT' then '8-K' when '2-HIGH' then '4' when '3-MEDIUM' then '4/A' when '4-NOT SPECIFIED' then '424B5' else '10-Q' end as form
        from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)""",
    "bday as (select ticker, date, count(*) as n, count(*) filter (form like '8-K%') as k, count(*) filter (form in ('4', '4/A')) as f from bfil group by ticker, date)",
    """bcnt as (select p.date, p.ticker, coalesce(sum(n) filter (f.date > p.date - 30), 0) as sec_filings_30d, coalesce(sum(k) filter (f.date > p.date - 30), 0) as sec_8k_30d,
        coalesce(sum(f) filter (f.date > p.date - 90), 0) as sec_form4_90d, p.date - max(f.date) as last from panel p left join bday f on f.ticker = p.ticker and f.date <= p.date group by p.date, p.ticker)""",
    "bern as (select distinct ticker, date from bfil where form = '8-K' and day(date) = 15)",
    """bed as (select p.date, p.ticker, min(e.date - p.date) filter (e.date >= p.date and e.date - p.date <= 90) as nxt, max(e.date - p.date) filter (e.date < p.date) as pst
        from panel p left join bern e on e.ticker = p.ticker group by p.date, p.ticker)""",
    MACRO,
    "mpan as (select p.ticker, m.*, p.date as date from panel p left join (select * exclude (date), date as mdate from macro) m on p.date = m.mdate)",
    f"mcar as (select ticker, date, {_CARRY} from mpan)",
    *_TONE[1:], *[p.replace("views as", "views2 as").replace("left join views v", "left join views2 v") if i < 2 else p for i, p in enumerate(_VIEWS)],
    "bsc as (select ticker, date, avg(sentiment) as fb, count(*) as n from news where n_chars % 3 <> 0 group by ticker, date)",
    "xp as (select p.ticker, p.date, coalesce(fb, 0) as fb, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by p.ticker order by p.date rows between 29 preceding and current row) as finbert_news_30d from panel p left join bsc using (ticker, date))",
    ewm_sql("xslow", "fb", 7, "xp", False), ewm_sql("xfast", "fb", 3, "xslow_t", False),
    "xf as (select ticker, date, finbert_news_30d, case when finbert_news_30d > 0 then xslow end as finbert_sent, case when finbert_news_30d > 0 then xfast - xslow end as finbert_sent_mom from xfast_t)",
    """mtx as (select feat.*, event_count, event_sentiment_mean, event_novelty_max, risk_flag_count, sent_decay_3d, sent_decay_14d, sent_decay_3d - sent_decay_7d as sent_momentum,
        apprehension_score, coalesce(outlook, 'stable') as outlook, days_to_fomc, macro_event_imminent, coalesce(bed.nxt, bed.pst, 999) as days_to_earnings,
        sec_filings_30d, sec_8k_30d, sec_form4_90d, coalesce(bcnt.last, 999) as sec_days_since_filing, macro_level_z_252, ln(macro_level + 1) as log_level, macro_peak,
        coalesce(news_tone, 0) as news_tone, coalesce(news_tone_mom, 0) as news_tone_mom, coalesce(news_buzz, 0) as news_buzz, cast(coalesce(news_tone, news_tone_mom, news_buzz) is not null as int) as news_present,
        coalesce(wiki_attention_z, 0) as wiki_attention_z, coalesce(wiki_attention_mom, 0) as wiki_attention_mom, cast(coalesce(wiki_attention_z, wiki_attention_mom) is not null as int) as wiki_present,
        1 as sec_present, finbert_sent, finbert_sent_mom, finbert_news_30d
        from feat left join dec using (ticker, date) left join apr using (ticker, date) left join mcal using (date) left join bed using (ticker, date) left join bcnt using (ticker, date)
        left join mcar using (ticker, date) left join tonef using (ticker, date) left join viewf using (ticker, date) left join xf using (ticker, date))""",
]
_PRICED = "date:d ticker ret_1d:6 mom_20d:6 vol_20d:6 rsi_14:6 max_dd_252:8 beta_60:5 mom_20d_rank:9 bull_regime:i forward_return_5d:6 forward_return_20d:6"
_BY_SOURCE = {
    "events": "event_count:i event_sentiment_mean:9 event_novelty_max:9 risk_flag_count:i sent_decay_3d:9 sent_decay_14d:9 sent_momentum:9",
    "apprehension": "apprehension_score:9 outlook", "calendar": "days_to_fomc:1 macro_event_imminent", "earnings": "days_to_earnings:1", "macro": "macro_level_z_252:8 log_level:9 macro_peak:2",
    "tone": "news_tone:9 news_tone_mom:9 news_buzz:8 news_present:1", "filings": "sec_filings_30d:1 sec_8k_30d:1 sec_form4_90d:1 sec_days_since_filing:1 sec_present:1",
    "views": "wiki_attention_z:8 wiki_attention_mom:8 wiki_present:1", "scored": "finbert_sent:9 finbert_sent_mom:9 finbert_news_30d:i",
}


def matrix_query(name, *absent):
    spec = " ".join([_PRICED, *[c for k, c in _BY_SOURCE.items() if k not in absent]])

    def build(s, d):
        df = assembled(*absent)(s, d)
        return df.withColumn("log_level", F.log(F.col("macro_level") + 1)) if "macro" not in absent else df

    add_query(name, spec, build, *_MATRIX, relation="mtx")


matrix_query("features_assembled")
matrix_query("features_assembled_prices_and_filings", "events", "apprehension", "calendar", "earnings", "macro", "tone", "views", "scored")
matrix_query("features_assembled_without_filings", "filings", "apprehension", "events")
