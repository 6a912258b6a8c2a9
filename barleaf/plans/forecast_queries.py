"""Split, rank-correlation, drift, ledger, band and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barleaf.operators import bands as B
from barleaf.operators import calibration as C
from barleaf.operators import forecast as FC
from barleaf.operators import gate as G
from barleaf.plans.basesql import PRICE
from barleaf.plans.decision_queries import last_prices, name_lists
from barleaf.plans.price_queries import FAMILIES, features
from barleaf.plans.registry import add_query
from barleaf.plans.ridge_sql import quantile_ctes, quantile_sql, ridge_ctes, score_sql
from barleaf.session import staged
from barleaf.sources import tables as T

# -- splits -------------------------------------------------------------------


def folds(s, d):
    return C.walk_forward_folds(features(s, d), 28)


FOLDS = """
ud as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from feat)),
tl as (select date, i - cast(floor(n * 0.4) as bigint) as j, n - cast(floor(n * 0.4) as bigint) as m from ud where i >= floor(n * 0.4)),
bl as (select date, case when j < (m % 5) * (m // 5 + 1) then j // (m // 5 + 1) else m % 5 + (j - (m % 5) * (m // 5 + 1)) // (m // 5) end as fold from tl),
folds as (select fold, min(date) as test_start, max(date) as test_end, min(date) - 33 as train_end from bl group by 1)"""
add_query("split_walk_forward", "fold:i test_start:d test_end:d train_end:d", folds, PRICE, FOLDS, relation="folds")
add_query("split_fold_rows", "fold:i role n:i", lambda s, d: C.assign_folds(features(s, d).select("date", "ticker"), folds(s, d)).groupBy("fold", "role").agg(F.count("*").alias("n")), PRICE, FOLDS,
          "out as (select fold, case when date < train_end then 'train' else 'test' end as role, count(*) as n from feat join folds on date < train_end or date between test_start and test_end group by 1, 2)")
add_query("split_overlap_free", "fold:i last_train:d clean", lambda s, d: C.overlap_free(features(s, d), folds(s, d), 28), PRICE, FOLDS,
          "out as (select fold, max(date) as last_train, max(date) + 28 < any_value(test_start) as clean from feat join folds on date < train_end group by 1)")
add_query(
    "split_combinatorial", "fold:i role n:i lo:d hi:d",
    lambda s, d: C.combinatorial_dates(features(s, d), 28).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")), PRICE,
    "ud as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from feat))",
    "gr as (select date, case when i < (n % 6) * (n // 6 + 1) then i // (n // 6 + 1) else n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) end as g from ud)",
    "sp as (select g, min(date) as lo, max(date) as hi from gr group by 1)",
    "pk as (select a.g as a, b.g as b, a.lo as alo, a.hi as ahi, b.lo as blo, b.hi as bhi, row_number() over (order by a.g, b.g) - 1 as fold from sp a join sp b on a.g < b.g)",
    "rl as (select fold, date, case when g in (a, b) then 'test' when date between alo - 33 and ahi + 33 or date between blo - 33 and bhi + 33 then null else 'train' end as role from pk, gr)",
    "out as (select fold, role, count(*) as n, min(date) as lo, max(date) as hi from rl where role is not null group by 1, 2)",
)
add_query(
    "split_calendar_windows", "fold:i train_start:d train_end:d test_end:d", lambda s, d: C.calendar_windows(features(s, d), 3, 1, 1), PRICE,
    "b as (select min(date) as lo, max(date) as hi from feat)",
    "out as (select k as fold, cast(lo + to_years(cast(k as int)) as date) as train_start, cast(lo + to_years(cast(k + 3 as int)) as date) as train_end, cast(lo + to_years(cast(k + 4 as int)) as date) as test_end from b, range(0, 10000) r(k) where cast(lo + to_years(cast(k + 4 as int)) as date) <= hi)",
)

# -- metrics of three single-feature models -----------------------------------

MODELS = {"mom": "mom_20d", "reversal": "-mom_5d", "calm": "-vol_20d"}


def predictions(s, d):
    """(fold, model, date, ticker, score, y) on the test blocks; scores are the
    features themselves, scaled to a return-like size."""
    def build():
        f = features(s, d).filter("forward_return_20d is not null and mom_20d is not null and vol_20d is not null")
        tests = C.assign_folds(f.select("date", "ticker", "mom_5d", "mom_20d", "vol_20d", F.col("forward_return_20d").alias("y")), folds(s, d)).filter("role = 'test'")
        picks = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.expr(e) / 10).alias("score")) for m, e in MODELS.items()]))
        return tests.select("fold", "date", "ticker", "y", picks.alias("p")).select("fold", "date", "ticker", "y", "p.*")

    return staged(s, f"predictions:{d}", build)


PRED = [
    PRICE, FOLDS,
    "tst as (select fold, date, ticker, mom_5d, mom_20d, vol_20d, forward_return_20d as y from feat join folds on date between test_start and test_end where forward_return_20d is not null and mom_20d is not null and vol_20d is not null)",
    "pred as (" + " union all ".join(f"select fold, date, ticker, y, '{m}' as model, ({e}) / 10 as score from tst" for m, e in MODELS.items()) + ")",
]
IC = """
rk as (select *, rank() over (partition by model, fold, date order by y) + (count(*) over (partition by model, fold, date, y) - 1) / 2.0 as ry,
   rank() over (partition by model, fold, date order by score) + (count(*) over (partition by model, fold, date, score) - 1) / 2.0 as rp from pred),
dic as (select model, fold, date, count(*) as n, corr(ry, rp) as ic, stddev_pop(score) as sd from rk group by 1, 2, 3),
fic as (select model, fold, avg(ic) as ic, count(*) as n_dates from dic where n >= 10 and sd > 1e-12 and ic is not null group by 1, 2)"""
add_query("metric_per_date_ic", "model fold:i ic:8 n_dates:i", lambda s, d: C.per_date_ic(predictions(s, d), "y", "score", ("model", "fold")), *PRED, IC, relation="fic")
add_query("metric_pooled_ic", "model ic:8 n:i", lambda s, d: C.pooled_ic(predictions(s, d), "y", "score", ("model",)), *PRED,
          "rp as (select model, rank() over (partition by model order by y) + (count(*) over (partition by model, y) - 1) / 2.0 as a, rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0 as b from pred)",
          "out as (select model, corr(a, b) as ic, count(*) as n from rp group by 1)")
FOLDM = """
fm as (select model, fold, avg(cast(sign(score) = sign(y) as int)) filter (abs(y) > 1e-9) as hit_rate, avg(abs(y - score)) as mae, 1 - sum(pow(y - score, 2)) / (var_pop(y) * count(*)) as r2, count(*) as n from pred group by 1, 2),
fmet as (select fm.*, coalesce(ic, 0) as ic from fm left join fic using (model, fold))"""


def fold_metrics(s, d):
    return C.fold_metrics(predictions(s, d), "y", "score", priority="ticker < 'Brand#18'")


add_query("metric_folds", "model fold:i ic:8 hit_rate:9 mae:6 r2:6 n:i", lambda s, d: C.fold_metrics(predictions(s, d), "y", "score"), *PRED, IC, FOLDM, relation="fmet")


def models(s, d):
    return C.aggregate_folds(C.fold_metrics(predictions(s, d), "y", "score"))


AGG = "agg as (select model, avg(ic) as ic_mean, stddev_pop(ic) as ic_std, avg(ic) / stddev_pop(ic) as icir, avg(hit_rate) as hit_rate, avg(mae) as mae, avg(r2) as r2, count(*) as n_folds from fmet group by 1)"
add_query("metric_models", "model ic_mean:8 ic_std:8 icir:6 hit_rate:9 mae:6 r2:6 n_folds:i", models, *PRED, IC, FOLDM, AGG, relation="agg")
add_query("metric_deflated", "model deflated_icir:6 null_max_icir:9 credible", lambda s, d: C.deflate(models(s, d), 3), *PRED, IC, FOLDM, AGG,
          f"out as (select model, icir - {C.expected_max_normal(3)!r} / sqrt(n_folds) as deflated_icir, {C.expected_max_normal(3)!r} / sqrt(n_folds) as null_max_icir, icir > {C.expected_max_normal(3)!r} / sqrt(n_folds) as credible from agg)")
add_query("metric_selection", "model selection:6 place:i", lambda s, d: C.selection(models(s, d), 0.3), *PRED, IC, FOLDM, AGG,
          "out as (select model, icir as selection, row_number() over (order by (ic_mean > 0) desc, icir desc, ic_mean desc, model) as place from agg)")
add_query("metric_futility", "model m:8 place:i pruned", lambda s, d: C.futile(C.fold_metrics(predictions(s, d), "y", "score"), 1, 1), *PRED, IC, FOLDM,
          "mm as (select model, avg(ic) as m from fmet where fold <= 1 group by 1)",
          "out as (select model, m, row_number() over (order by m desc, model) as place, row_number() over (order by m desc, model) > 1 and (m <= 0 or (max(m) over () > 0 and m < 0.35 * max(m) over ())) as pruned from mm)")
add_query("metric_fold_by_model", "fold:i mom:8 reversal:8 calm:8", lambda s, d: C.fold_by_model(C.fold_metrics(predictions(s, d), "y", "score"), list(MODELS)), *PRED, IC, FOLDM,
          "out as (select fold, " + ", ".join(f"avg(ic) filter (model = '{m}') as {m}" for m in MODELS) + " from fmet group by 1)")
add_query("metric_priority_ic", "model fold:i univ_ic:8", fold_metrics, *PRED, "pred0 as (select * from pred where ticker < 'Brand#18')", IC.replace("from pred", "from pred0"),
          IC.replace("rk as", "rk2 as").replace("from rk", "from rk2").replace("dic as", "dic2 as").replace("from dic", "from dic2").replace("fic as", "fic2 as"),
          "out as (select model, fold, coalesce(f.ic, g.ic, 0) as univ_ic from fic2 g left join fic f using (model, fold))")
add_query(
    "metric_blend", "date:d ticker score:8", lambda s, d: FC.blend_models(predictions(s, d), models(s, d).selectExpr("model", "ic_mean as ic")), *PRED, IC, FOLDM, AGG,
    "w as (select model, case when (select sum(greatest(ic_mean, 0)) from agg) > 0 then greatest(ic_mean, 0) else 1 end as w from agg)",
    "out as (select date, ticker, sum(score * w) / sum(w) as score from pred join w using (model) group by 1, 2)",
)
add_query("metric_compare_models", "model ic:8 mae:6 r2:6 weight:8", lambda s, d: FC.compare_models(models(s, d).selectExpr("model", "ic_mean as ic", "mae", "r2")), *PRED, IC, FOLDM, AGG,
          "out as (select model, ic_mean as ic, mae, r2, case when sum(greatest(ic_mean, 0)) over () > 0 then greatest(ic_mean, 0) / sum(greatest(ic_mean, 0)) over () else 1.0 / count(*) over () end as weight from agg)")


#: Every input of the feature table.
DRIFTED = ["volume", *[c.split(":")[0] for family, names in FAMILIES.items() if family != "targets" for c in names.split()], *[f"sma_gap_{n}" for n in (10, 20, 50, 200)]]


def drifted(s, d):
    f = features(s, d)
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    return C.drift(f.filter(early).select(*DRIFTED), f.filter(~early).select(*DRIFTED), DRIFTED)


_MELT = " union all ".join(f"select '{c}' as feature, cast({c} as double) as v, cast(date < date '1998-01-01' as int) as a from feat where {c} is not null" for c in DRIFTED)
add_query(
    "metric_drift", "feature ks_stat:9 ref_n:i cur_n:i p_value:8 drift", drifted, PRICE, f"ml as ({_MELT})",
    "nn as (select feature, sum(a) as ref_n, sum(1 - a) as cur_n from ml group by 1 having sum(a) >= 30 and sum(1 - a) >= 30)",
    "cd as (select feature, v, sum(a) over (partition by feature order by v) as ca, sum(1 - a) over (partition by feature order by v) as cb from ml)",
    "ks as (select feature, max(abs(ca / ref_n - cb / cur_n)) as ks_stat, any_value(ref_n) as ref_n, any_value(cur_n) as cur_n from cd join nn using (feature) group by 1)",
    "lm as (select *, ks_stat * sqrt(ref_n * cur_n / (ref_n + cur_n)) as l from ks)",
    "pv as (select *, case when l < 0.2 then 1 else least(greatest(2 * list_sum(list_transform(range(1, 51), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * l * l))), 0), 1) end as p_value from lm)",
    "out as (select *, p_value < 0.01 as drift from pv)",
)

# -- ledger -------------------------------------------------------------------


def records(s, d):
    """Every row with a 20-day momentum is a prediction at two horizons; the
    calendar date two days later is its as-of date (often not a bar)."""
    f = features(s, d).filter("mom_20d is not null and vol_20d is not null")
    h = F.explode(F.array(F.lit(5), F.lit(21))).alias("horizon_days")
    return f.select("ticker", F.date_add("date", 2).alias("as_of"), h, F.when(F.col("volume") % 2 == 0, F.col("adj_close")).alias("entry_price"),
                    (F.col("adj_close") * 0.5).alias("band_lo"), F.when(F.col("volume") % 3 != 0, F.col("adj_close") * (1 + F.col("mom_20d") / 10)).alias("band_median"),
                    (F.col("adj_close") * 2).alias("band_hi"), F.col("mom_20d").alias("conviction"))


def recorded(s, d):
    return C.record(None, records(s, d), "rules")


LEDGER = [
    PRICE,
    "rec0 as materialized (select ticker, date + 2 as as_of, h as horizon_days, case when volume % 2 = 0 then adj_close end as entry_price, adj_close * 0.5 as band_lo, case when volume % 3 <> 0 then adj_close * (1 + mom_20d / 10) end as band_median, adj_close * 2 as band_hi, mom_20d as conviction from feat, (select unnest([5, 21]) as h) where mom_20d is not null and vol_20d is not null)",
    "rec as (select *, 'rules' as source, substring(sha1(upper(ticker) || '|' || cast(as_of as varchar) || '|' || horizon_days || '|rules'), 1, 12) as id from rec0)",
]
add_query("ledger_record", "id ticker as_of:d horizon_days:i conviction:6", lambda s, d: C.record(recorded(s, d).filter("horizon_days = 5 and as_of < date'1997-01-01'"), records(s, d), "rules"), *LEDGER,
          "out as (select * from rec where not (horizon_days = 5 and as_of < date '1997-01-01'))")
RESOLVED = [
    *LEDGER, "nb as (select ticker, date, adj_close, row_number() over (partition by ticker order by date) as no from panel)",
    "asf as materialized (select r.id, n.no, n.adj_close as px from rec r asof join nb n on n.ticker = r.ticker and r.as_of >= n.date)",
    """res as materialized (select r.*, r.id as prediction_id, n.date as matured_on, n.adj_close as terminal_price, n.adj_close / coalesce(entry_price, px) - 1 as realized_return, band_median / coalesce(entry_price, px) - 1 as forecast_return,
        n.adj_close between band_lo and band_hi as in_band from rec r join asf using (id) join nb n on n.ticker = r.ticker and n.no = asf.no + r.horizon_days)""",
    "resolved as (select *, (realized_return > 0) = coalesce(forecast_return >= 0, true) as hit from res)",
]


def resolutions(s, d):
    return C.resolve(recorded(s, d), T.panel(s, d))


add_query("ledger_resolve", "prediction_id matured_on:d terminal_price realized_return:6 forecast_return:6 hit in_band", resolutions, *RESOLVED, relation="resolved")
add_query("ledger_view", "id ticker horizon_days:i realized_return:6 hit", lambda s, d: C.ledger(recorded(s, d), resolutions(s, d)), *RESOLVED,
          "out as (select rec.id, rec.ticker, rec.horizon_days, realized_return, hit from rec left join resolved r on r.id = rec.id)")
add_query("ledger_pending", "id ticker horizon_days:i", lambda s, d: C.pending(recorded(s, d), resolutions(s, d)), *RESOLVED,
          "out as (select id, ticker, horizon_days from rec anti join resolved using (ticker, as_of, horizon_days, source))")
add_query(
    "ledger_calibration", "source horizon_days:i n:i hit_rate:9 band_coverage:9 avg_realized:6 avg_forecast:6 conviction_ic:9", lambda s, d: C.calibration_report(C.ledger(recorded(s, d), resolutions(s, d))), *RESOLVED,
    "rr as (select *, row_number() over (partition by source, horizon_days order by conviction, id) as a, row_number() over (partition by source, horizon_days order by realized_return, id) as b from resolved)",
    "out as (select source, horizon_days, count(*) as n, avg(cast(hit as int)) as hit_rate, avg(cast(in_band as int)) as band_coverage, avg(realized_return) as avg_realized, avg(forecast_return) as avg_forecast, corr(a, b) as conviction_ic from rr group by 1, 2)",
)


def hits(s, d):
    p = features(s, d).filter("mom_60d is not null").groupBy("ticker").agg(F.max_by("adj_close", F.when(F.col("date") < F.lit("1999-01-01"), F.col("date"))).alias("entry_price"), F.max_by("mom_60d", F.when(F.col("date") < F.lit("1999-01-01"), F.col("date"))).alias("score"))
    targets = T.table(s, d, "region").selectExpr("concat('h', r_regionkey) as horizon", "date_add(date'1999-01-01', r_regionkey * 300) as target_date")
    return C.horizon_hits(p, T.panel(s, d), targets)


add_query(
    "ledger_horizon_hits", "horizon target_date:d actual_date:d hit_rate:9 mean_return:6 n:i picks", lambda s, d: hits(s, d).withColumn("picks", F.array_join("top_picks", ",")), PRICE,
    "p as (select ticker, arg_max(adj_close, date) as e, arg_max(mom_60d, date) as score from feat where mom_60d is not null and date < date '1999-01-01' group by 1)",
    "t as (select 'h' || r_regionkey as horizon, date '1999-01-01' + cast(r_regionkey * 300 as int) as target_date from region)",
    "a as (select horizon, target_date, max(date) as actual_date from t, panel where date <= target_date and target_date <= (select max(date) from panel) group by 1, 2)",
    "r as (select a.*, p.ticker, score, adj_close / e - 1 as ret, row_number() over (partition by horizon order by score desc, p.ticker) as k from a join panel n on n.date = a.actual_date join p using (ticker) where e > 0)",
    "r2 as (select *, row_number() over (partition by horizon, score >= 0.003 order by score desc, ticker) as kk from r)",
    "out as (select horizon, target_date, actual_date, avg(cast((score > 0) = (ret > 0) as int)) as hit_rate, avg(ret) as mean_return, count(*) as n, string_agg(ticker, ',' order by score desc, ticker) filter (score >= 0.003 and kk <= 20) as picks from r2 group by 1, 2, 3)",
)

# -- bands and plans ----------------------------------------------------------

BUCKET = "cast(least(greatest(floor(ln(vol_20d) * 4), 10), 16) as int)"


def target_rows(s, d):
    f = features(s, d).filter("vol_20d is not null and vol_20d > 0").withColumn("bucket", F.expr(BUCKET))
    return staged(s, f"targets:{d}", lambda: FC.stack_horizons(f, (5, 20), ["date", "ticker", "bucket"]))


def model(s, d):
    return staged(s, f"bands:{d}", lambda: FC.band_model(target_rows(s, d)))


_QS = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
BANDS = [
    PRICE,
    f"lng as (select date, ticker, {BUCKET} as bucket, 5 as horizon, forward_return_5d as y from feat where vol_20d > 0 and forward_return_5d is not null union all select date, ticker, {BUCKET}, 20, forward_return_20d from feat where vol_20d > 0 and forward_return_20d is not null)",
    "cutd as (select date as c from (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from lng)) where i = floor(n * cast(0.8 as double) + 1e-9))",
    "rkd as (select *, row_number() over (partition by horizon, bucket order by y) as k, count(*) over (partition by horizon, bucket) as n from lng, cutd where date < c)",
    "bnd as (select horizon, bucket, any_value(n) as n, " + ", ".join(f"min(y) filter (k >= ceil(cast({q} as double) * n - 1e-9)) as {c}" for c, q in _QS.items()) + " from rkd group by 1, 2)",
    "csc as (select horizon, greatest(q05 - y, y - q95) as s from lng join bnd using (horizon, bucket), cutd where date >= c)",
    "crk as (select *, row_number() over (partition by horizon order by s) as k, count(*) over (partition by horizon) as n from csc)",
    "mrg as (select horizon, any_value(n) as n_cal, min(s) filter (k >= least(ceil((n + 1) * cast(0.9 as double) - 1e-9) + 1, n)) as margin from crk group by 1)",
    "cov as (select horizon, avg(cast(s <= margin as int)) as coverage from csc join mrg using (horizon) group by 1)",
    "mdl as (select b.*, n_cal, margin, coverage, q50 as median, q05 - margin as lo, q95 + margin as hi from bnd b join mrg using (horizon) join cov using (horizon))",
]
add_query("band_quantiles", "horizon:i bucket:i n:i q05:9 q25:9 q50:9 q75:9 q95:8", model, *BANDS, relation="mdl")
add_query("band_conformal", "horizon:i n_cal:i margin:8 coverage:9", lambda s, d: model(s, d).select("horizon", "n_cal", "margin", "coverage").distinct(), *BANDS, "out as (select distinct horizon, n_cal, margin, coverage from mdl)")


def latest_bands(s, d):
    f = features(s, d).filter("vol_20d is not null and vol_20d > 0").withColumn("bucket", F.expr(BUCKET))
    last = f.groupBy("ticker").agg(F.max_by(F.struct("date", "bucket", F.col("adj_close").alias("price"), "mom_60d", "mom_20d"), "date").alias("r")).select("ticker", "r.*")
    return FC.price_bounds(last, model(s, d))


LAST = [*BANDS, f"lst as (select ticker, max(date) as date, arg_max({BUCKET}, date) as bucket, arg_max(adj_close, date) as price, arg_max(mom_60d, date) as mom_60d, arg_max(mom_20d, date) as mom_20d from feat where vol_20d > 0 group by 1)",
        "pb as (select lst.*, mdl.* exclude (bucket), price * (1 + lo) as price_lo, price * (1 + median) as price_median, price * (1 + hi) as price_hi from lst join mdl using (bucket))"]
add_query("band_price_bounds", "ticker horizon:i price price_lo:3 price_median:4 price_hi:2", latest_bands, *LAST, relation="pb")
add_query("band_log_return_sample", "ticker date:d log_ret:9 back:i", lambda s, d: FC.log_return_sample(T.panel(s, d)), PRICE,
          "x as (select ticker, date, log_ret_1d as log_ret, row_number() over (partition by ticker order by date desc) as back from feat where log_ret_1d is not null)", "out as (select * from x where back <= 504)")


INPUTS = ["mom_5d", "mom_20d", "mom_60d", "vol_20d", "rsi_14", "sma_gap_50", "rel_vol_20"]
_ALL = " and ".join(f"{c} is not null" for c in INPUTS)
_IN = ", ".join(INPUTS)


def labelled(s, d):
    """(horizon, date, ticker, inputs, y) at both horizons."""
    return FC.stack_horizons(features(s, d), (5, 20), ["date", "ticker", *INPUTS])


def gated(s, d):
    return staged(s, f"gate:{d}", lambda: G.shuffled_label_gate(labelled(s, d), folds(s, d), INPUTS, "y", ("horizon",)))


_SHUFFLED = [f"y{k}" for k in range(1, G.SHUFFLES + 1)]


def _daily_ic(name, source, group):
    """Mean within-date rank correlation per group, as CTEs."""
    rank_of = lambda c: f"rank() over (partition by {group}, date order by {c}) + (count(*) over (partition by {group}, date, {c}) - 1) / 2.0"
    return [
        f"{name}_r as (select {group}, date, score, {rank_of('y')} as ry, {rank_of('score')} as rp from {source})",
        f"{name}_d as (select {group}, date, count(*) as n, corr(ry, rp) as ic, stddev_pop(score) as sd from {name}_r group by {group}, date)",
        f"{name} as (select {group}, avg(ic) as ic from {name}_d where n >= 10 and sd > 1e-12 and ic is not null and not isnan(ic) group by {group})",
    ]


GATE = [
    f"gl as materialized (select 5 as horizon, date, ticker, {_IN}, forward_return_5d as y from feat where {_ALL} and forward_return_5d is not null union all select 20, date, ticker, {_IN}, forward_return_20d from feat where {_ALL} and forward_return_20d is not null)",
    f"gtr as (select horizon, fold, {_IN}, y from gl join folds on date < train_end)",
    *ridge_ctes("wf", "gtr", ["horizon", "fold"], INPUTS, ["y"]),
    f"gts as (select horizon, fold, date, ticker, y, {score_sql(INPUTS)} as score from gl join folds on date between test_start and test_end join wf using (horizon, fold))",
    *_daily_ic("gic", "gts", "horizon, fold"),
    "gre as (select horizon, avg(coalesce(ic, 0)) as ic_mean, case when stddev_pop(coalesce(ic, 0)) > 1e-9 then avg(coalesce(ic, 0)) / stddev_pop(coalesce(ic, 0)) else 0 end as icir, count(*) as n_folds from (select distinct horizon, fold from gts) left join gic using (horizon, fold) group by 1)",
    f"gp as (select horizon, date, ticker, {_IN}, y, md5('0|' || date || '|' || ticker) as h, greatest(1, count(*) over (partition by horizon) // {G.BLOCK}) as nb from gl, folds where fold = (select max(fold) from folds) and date < train_end)",
    "gb as (select *, cast('0x' || substr(h, 1, 8) as bigint) % nb as blk from gp)",
    "gq as materialized (select *, row_number() over (partition by horizon, blk order by h, date, ticker) - 1 as pl, count(*) over (partition by horizon, blk) as sz from gb)",
    f"gf as (select horizon, blk, list(y order by pl) as fy from gq where pl < {G.SHUFFLES} group by 1, 2)",
    f"gz as materialized (select horizon, {_IN}, " + ", ".join(f"case when pl + {k} < sz then lead(y, {k}) over (partition by horizon, blk order by pl) else fy[(pl + {k}) % sz + 1] end as {y}" for k, y in enumerate(_SHUFFLED, 1)) + " from gq join gf using (horizon, blk))",
    *ridge_ctes("nl", "gz", ["horizon"], INPUTS, _SHUFFLED),
    "gfin as (select gl.* from gl, folds where fold = (select max(fold) from folds) and date between test_start and test_end)",
    "gns as (" + " union all ".join(f"select horizon, {k} as s, date, y, {score_sql(INPUTS, k - 1)} as score from gfin join nl using (horizon)" for k in range(1, G.SHUFFLES + 1)) + ")",
    *_daily_ic("gni", "gns", "horizon, s"),
    f"gnu as (select horizon, avg(coalesce(abs(ic), 0)) as shuffled_ic_mean, quantile_cont(coalesce(abs(ic), 0), 0.95) as shuffled_ic_p95, count(*) as n_shuffles from (select horizon, s from nl, range(1, {G.SHUFFLES + 1}) r(s)) left join gni using (horizon, s) group by 1)",
    "gte as (select *, abs(ic_mean) as real_abs_ic, abs(ic_mean) > shuffled_ic_p95 as passed from gre left join gnu using (horizon))",
]
add_query("gate_shuffled_labels", "horizon:i real_abs_ic:8 shuffled_ic_mean:8 shuffled_ic_p95:8 n_shuffles:i passed icir:6 n_folds:i", gated, PRICE, FOLDS, *GATE, relation="gte")


def quality(s, d):
    """Reliability of each horizon's model: its ICIR, discounted where the gate fails."""
    return gated(s, d).select("horizon", FC.reliability(F.col("icir"), F.col("passed")).alias("reliability"))


QUAL = ",\n".join([FOLDS.strip(), *GATE, "qual as (select horizon, greatest(icir, 0.05) * case when passed then 1 else cast(0.35 as double) end as reliability from gte)"])
add_query("plan_reliability", "horizon:i reliability:6", quality, PRICE, QUAL, relation="qual")


# -- bands that follow the features --------------------------------------------


def band_fit(s, d):
    """(model, margins), each written once."""
    made = {}

    def part(i):
        def build():
            made.setdefault("both", B.fitted_bands(labelled(s, d), INPUTS))
            return made["both"][i]
        return staged(s, f"fitted-bands-{i}:{d}", build)

    return part(0), part(1)


def fitted_terms(s, d):
    terms = F.array(*[F.lit(c) for c in ["one", *INPUTS]])
    return band_fit(s, d)[0].select("horizon", "quantile", "n", F.explode(F.arrays_zip(terms.alias("term"), F.col("beta").alias("value"))).alias("t")).select("horizon", "quantile", "n", "t.*")


def newest_rows(s, d):
    f = features(s, d).dropna(subset=INPUTS)
    return f.groupBy("ticker").agg(F.max_by(F.struct(F.col("adj_close").alias("price"), *INPUTS), "date").alias("r")).select("ticker", "r.*")


FITTED_BANDS = [
    PRICE, GATE[0],
    "gcut as (select date as c from (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from gl)) where i = floor(n * cast(0.8 as double) + 1e-9))",
    "gfit as materialized (select gl.* from gl, gcut where date < c)",
    *quantile_ctes("qm", "gfit", "horizon", INPUTS, FC.QUANTILES, B.STEPS, B.SHRINK, B.NARROWEST),
    f"qcal as (select horizon, date, ticker, y, list({quantile_sql(INPUTS)} order by q) as v from gl join qm using (horizon) join qm_st using (horizon), gcut where date >= c group by all)",
    "qsc as (select horizon, greatest(v[1] - y, y - list_max(v)) as s from qcal)",
    "qrk as (select *, row_number() over (partition by horizon order by s) as k, count(*) over (partition by horizon) as n from qsc)",
    "qmg as (select horizon, any_value(n) as n_cal, min(s) filter (k >= least(ceil((n + 1) * cast(0.9 as double) - 1e-9) + 1, n)) as margin from qrk group by 1)",
    "qcv as (select horizon, n_cal, margin, avg(cast(s <= margin as int)) as coverage from qsc join qmg using (horizon) group by all)",
]
add_query("band_quantiles_fitted", "horizon:i quantile:2 n:i term value:4", fitted_terms, *FITTED_BANDS,
          f"out as (select horizon, q as quantile, n, unnest([{', '.join(repr(c) for c in ['one', *INPUTS])}]) as term, unnest(b) as value from qm join qm_st using (horizon))")
add_query("band_fitted_conformal", "horizon:i n_cal:i margin:4 coverage:4", lambda s, d: band_fit(s, d)[1], *FITTED_BANDS, relation="qcv")
add_query(
    "band_fitted_price_bounds", "ticker horizon:i log_price:6 lo:3 q25:3 median:3 q75:3 hi:3",
    lambda s, d: B.price_bounds(newest_rows(s, d), *band_fit(s, d), INPUTS).withColumn("log_price", F.log("price")), *FITTED_BANDS,
    f"qnw as (select ticker, unnest(arg_max(struct_pack(price := adj_close, {', '.join(f'{c} := {c}' for c in INPUTS)}), date)) from feat where {_ALL} group by 1)",
    f"qpv as (select ticker, horizon, price, list({quantile_sql(INPUTS)} order by q) as v from qnw, qm join qm_st using (horizon) group by ticker, horizon, price)",
    "out as (select ticker, horizon, ln(price) as log_price, v[1] - margin as lo, list_max(v[1:2]) as q25, list_max(v[1:3]) as median, list_max(v[1:4]) as q75, list_max(v) + margin as hi from qpv join qmg using (horizon))",
)


def tilted(s, d):
    """Bands with the median tilted by momentum, so some names lack an edge."""
    return latest_bands(s, d).withColumn("median", F.col("median") + F.col("mom_20d") / 10)


TILT = "tlt as (select * exclude (median), median + mom_20d / 10 as median from pb)"
HOLDQ = """hq as (select *, median * 252 / horizon as annualized_edge, median / greatest(0.02, -lo) as reward_downside,
   (median * 252 / horizon) / (greatest(0.02, -lo) * sqrt(252 / cast(horizon as double))) * reliability as quality from tlt join qual using (horizon) where median > 0),
hh as (select * from (select *, row_number() over (partition by ticker order by quality desc, horizon) as k from hq) where k = 1)"""
add_query("plan_hold_horizon", "ticker horizon:i annualized_edge:6 reward_downside:6 quality:6", lambda s, d: FC.hold_horizon(tilted(s, d), quality(s, d)), *LAST, QUAL, TILT, HOLDQ, relation="hh")


def scores(s, d):
    f = features(s, d).filter("mom_20d is not null and mom_60d is not null")
    pair = F.explode(F.array(F.struct(F.lit(5).alias("horizon"), F.col("mom_20d").alias("score")), F.struct(F.lit(20).alias("horizon"), F.col("mom_60d").alias("score"))))
    return f.select("date", "ticker", pair.alias("p")).select("date", "ticker", "p.*")


CONV = "cnv as (select date, ticker, sum(z * reliability) / sum(reliability) as conviction from (select date, ticker, horizon, case when stddev_pop(score) over w > 1e-12 then (score - avg(score) over w) / stddev_pop(score) over w else 0 end as z from (select date, ticker, 5 as horizon, mom_20d as score from feat where mom_20d is not null and mom_60d is not null union all select date, ticker, 20, mom_60d from feat where mom_20d is not null and mom_60d is not null) window w as (partition by date, horizon)) join qual using (horizon) group by 1, 2)"
add_query("plan_conviction", "date:d ticker conviction:8", lambda s, d: FC.conviction(scores(s, d), quality(s, d)), PRICE, QUAL, CONV, relation="cnv")
add_query(
    "plan_longterm_picks", "ticker place:i score:6 add_on_dip_below:4 upside_pct:6 downside_pct:6 reward_risk:6",
    lambda s, d: FC.longterm_picks(latest_bands(s, d).filter("horizon = 20").selectExpr("ticker", "mom_60d as score"), latest_bands(s, d).filter("horizon = 20"), latest_bands(s, d).filter("horizon = 5"), 20), *LAST,
    "out as (select a.ticker, row_number() over (order by a.mom_60d desc, a.ticker) as place, a.mom_60d as score, least(a.price, b.price_lo) as add_on_dip_below, a.price_hi / a.price - 1 as upside_pct, a.price_lo / a.price - 1 as downside_pct, (a.price_hi - a.price) / (a.price - a.price_lo) as reward_risk from pb a join pb b on a.ticker = b.ticker and b.horizon = 5 where a.horizon = 20 and a.mom_60d > 0)",
)


def plan(s, d):
    """The newest row of every name as one book, without a cap or parity leg
    (both have their own queries)."""
    last = tilted(s, d).withColumn("date", F.lit("2001-12-01").cast("date"))
    conv = FC.conviction(scores(s, d), quality(s, d))
    newest = conv.groupBy("ticker").agg(F.max_by("conviction", "date").alias("conviction"))
    px = last_prices(s, d)
    names = newest.join(px, "ticker").withColumn("date", F.lit("2001-12-01").cast("date"))
    barred = name_lists(s, d).filter("never_buy").select("ticker", F.lit("never-buy list").alias("reason"))
    none = names.select("date", "ticker", F.lit(None).cast("double").alias("weight")).filter("weight is not null")
    return FC.invest_plan(names, last.select("date", "ticker", "horizon", "median", "lo"), quality(s, d), barred, none, F.lit(10000.0), cap=1.0)


PLAN = [
    PRICE, *BANDS[1:], *LAST[len(BANDS):], QUAL, TILT, HOLDQ, CONV,
    "nm as (select ticker, arg_max(conviction, date) as conviction from cnv group by 1)",
    "lp as (select ticker, arg_max(adj_close, date) as price from panel group by 1)",
    "pl as (select n.ticker, conviction, lp.price, horizon, annualized_edge, reward_downside, row_number() over (order by conviction desc, n.ticker) as p, case when conviction <= 0 then 'negative blended conviction' when n.ticker not in (select ticker from tlt) then 'no price bounds available' when horizon is null then 'no horizon with positive median edge' when cast(regexp_extract(n.ticker, '(\\d+)', 1) as int) % 11 = 0 then 'never-buy list' end as skipped from nm n join lp using (ticker) left join hh using (ticker))",
    "pl2 as (select *, sum(cast(skipped is null as int)) over (order by p rows unbounded preceding) as ok from pl where p <= 24)",
    "pk as (select * from pl2 where ok <= 8 and (skipped is not null or ok > 0))",
    "kw as (select ticker, price, 0.5 * reward_downside / sum(reward_downside) over () + 0.5 / count(*) over () as w from pk where skipped is null)",
    "ps as (select ticker, w / sum(w) over () as weight, floor(w / sum(w) over () * 10000 / price) as whole_shares from kw)",
    "out as (select pk.ticker, conviction, pk.horizon, skipped, weight, whole_shares from pk left join ps using (ticker))",
]
add_query("plan_invest", "ticker conviction:8 horizon:i skipped weight:8 whole_shares:i", plan, *PLAN)

# -- models -------------------------------------------------------------------

TARGET = "forward_return_20d"


def rows(s, d):
    return features(s, d).select("date", "ticker", *INPUTS, TARGET)


def walked(s, d):
    return FC.walk_forward(rows(s, d), folds(s, d), INPUTS, TARGET)


WALKED = [
    PRICE, FOLDS,
    f"wtr as (select fold, {_IN}, {TARGET} from feat join folds on date < train_end where {_ALL} and {TARGET} is not null)",
    *ridge_ctes("wm", "wtr", ["fold"], INPUTS, [TARGET]),
    f"wlk as (select fold, date, ticker, {TARGET}, {score_sql(INPUTS)} as score from feat join folds on date between test_start and test_end join wm using (fold) where {_ALL})",
]
add_query("model_walk_forward", "fold:i date:d ticker score:5", walked, *WALKED, relation="wlk")
add_query("model_walk_forward_metrics", "model fold:i ic:5 hit_rate:5 n:i", lambda s, d: C.fold_metrics(walked(s, d).withColumn("model", F.lit("ridge")), TARGET, "score"),
          *WALKED, f"pred as (select 'ridge' as model, fold, date, ticker, {TARGET} as y, score from wlk where {TARGET} is not null)", IC, FOLDM, relation="fmet")


def fitted(s, d):
    """One fit on every labelled row."""
    return FC.fit_linear(rows(s, d).withColumn("one", F.lit(1)), INPUTS, TARGET, ["one"]).drop("one")


FITTED = [PRICE, f"ftr as (select 1 as one, {_IN}, {TARGET} from feat where {_ALL} and {TARGET} is not null)", *ridge_ctes("fit", "ftr", ["one"], INPUTS, [TARGET])]
add_query(
    "model_importance", "feature importance:5", lambda s, d: FC.importance(rows(s, d), fitted(s, d), INPUTS), *FITTED,
    "out as (" + " union all ".join(f"select '{c}' as feature, avg(abs(({c} - mean[{i}]) * b_0[{i}])) as importance from feat, fit where {_ALL}" for i, c in enumerate(INPUTS, 1)) + ")",
)
add_query("model_latest_scores", "date:d ticker score:5", lambda s, d: FC.latest_scores(rows(s, d), fitted(s, d), INPUTS), *FITTED,
          f"out as (select date, ticker, {score_sql(INPUTS)} as score from feat, fit where {_ALL} and date = (select max(date) from feat))")
add_query(
    "model_stacked", "date:d ticker score:5", lambda s, d: FC.stack_models(predictions(s, d), list(MODELS), "y"), *PRED,
    "wd as (select 1 as one, date, ticker, y, " + ", ".join(f"any_value(score) filter (model = '{m}') as {m}" for m in MODELS) + " from pred group by date, ticker, y)",
    "wc as (select * from wd where " + " and ".join(f"{m} is not null" for m in MODELS) + ")", *ridge_ctes("stk", "wc", ["one"], list(MODELS), ["y"]),
    f"out as (select date, ticker, {score_sql(list(MODELS))} as score from wc join stk using (one))",
)
_PADDED = "list_concat(list_transform(range(0, 10 - least(rn, 10)), lambda i: f), w)"
add_query(
    "model_lookback_windows", "date:d ticker n:i total:4", lambda s, d: FC.lookback_windows(T.panel(s, d), ["adj_close"], 10).select("date", "ticker", F.size("window").alias("n"), F.aggregate(F.flatten("window"), F.lit(0.0), lambda a, x: a + F.log(x)).alias("total")),
    PRICE, "lw as (select date, ticker, row_number() over (partition by ticker order by date) as rn, first_value(adj_close) over (partition by ticker order by date rows 9 preceding) as f, sum(ln(adj_close)) over (partition by ticker order by date rows 9 preceding) as t from panel)",
    "out as (select date, ticker, 10 as n, t + greatest(10 - rn, 0) * ln(f) as total from lw)",
)
