"""Price feature queries: one per family, all over the written feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barleaf.operators import catalog, prices
from barleaf.plans.basesql import PRICE
from barleaf.plans.registry import add_query
from barleaf.session import staged
from barleaf.sources.tables import BENCHMARK, panel


def features(spark: SparkSession, folder: str) -> DataFrame:
    """The price feature table, computed once per application and read back."""
    return staged(spark, f"price:{folder}", lambda: prices.price_features(panel(spark, folder), BENCHMARK))


FAMILIES = {
    "returns": "ret_1d:6 log_ret_1d:8 overnight_gap:6",
    "momentum": "mom_5d:6 mom_10d:6 mom_20d:6 mom_60d:6 mom_120d:6 mom_12m1m:6 mom_accel:6",
    "volatility": "vol_10d:6 vol_20d:6 vol_60d:6 downside_vol_20d:5 downside_vol_60d:5 vol_of_vol_60:6",
    "range": "atr_14:4 dd_from_high_60:8 breakout_20:8 breakdown_20:6",
    "liquidity": "rel_vol_20:8 avg_dollar_volume_20:2 amihud_illiq_20:4 volume_z_60:6",
    "rsi": "rsi_14:6",
    "moments": "ret_skew_60:5 ret_kurt_60:5",
    "trend_shape": "dist_52w_high:8 dist_52w_low:6 bb_pctb_20:6 max_dd_252:8",
    "benchmark": "bench_ret_1d:6 excess_ret_1d:6 beta_60:5 corr_bench_60:5",
    "regime": "bull_regime:i high_vol_regime:i mom_20d_rank:9",
    "targets": "forward_return_5d:6 forward_return_20d:6",
}

for _name, _cols in FAMILIES.items():
    add_query(f"features_{_name}", f"date:d ticker {_cols}", features, PRICE, relation="feat")

_N = (10, 20, 50, 200)
# means of unit prices often end in a 5; logs keep the comparison off such ties
_LOGS = [f"ln(sma_{n}) as log_sma_{n}" for n in _N]
add_query(
    "features_averages", "date:d ticker " + " ".join(f"log_sma_{n}:9 sma_gap_{n}:6" for n in _N),
    lambda s, d: features(s, d).selectExpr("*", *_LOGS),
    PRICE, f"out as (select *, {', '.join(_LOGS)} from feat)",
)
add_query(
    "features_neutral_target", "date:d ticker neutral:5",
    lambda s, d: prices.demean_by_date(features(s, d).filter("forward_return_20d is not null"), "forward_return_20d", "neutral"),
    PRICE,
    "out as (select date, ticker, forward_return_20d - avg(forward_return_20d) over (partition by date) as neutral from feat where forward_return_20d is not null)",
)

# -- the catalog --------------------------------------------------------------

# Names a trainer may ask for, by family; the price table holds all but the last family.
CATALOG = {
    "volatility": ["vol_10d", "vol_20d", "vol_60d", "atr_14", "downside_vol_20d", "downside_vol_60d", "vol_of_vol_60", "ret_skew_60", "ret_kurt_60", "max_dd_252", "dd_from_high_60"],
    "liquidity": ["rel_vol_20", "avg_dollar_volume_20", "amihud_illiq_20", "volume_z_60", "overnight_gap"],
    "mean_reversion": ["rsi_14"],
    "regime": ["bull_regime", "high_vol_regime", "mom_20d_rank", "excess_ret_1d", "beta_60", "corr_bench_60"],
    "news": ["news_tone", "news_tone_mom", "news_buzz"],
}
_HELD = [(g, c) for g, names in CATALOG.items() for c in names if g != "news"]
add_query(
    "catalog_resolved", "family feature filled:9", lambda s, d: catalog.resolved(features(s, d), CATALOG), PRICE,
    "cv as (" + " union all ".join(f"select '{g}' as family, '{c}' as feature, count({c}) / count(*) as filled from feat" for g, c in _HELD) + ")",
    "out as (select * from cv where filled >= 0.6)",
)
add_query(
    "catalog_report", "family defined:i present:i names n_rows:i",
    lambda s, d: catalog.report(features(s, d), CATALOG).withColumn("names", F.array_join("columns", ",")).withColumn("n_rows", features(s, d).agg(F.count("*")).scalar()), PRICE,
    "cf as (select * from (values " + ", ".join(f"('{g}', {len(names)}, {0 if g == 'news' else len(names)}, '{'' if g == 'news' else ','.join(names)}')" for g, names in CATALOG.items()) + ") v(family, defined, present, names))",
    "out as (select cf.*, (select count(*) from feat) as n_rows from cf)",
)
