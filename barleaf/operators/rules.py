"""The rule library: features in, target weights (date, ticker, weight) out.

A rule is a name, the columns it needs and a function of the feature table.
Most rules are one line over the kernels.  A rule whose columns are missing
returns weight 0 for every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.windows import back, by_ticker, ewm, held, latch, roll, span_decay
from barleaf.operators import kernels as K

Build = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rule:
    name: str
    build: Build
    needs: tuple[str, ...] = field(default=())

    def weights(self, features: DataFrame) -> DataFrame:
        if not set(self.needs) <= set(features.columns):
            return features.select("date", "ticker", F.lit(0.0).alias("weight"))
        return self.build(features)


RULES: dict[str, Rule] = {}


def rule(name: str, needs: str = "") -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        RULES[name] = Rule(name, build, tuple(needs.split()))
        return build

    return register


def rows_of(f: DataFrame, needs: str, where: str | None = None, extra: str = "") -> DataFrame:
    """Rows with every needed column present, filtered, nothing else carried."""
    cols = needs.split()
    df = f.select("date", "ticker", *cols, *[c for c in extra.split() if c not in cols]).dropna(subset=cols)
    return df.filter(where) if where else df


def pick(name: str, needs: str, k: int, every: int, score: str | None = None, where: str | None = None, ascending: bool = False, extra: str = "") -> None:
    """Top-k by a score, rebalanced every n signal dates."""
    by = score or needs.split()[0]

    def build(f: DataFrame) -> DataFrame:
        rows = rows_of(f, needs, where, extra)
        return K.rebalance_rows(rows, lambda d: K.top_k(d, by, k, ascending), f, every)

    RULES[name] = Rule(name, build, tuple(f"{needs} {extra}".split()))


def hold(name: str, needs: str, entry: str, days: int, weight: float, prepare: Build | None = None) -> None:
    """A fixed weight while any of the last n rows met the entry condition."""

    def build(f: DataFrame) -> DataFrame:
        df = prepare(f) if prepare else f
        return K.book(df, held(F.expr(entry).cast("int"), days) * weight)

    RULES[name] = Rule(name, build, tuple(needs.split()))


def switch(name: str, needs: str, enter: str, leave: str, weight: float, prepare: Build | None = None) -> None:
    """A fixed weight from an entry row until an exit row."""

    def build(f: DataFrame) -> DataFrame:
        df = prepare(f) if prepare else f
        return K.book(df, latch(F.expr(enter), F.expr(leave)) * weight)

    RULES[name] = Rule(name, build, tuple(needs.split()))


def with_columns(**cols: Callable[[], Column]) -> Build:
    return lambda f: f.select("*", *[make().alias(name) for name, make in cols.items()])


def px() -> Column:
    return F.col("adj_close")


# -- buy and hold, crossovers, rotation ---------------------------------------


def buy_and_hold(benchmark: str) -> Rule:
    def build(f: DataFrame) -> DataFrame:
        return f.select("date").distinct().select("date", F.lit(benchmark).alias("ticker"), F.lit(1.0).alias("weight"))

    return Rule("buy_and_hold", build)


def ma_crossover(benchmark: str, fast: int = 50, slow: int = 200) -> Rule:
    def build(f: DataFrame) -> DataFrame:
        b = f.filter(F.col("ticker") == benchmark).select("date", "ticker", "adj_close")
        return K.book(b, F.when(roll(F.avg, "adj_close", fast) > roll(F.avg, "adj_close", slow), 1.0).otherwise(0.0))

    return Rule("ma_crossover", build, ("adj_close",))


def ml_ranker(predictions: DataFrame, k: int = 4, every: int = 5) -> Rule:
    """Top-k by a supplied score table (date, ticker, score)."""

    def build(f: DataFrame) -> DataFrame:
        rows = predictions.select("date", "ticker", "score")
        return K.rebalance_rows(rows, lambda d: K.top_k(d, "score", k), f, every)

    return Rule("ml_ranker", build)


@rule("momentum_rotation", "mom_120d")
def _momentum_rotation(f):
    score = "mom_126d" if "mom_126d" in f.columns else "mom_120d"
    return K.rebalance_rows(rows_of(f, score), lambda d: K.top_k(d, score, 4), f, 21)


@rule("dual_momentum_absolute", "mom_12m1m")
def _dual(f):
    def weigh(d):
        best = K.rank_in_date("mom_12m1m") <= 5
        return K.book(d, F.when(best & (F.col("mom_12m1m") > 0), 0.2).otherwise(0.0))

    return K.rebalance_rows(rows_of(f, "mom_12m1m"), weigh, f, 21)


def emas(f: DataFrame, **spans: int) -> DataFrame:
    base = f.select("date", "ticker", *[c for c in ("adj_close", "atr_14", "mom_20d") if c in f.columns])
    return ewm(base, {name: ("adj_close", span_decay(span)) for name, span in spans.items()})


@rule("trend_ema_cross", "adj_close")
def _ema_cross(f):
    df = emas(f, fast=21, slow=63)
    return K.rebalance(K.book(df, F.when(F.col("fast") > F.col("slow"), 0.1).otherwise(0.0)), f, 5)


@rule("macd_crossover", "adj_close")
def _macd(f):
    df = emas(f, fast=12, slow=26).withColumn("macd", F.col("fast") - F.col("slow"))
    df = ewm(df, {"line": ("macd", span_decay(9))})
    bullish = (F.col("macd") > F.col("line")) & (F.col("macd") > 0)
    return K.rebalance(K.book(df, F.when(bullish, 1.0 / 8).otherwise(0.0)), f, 5)


@rule("keltner_breakout", "adj_close atr_14")
def _keltner(f):
    df = emas(f, mid=20)
    return K.book(df, held((px() > F.col("mid") + 2.0 * F.col("atr_14")).cast("int"), 5) * 0.08)


@rule("supertrend", "adj_close atr_14 mom_20d")
def _supertrend(f):
    df = emas(f, mid=10).withColumn("up", (px() > F.col("mid") - 3.0 * F.col("atr_14")).cast("double"))
    df = df.withColumn("score", F.when(F.col("up") == 1, F.coalesce("mom_20d", F.lit(0.0))).when(F.col("up") == 0, 0.0))

    def weigh(d):
        best = K.rank_in_date("score") <= 10
        return K.book(d, F.when(best & (F.col("up") == 1), 0.1).otherwise(0.0))

    return K.rebalance_rows(df, weigh, f, 5)


pick("triple_ma", "mom_20d sma_gap_10 sma_gap_50 sma_gap_200", 8, 5, where="sma_gap_10 > 0 and sma_gap_50 > 0 and sma_gap_200 > 0")
pick("mom_vol_filter", "mom_120d vol_20d", 6, 21, where="vol_20d < 0.35")
pick("roc_momentum", "mom_60d", 6, 21)
pick("weekly_mom_rotation", "mom_5d", 10, 5)
pick("adaptive_trend_regime", "mom_20d", 5, 10, where="bull_regime = 1", extra="bull_regime")
pick("sector_rotation_proxy", "mom_60d", 5, 21)
pick("trend_strength_filter", "mom_20d sma_gap_50 sma_gap_200", 8, 5, where="sma_gap_50 > 0 and sma_gap_200 > 0 and mom_20d > 0")
pick("vix_contrarian", "mom_20d", 8, 5, where="high_vol_regime = 0", extra="high_vol_regime")
pick("high_vol_cash", "mom_20d", 8, 5, where="high_vol_regime = 0", extra="high_vol_regime")
pick("contra_momentum_high_vol", "mom_20d", 6, 5, where="high_vol_regime = 1", ascending=True, extra="high_vol_regime")
pick("min_vol_portfolio", "vol_20d", 10, 21, ascending=True)
pick("momentum_anomaly_filter", "mom_12m1m mom_20d", 8, 21, score="mom_12m1m - 0.5D * mom_20d")
pick("acceleration_momentum", "mom_5d mom_20d", 8, 5, score="mom_5d - mom_20d / 4.0D")
pick("fractal_momentum", "mom_5d mom_20d mom_60d", 6, 10, score="mom_5d + mom_20d + mom_60d", where="mom_5d > 0 and mom_20d > 0 and mom_60d > 0")
pick("vol_normalised_momentum", "mom_60d vol_20d", 8, 21, score="mom_60d / greatest(vol_20d, 0.05D)")
pick("short_term_reversal", "mom_20d", 10, 21, ascending=True)
pick("value_factor", "sma_gap_200", 10, 21, ascending=True)
pick("size_factor", "avg_dollar_volume_20", 20, 21, where="avg_dollar_volume_20 >= 1e6", ascending=True)
pick("investment_factor", "vol_60d mom_60d", 10, 21, where="mom_60d > 0", ascending=True)
pick("index_rebalance_arb", "mom_120d", 5, 63)
pick("vol_arbitrage", "vol_20d mom_20d sma_gap_50", 8, 10, where="mom_20d > 0 and sma_gap_50 > 0", ascending=True)
pick("calendar_spread_momentum", "mom_20d mom_120d", 8, 10, score="mom_20d - mom_120d", where="mom_20d > 0")
pick("analyst_revision_proxy", "mom_20d mom_60d", 8, 21, score="mom_20d - mom_60d", where="mom_20d > 0 and mom_60d > 0")

_SIGN = "case when {0} > 0 then 1.0D else -1.0D end"


def consensus(cols: list[str]) -> str:
    return "(" + " + ".join(_SIGN.format(c) for c in cols) + f") / {len(cols)}"


_ADX = ["mom_5d", "mom_10d", "mom_20d", "mom_60d"]
pick(
    "adx_trend", " ".join(_ADX), 8, 5,
    score=f"abs({consensus(_ADX)}) * ((" + " + ".join(f"abs({c})" for c in _ADX) + ") / 4)",
    where=f"{consensus(_ADX)} > 0",
)


@rule("managed_futures_cta", "mom_10d")
def _cta(f):
    cols = [c for c in ("mom_10d", "mom_21d", "mom_63d", "mom_126d") if c in f.columns]
    rows = rows_of(f, " ".join(cols), f"{consensus(cols)} > 0")
    return K.rebalance_rows(rows, lambda d: K.top_k(d, consensus(cols), 10), f, 5)


# -- entries held for a number of rows ----------------------------------------

hold("mean_reversion", "ret_1d bull_regime", "ret_1d < -0.03 and bull_regime = 1", 5, 0.10)
hold("event_driven", "event_sentiment_mean event_novelty_max", "event_sentiment_mean > 0.3 and event_novelty_max > 0.5", 3, 0.05)
hold("breakout_20d_high", "breakout_20 rel_vol_20", "breakout_20 >= -0.005 and rel_vol_20 > 1.5", 10, 0.10)
hold("sma_stretch_reversion", "sma_gap_10", "sma_gap_10 < -0.05", 5, 0.07)
hold("drawdown_bounce", "dd_from_high_60 bull_regime", "dd_from_high_60 < -0.15 and bull_regime = 1", 10, 0.07)
hold("low_rsi_mom_combo", "rsi_14 mom_20d", "rsi_14 < 35 and mom_20d > 0", 7, 0.08)
hold("vol_breakout", "rel_vol_20 ret_1d", "rel_vol_20 > 2 and ret_1d > 0", 3, 0.07)
hold("momentum_volume_surge", "mom_20d rel_vol_20", "mom_20d > 0.05 and rel_vol_20 > 1.3", 10, 0.08)

_band = with_columns(_mid=lambda: roll(F.avg, "adj_close", 20), _sd=lambda: roll(F.stddev_samp, "adj_close", 20))
hold("bollinger_reversion", "adj_close", "adj_close <= _mid - 2 * _sd", 5, 0.08, _band)
hold("bb_breakout", "adj_close", "adj_close > _mid + 2 * _sd", 5, 0.08, _band)

_gap = with_columns(_gap=lambda: F.col("open") / back("adj_close") - 1)


def _gap_known(f: DataFrame) -> DataFrame:
    return _gap(f).filter("_gap is not null")


hold("overnight_gap_fill", "open adj_close", "_gap < -0.02", 3, 0.06, _gap)
hold("orb_proxy", "open adj_close rel_vol_20", "_gap > 0.005 and rel_vol_20 > 1.5", 3, 0.07, _gap_known)
hold("gap_fill", "open adj_close", "abs(_gap) > 0.015", 2, 0.06, _gap_known)


def _vwap(f: DataFrame) -> DataFrame:
    typical = (F.col("open") + F.col("high") + F.col("low") + px()) / 4
    df = with_columns(_pv=lambda: typical * F.col("volume"))(f)
    df = with_columns(_vwap=lambda: roll(F.sum, "_pv", 5) / (roll(F.sum, "volume", 5) + 1))(df)
    return with_columns(_dev=lambda: px() / F.col("_vwap") - 1)(df)


hold("vwap_reversion", "open high low adj_close volume", "_dev < -0.02", 3, 0.07, _vwap)


def _variance_ratio(f: DataFrame) -> DataFrame:
    df = with_columns(_two=lambda: px() / back("adj_close", 2) - 1)(f)
    return with_columns(
        _vr=lambda: roll(F.var_samp, "_two", 20) / (2 * roll(F.var_samp, "ret_1d", 20) + 1e-9)
    )(df)


hold("variance_ratio_pairs", "ret_1d adj_close", "_vr < 0.9 and ret_1d < -0.01", 5, 0.07, _variance_ratio)


def date_mean(f: DataFrame, column: str, name: str) -> DataFrame:
    """Attach the date mean: partial aggregate by date, joined back by date."""
    return f.join(f.groupBy("date").agg(F.avg(column).alias(name)), "date")


hold(
    "hf_mean_reversion", "ret_1d mom_5d", "ret_1d < -0.04 and coalesce(_up, false)", 2, 0.06,
    lambda f: date_mean(f.select("date", "ticker", "ret_1d", "mom_5d"), "mom_5d", "_m").withColumn("_up", F.col("_m") > 0),
)


@rule("event_momentum_confluence", "mom_20d rel_vol_20")
def _confluence(f):
    first = "event_sentiment_mean > 0.2" if "event_sentiment_mean" in f.columns else "rel_vol_20 > 1.5"
    return K.book(f, held(F.expr(f"{first} and mom_20d > 0.02").cast("int"), 5) * 0.09)


@rule("cross_sectional_reversal", "ret_1d")
def _reversal(f):
    df = rows_of(f, "ret_1d").withColumn("_prior", back("ret_1d")).filter("_prior is not null")
    df = df.withColumn("_in", (K.rank_in_date("_prior", ascending=True) <= 8).cast("int"))
    return K.book(df, held(F.col("_in"), 5) * 0.10)


# -- latches ------------------------------------------------------------------

switch("rsi_oversold_bounce", "rsi_14", "rsi_14 < 30", "rsi_14 > 50", 0.08)
switch(
    "turtle_donchian", "high low close", "close >= _hi", "close <= _lo", 0.08,
    with_columns(_hi=lambda: roll(F.max, "high", 20), _lo=lambda: roll(F.min, "low", 10)),
)
switch("zscore_reversion", "adj_close", "(adj_close - _mid) / (_sd + 1e-8) < -2", "(adj_close - _mid) / (_sd + 1e-8) > 0", 0.08, _band)


def _stochastic(f: DataFrame) -> DataFrame:
    df = with_columns(_lo=lambda: roll(F.min, "low", 14), _hi=lambda: roll(F.max, "high", 14))(f)
    return with_columns(_k=lambda: F.expr("(adj_close - _lo) / (_hi - _lo + 1e-8) * 100"))(df)


switch("stochastic_reversion", "high low adj_close", "_k < 20", "_k > 80", 0.07, _stochastic)


def _cci(f: DataFrame) -> DataFrame:
    df = with_columns(_tp=lambda: (F.col("high") + F.col("low") + px()) / 3)(f)
    df = with_columns(_m=lambda: roll(F.avg, "_tp", 20), _s=lambda: roll(F.stddev_samp, "_tp", 20))(df)
    return with_columns(_cci=lambda: F.expr("(_tp - _m) / (0.015D * _s + 1e-8)"))(df)


switch("cci_reversion", "high low adj_close", "_cci < -100", "_cci > 100", 0.07, _cci)


@rule("etf_mean_reversion", "mom_20d")
def _etf(f):
    df = f.select("date", "ticker", "mom_20d")
    side = df.groupBy("date").agg(F.avg("mom_20d").alias("_m"), F.stddev_samp("mom_20d").alias("_s"))
    df = df.join(side, "date").withColumn("_z", F.expr("(mom_20d - _m) / (_s + 1e-8)"))
    return K.book(df, latch(F.expr("_z < -1.5"), F.expr("_z > 0.5")) * 0.10)


# -- sized books --------------------------------------------------------------


@rule("time_series_momentum", "mom_120d")
def _tsm(f):
    best = K.rank_in_date("abs(mom_120d)") <= 15
    return K.book(rows_of(f, "mom_120d"), F.when(best & (F.col("mom_120d") > 0), 0.067).otherwise(0.0))


def strongest(f: DataFrame, needs: str, k: int) -> DataFrame:
    """Only the k best names by mom_20d of each date (a group limit in the plan)."""
    return rows_of(f, needs).withColumn("_rk", K.rank_in_date("mom_20d")).filter(F.col("_rk") <= k)


@rule("risk_parity_vol_target", "vol_20d mom_20d")
def _risk_parity(f):
    return K.rebalance(K.inverse_share(strongest(f, "vol_20d mom_20d", 20), F.col("vol_20d"), 0.05, 0.15), f, 21)


@rule("atr_position_sizing", "mom_20d atr_14 adj_close")
def _atr(f):
    df = strongest(f, "mom_20d atr_14 adj_close", 10)
    return K.rebalance(K.inverse_share(df, F.col("atr_14") / px(), 0.005, 0.15), f, 10)


@rule("mkt_cap_weighted_mom", "mom_20d avg_dollar_volume_20")
def _cap_weighted(f):
    df = strongest(f, "mom_20d avg_dollar_volume_20", 10)
    return K.rebalance(K.share(df, F.col("avg_dollar_volume_20"), 0.20), f, 21)


@rule("equal_risk_contribution", "vol_60d mom_20d")
def _erc(f):
    return K.rebalance(K.inverse_share(strongest(f, "vol_60d mom_20d", 15), F.col("vol_60d"), 0.05, 0.15), f, 21)


@rule("vol_targeting", "mom_20d vol_20d")
def _vol_targeting(f):
    def weigh(d):
        df = d.withColumn("_w", F.when(K.rank_in_date("mom_20d") <= 10, 0.1).otherwise(0.0))
        mean = F.avg(F.when(F.col("_w") > 0, F.col("vol_20d"))).over(Window.partitionBy("date"))
        scale = F.least(F.greatest(0.15 / (mean + 1e-8), F.lit(0.5)), F.lit(2.0))
        return K.book(df, F.least(F.greatest(F.col("_w") * scale, F.lit(0.0)), F.lit(0.20)))

    return K.rebalance_rows(rows_of(f, "mom_20d vol_20d"), weigh, f, 5)


# -- rank blends --------------------------------------------------------------


def blend(name: str, needs: str, ranks: dict[str, bool], combine: str, k: int, every: int, after: str | None = None) -> None:
    """Lowest combined rank wins; ``ranks`` maps column to ascending order.

    ``after`` filters once the ranks are taken, so it decides the signal dates
    and names but not the ranks themselves.
    """

    def build(f: DataFrame) -> DataFrame:
        rows = rows_of(f, needs)

        def weigh(d):
            d = d.select("*", *[K.rank_in_date(c, up).alias(f"r_{c}") for c, up in ranks.items()])
            d = d.withColumn("_score", F.expr(combine))
            return K.top_k(d.filter(after) if after else d, "_score", k, ascending=True)

        if after is None:
            return K.rebalance_rows(rows, weigh, f, every)
        passing = rows.filter(after)
        kept = K.kept_dates(passing, every)
        sparse = weigh(rows.join(kept.select("date"), "date", "left_semi"))
        return K.hold_between(sparse, passing.select("ticker").distinct(), kept, f)

    RULES[name] = Rule(name, build, tuple(needs.split()))


blend("mom_quality_combo", "mom_20d avg_dollar_volume_20", {"mom_20d": False, "avg_dollar_volume_20": False}, "r_mom_20d + r_avg_dollar_volume_20", 8, 10)
blend("momentum_value_mix", "mom_120d sma_gap_200", {"mom_120d": False, "sma_gap_200": True}, "0.6D * r_mom_120d + 0.4D * r_sma_gap_200", 8, 21)
blend("quality_factor", "vol_20d avg_dollar_volume_20 sma_gap_50", {"vol_20d": True, "avg_dollar_volume_20": False}, "(r_vol_20d + r_avg_dollar_volume_20) / 2.0D", 10, 21, after="sma_gap_50 > 0")
blend("quality_minus_junk", "vol_20d avg_dollar_volume_20 mom_20d", {"vol_20d": True, "avg_dollar_volume_20": False, "mom_20d": False}, "r_vol_20d + r_avg_dollar_volume_20 + r_mom_20d", 10, 21)
blend(
    "multi_factor_5", "mom_20d sma_gap_200 vol_20d avg_dollar_volume_20",
    {"mom_20d": False, "sma_gap_200": True, "vol_20d": True, "avg_dollar_volume_20": False},
    "r_mom_20d + r_sma_gap_200 + r_vol_20d + r_avg_dollar_volume_20", 10, 21,
)


@rule("low_vol_momentum", "mom_20d vol_20d")
def _low_vol(f):
    df = rows_of(f, "mom_20d vol_20d")
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy("date")))
    df = df.withColumn("_rk", K.rank_in_date("vol_20d", ascending=True)).filter("_rk <= cast(_n * 0.4D as int)")
    return K.rebalance(K.top_k(df, "mom_20d", 8), f, 21)


@rule("trend_plus_reversion", "mom_20d rsi_14")
def _trend_and_reversion(f):
    rows = f.select("date", "ticker", "mom_20d", "rsi_14")

    def weigh(d):
        trend = F.when(K.rank_in_date("mom_20d") <= 5, 0.1).otherwise(0.0)
        back_up = F.when((K.rank_in_date("rsi_14", ascending=True) <= 5) & (F.col("rsi_14") < 35), 0.1).otherwise(0.0)
        d = d.select("*", trend.alias("_t"), back_up.alias("_r"))
        return K.book(d.filter("mom_20d is not null"), F.col("_t") + F.col("_r"))

    signal = rows.filter("mom_20d is not null")
    kept = K.kept_dates(signal, 10)
    sparse = weigh(rows.join(kept.select("date"), "date", "left_semi"))
    return K.hold_between(sparse, signal.select("ticker").distinct(), kept, f)


@rule("multi_hold_blend", "mom_5d mom_20d mom_60d")
def _multi_hold(f):
    rows = f.select("date", "ticker", "mom_5d", "mom_20d", "mom_60d")

    def weigh(d):
        parts = [F.when(K.rank_in_date(c) <= 5, 0.2).otherwise(0.0) for c in ("mom_5d", "mom_20d", "mom_60d")]
        d = d.select("date", "ticker", *[p.alias(f"_{i}") for i, p in enumerate(parts)])
        return K.book(d, (F.col("_0") + F.col("_1") + F.col("_2")) / 3)

    return K.rebalance_rows(rows, weigh, f, 5)


# -- cross-section scores -----------------------------------------------------


def scored(name: str, needs: str, score: Callable[[], Column], k: int, every: int, where: str | None = None, prepare: Build | None = None) -> None:
    """Top-k by a score that itself needs cross-section windows."""

    def build(f: DataFrame) -> DataFrame:
        rows = rows_of(f, needs, where)
        rows = prepare(rows) if prepare else rows
        return K.rebalance_rows(rows, lambda d: K.top_k(d.withColumn("_score", score()), "_score", k), f, every)

    RULES[name] = Rule(name, build, tuple(needs.split()))


scored(
    "cross_sectional_rankz", "mom_20d mom_60d vol_20d rsi_14",
    lambda: K.standardised("mom_20d") + K.standardised("mom_60d") - K.standardised("vol_20d") - K.standardised("rsi_14"), 8, 10,
)
scored(
    "adaptive_regime_blend", "mom_20d rsi_14 high_vol_regime",
    lambda: F.when(F.col("high_vol_regime") == 1, 0.3).otherwise(0.7) * K.standardised("mom_20d")
    - F.when(F.col("high_vol_regime") == 1, 0.7).otherwise(0.3) * K.standardised("rsi_14"), 6, 5,
)
scored(
    "liquidity_weighted_momentum", "mom_20d avg_dollar_volume_20",
    lambda: 0.5 * K.standardised("mom_20d") + 0.5 * K.standardised("_liq"), 8, 10,
    where="avg_dollar_volume_20 > 5e6",
    prepare=with_columns(_liq=lambda: F.log("avg_dollar_volume_20")),
)

# -- two disjoint regimes ranked separately in one window ---------------------


def regimes(rows: DataFrame, risk_on: Column, on: tuple[str, int], off: tuple[str, int]) -> tuple[DataFrame, K.Weigher]:
    """Best ``on`` names while risk is on, lowest ``off`` names while it is off."""
    score = F.when(F.col("_on"), F.col(on[0])).otherwise(-F.col(off[0]))
    size = F.when(F.col("_on"), on[1]).otherwise(off[1])
    df = rows.withColumn("_on", risk_on).filter("_on is not null").withColumn("_score", score).filter("_score is not null")

    def weigh(d):
        return K.book(d, F.when(K.rank_in_date("_score", by=("date", "_on")) <= size, 1.0 / size).otherwise(0.0))

    return df, weigh


@rule("regime_switching_momentum", "bull_regime mom_20d vol_20d")
def _regime_switch(f):
    rows = f.select("date", "ticker", "bull_regime", "mom_20d", "vol_20d")
    df, weigh = regimes(rows, F.col("bull_regime") == 1, ("mom_20d", 6), ("vol_20d", 5))
    return K.rebalance_rows(df, weigh, f, 10)


@rule("global_macro_trend", "bull_regime high_vol_regime mom_60d vol_20d")
def _global_macro(f):
    rows = f.select("date", "ticker", "bull_regime", "high_vol_regime", "mom_60d", "vol_20d")
    on = (F.col("bull_regime") == 1) & (F.col("high_vol_regime") == 0)
    df, weigh = regimes(rows, on, ("mom_60d", 8), ("vol_20d", 5))
    return K.rebalance_rows(df, weigh, f, 21)


@rule("yield_curve_adaptive", "mom_20d vol_20d")
def _yield_curve(f):
    """Curve sign picks the regime; plain momentum where no curve was joined."""
    curve = next((c for c in ("yield_curve_10y2y", "macro_yield_curve") if c in f.columns), None)
    if curve is None:
        return K.rebalance_rows(rows_of(f, "mom_20d"), lambda d: K.top_k(d, "mom_20d", 6), f, 21)
    rows = f.select("date", "ticker", "mom_20d", "vol_20d", curve)
    df, weigh = regimes(rows, F.col(curve) >= 0, ("mom_20d", 6), ("vol_20d", 6))
    return K.rebalance_rows(df, weigh, f, 21)


# -- long and short -----------------------------------------------------------


def two_sided(name: str) -> None:
    RULES[name] = Rule(
        name,
        lambda f: K.rebalance_rows(rows_of(f, "mom_20d"), lambda d: K.long_short(d, "mom_20d", 8), f, 10),
        ("mom_20d",),
    )


two_sided("market_neutral_momentum")
two_sided("long_short_equity")

# -- ticker windows feeding a cross-section pick ------------------------------


def windowed(name: str, needs: str, prepare: Build, score: str, k: int, every: int, where: str | None = None) -> None:
    """A per-ticker window column first, then filter and top-k by date."""

    def build(f: DataFrame) -> DataFrame:
        rows = prepare(f)
        rows = rows.filter(where) if where else rows
        return K.rebalance_rows(rows, lambda d: K.top_k(d, score, k), f, every)

    RULES[name] = Rule(name, build, tuple(needs.split()))


_MOM = "coalesce(mom_20d, 0.0D)"
_top252 = with_columns(_near=lambda: px() / roll(F.max, "adj_close", 252, 100) - 1)
_excess_sum = with_columns(_rs=lambda: roll(F.sum, "excess_ret_1d", 63, 20))

windowed("52wk_high_momentum", "adj_close", _top252, "_near", 8, 21, "_near >= -0.05")
windowed("merger_arb_proxy", "adj_close", _top252, "_near", 5, 21, "_near between -0.15 and 0")
windowed("profitability_factor", "excess_ret_1d mom_20d", _excess_sum, "_rs", 10, 21, "_rs is not null and mom_20d > 0")
windowed("relative_strength_rotation", "excess_ret_1d", _excess_sum, "_rs", 8, 21, "_rs is not null")
windowed("carry_factor", "excess_ret_1d", with_columns(_c=lambda: roll(F.avg, "excess_ret_1d", 63, 20)), "_c", 10, 21, "_c is not null")
windowed(
    "relative_momentum_spread", "excess_ret_1d",
    lambda f: with_columns(
        _cum=lambda: F.sum("excess_ret_1d").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    )(rows_of(f, "excess_ret_1d")),
    "_cum", 8, 5,
)


def _ichimoku(f: DataFrame) -> DataFrame:
    def middle(n):
        return (roll(F.max, "high", n) + roll(F.min, "low", n)) / 2

    return with_columns(_t=lambda: middle(9), _k=lambda: middle(26))(f)


windowed("ichimoku_proxy", "high low adj_close", _ichimoku, "_t / _k - 1", 8, 5, "_t > _k and adj_close > greatest(_t, _k)")


def _sar(f: DataFrame) -> DataFrame:
    df = with_columns(_hi=lambda: roll(F.max, "high", 5))(f)
    return with_columns(_level=lambda: back("_hi") * 0.98)(df)


windowed("parabolic_sar_proxy", "high adj_close mom_20d", _sar, _MOM, 8, 5, "adj_close > _level")


def _heikin(f: DataFrame) -> DataFrame:
    body = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    df = with_columns(_bull=lambda: (body > (back("open") + back("close")) / 2).cast("int"))(f)
    return with_columns(_streak=lambda: roll(F.sum, "_bull", 3))(df)


windowed("heikin_ashi_trend", "open high low close mom_20d", _heikin, _MOM, 8, 5, "_streak >= 3")
windowed(
    "earnings_momentum", "rel_vol_20 ret_1d mom_20d",
    with_columns(_in=lambda: held(F.expr("rel_vol_20 > 2.5 and ret_1d > 0.02").cast("int"), 15)),
    _MOM, 6, 5, "_in = 1",
)


def _pead(f: DataFrame) -> DataFrame:
    event = F.expr("rel_vol_20 > 3 and abs(ret_1d) > 0.03")
    df = with_columns(_event=lambda: event.cast("int"))(f)
    positive = latch(F.expr("_event = 1 and ret_1d > 0"), F.expr("_event = 1 and not ret_1d > 0"))
    return with_columns(_drift=lambda: held(F.col("_event"), 20), _up=lambda: positive)(df)


windowed("pead", "rel_vol_20 ret_1d mom_20d", _pead, _MOM, 6, 5, "_drift * _up > 0")
windowed(
    "dispersion_trading", "high_vol_regime vol_20d mom_20d",
    lambda f: date_mean(f.filter("high_vol_regime = 0").select("date", "ticker", "vol_20d", "mom_20d"), "vol_20d", "_m"),
    _MOM, 8, 10, "vol_20d > _m",
)

_VOTES = ["mom_20d > 0", "sma_gap_50 > 0", "rsi_14 > 40 and rsi_14 < 70", "vol_20d < 0.30", "mom_60d > 0"]
windowed(
    "ensemble_voting", "mom_20d sma_gap_50 rsi_14 vol_20d mom_60d",
    lambda f: f.select("date", "ticker", F.expr(" + ".join(f"case when {v} then 1.0D else 0.0D end" for v in _VOTES)).alias("_v")),
    "_v / 5", 8, 5,
)


@rule("news_sentiment", "mom_20d")
def _news(f):
    """Sentiment scaled by momentum, or a volume-day proxy without sentiment."""
    given = next((c for c in ("sentiment", "event_sentiment_mean") if c in f.columns), None)
    if given:
        rows = f.filter(F.col(given).isNotNull()).withColumn("_s", F.expr(f"{given} * (1 + {_MOM})"))
    else:
        hit = F.expr("rel_vol_20 > 2 and ret_1d > 0.01")
        rows = f.withColumn("_s", F.when(hit, F.expr(_MOM)).when(~hit, 0.0))
    rows = rows.select("date", "ticker", "_s")
    return K.rebalance_rows(rows, lambda d: K.top_k(d, "_s", 8), f, 5)
