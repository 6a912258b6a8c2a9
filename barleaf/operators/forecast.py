"""Return bands, plans, and models fitted from sums.

Linear models are fitted from partial sums: each task adds up the products of
its rows, the sums meet per fold or date, and only the small normal equations
are solved, one per fold, in an Arrow group of a few dozen numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.ranking import distinct_counts, running
from barleaf.operators.sizing import BOOK, band_sized

QUANTILES = (0.05, 0.25, 0.50, 0.75, 0.95)


def stack_horizons(df: DataFrame, horizons: Sequence[int], keep: Sequence[str], prefix: str = "forward_return_") -> DataFrame:
    """Long targets: one row per (row, horizon) with a known return."""
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"{prefix}{h}d").alias("y")) for h in horizons]))
    return df.select(*keep, pairs.alias("_p")).select(*keep, "_p.*").filter("y is not null")


# -- bands --------------------------------------------------------------------


def q_name(q: float) -> str:
    return f"q{round(q * 100):02d}"


def quantile_bands(train: DataFrame, by: tuple[str, ...] = ("horizon", "bucket"), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact conditional quantiles of y per bucket (the ceil(q n)-th value).

    Ranks come from the split running counts, so one bucket may be any size;
    quantiles are made monotone by a running maximum.
    """
    counts = running(distinct_counts(train, "y", by), "y", ["_n"], by)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    placed = counts.join(sizes, list(by))
    picks = [F.min(F.when(F.col("upto__n") >= F.ceil(F.lit(q) * F.col("n") - 1e-9), F.col("y"))).alias(q_name(q)) for q in quantiles]
    out = placed.groupBy(*by).agg(F.first("n").alias("n"), *picks)
    return monotone(out, [q_name(q) for q in quantiles])


def monotone(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each quantile at least the one before it."""
    return df.withColumns({c: F.greatest(*[F.col(x) for x in columns[: i + 1]]) if i else F.col(c) for i, c in enumerate(columns)})


def conformal_margin(calibration: DataFrame, bands: DataFrame, alpha: float = 0.10, by: tuple[str, ...] = ("horizon", "bucket")) -> DataFrame:
    """Margin per horizon: the order statistic of max(lo - y, y - hi) at the
    finite-sample level, taking the higher neighbour, and the coverage it gives."""
    lo, hi = F.col(q_name(QUANTILES[0])), F.col(q_name(QUANTILES[-1]))
    rows = calibration.join(bands, list(by)).withColumn("score", F.greatest(lo - F.col("y"), F.col("y") - hi)).select("horizon", "score")
    counts = running(distinct_counts(rows, "score", ("horizon",)), "score", ["_n"], ("horizon",))
    sizes = counts.groupBy("horizon").agg(F.sum("_n").alias("n"))
    k = F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9)
    position = F.least(k + 1, F.col("n"))
    placed = counts.join(sizes, "horizon")
    return placed.groupBy("horizon").agg(
        F.first("n").alias("n_cal"), F.min(F.when(F.col("upto__n") >= position, F.col("score"))).alias("margin")
    ).join(counts, "horizon").groupBy("horizon", "n_cal", "margin").agg(
        (F.sum(F.when(F.col("score") <= F.col("margin"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("coverage")
    )


def split_date(df: DataFrame, fraction: float = 0.2) -> Column:
    """First date of the last ``fraction`` of the calendar, as a scalar."""
    dates = df.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return dates.filter(F.col("i") == F.floor(F.col("n") * (1 - fraction) + 1e-9)).select("date").scalar()


def band_model(rows: DataFrame, alpha: float = 0.10, fraction: float = 0.2) -> DataFrame:
    """Calibrated band per (horizon, bucket) from long rows (date, bucket, horizon, y)."""
    at = split_date(rows, fraction)
    bands = quantile_bands(rows.filter(F.col("date") < at))
    margin = conformal_margin(rows.filter(F.col("date") >= at), bands, alpha)
    lo, hi = q_name(QUANTILES[0]), q_name(QUANTILES[-1])
    return bands.join(margin, "horizon").withColumns(
        {"median": F.col("q50"), "lo": F.col(lo) - F.col("margin"), "hi": F.col(hi) + F.col("margin")}
    )


def price_bounds(latest: DataFrame, model: DataFrame) -> DataFrame:
    """Bands around the last price of each name's bucket, per horizon."""
    df = latest.join(model, "bucket")
    marks = {f"price_{c}": F.col("price") * (1 + F.col(c)) for c in ("lo", "q25", "median", "q75", "hi")}
    return df.withColumns(marks)


def log_return_sample(prices: DataFrame, n: int = 504, least: int = 30) -> DataFrame:
    """The last n daily log returns per ticker, where at least 30 exist."""
    w = Window.partitionBy("ticker")
    step = F.log(F.col("adj_close") / F.lag("adj_close").over(w.orderBy("date")))
    rows = prices.select("ticker", "date", step.alias("log_ret")).filter("log_ret is not null")
    rows = rows.withColumn("back", F.row_number().over(w.orderBy(F.desc("date")))).filter(F.col("back") <= n)
    return rows.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least).drop("_n")


# -- plans --------------------------------------------------------------------

HOLD_LABELS = {5: "~1 week", 21: "~1 month", 63: "~3 months", 126: "~6 months", 252: "~12 months"}


def reliability(icir: Column, leak_pass: Column) -> Column:
    return F.greatest(F.coalesce(icir, F.lit(0.0)), F.lit(0.05)) * F.when(leak_pass, 1.0).otherwise(0.35)


def hold_horizon(bands: DataFrame, quality: DataFrame, by: tuple[str, ...] = ("ticker",), floor: float = 0.02) -> DataFrame:
    """Horizon with the best annualised edge per downside, weighted by model
    reliability; only horizons with a positive median qualify."""
    year = 252.0 / F.col("horizon")
    edge = F.col("median") * year
    fall = F.greatest(F.lit(floor), -F.col("lo"))
    df = bands.filter(F.col("median") > 0).join(quality.select("horizon", "reliability"), "horizon", "left")
    df = df.withColumns(
        {
            "annualized_edge": edge,
            "reward_downside": F.col("median") / fall,
            "quality": edge / (fall * F.sqrt(year)) * F.coalesce("reliability", F.lit(0.05)),
        }
    )
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by(F.struct(*rest), F.struct("quality", -F.col("horizon"))).alias("_b")
    return df.groupBy(*by).agg(pick).select(*by, "_b.*")


def conviction(scores: DataFrame, quality: DataFrame, by=BOOK) -> DataFrame:
    """Reliability-weighted mean over horizons of the population z of each score."""
    book = Window.partitionBy(*by, "horizon")
    mean, spread = F.avg("score").over(book), F.stddev_pop("score").over(book)
    z = F.col("_z")
    df = scores.withColumn("_z", F.when(spread > 1e-12, (F.col("score") - mean) / spread).otherwise(0.0)).join(quality.select("horizon", "reliability"), "horizon")
    weighted = F.sum(z * F.col("reliability")) / F.sum("reliability")
    return df.groupBy(*by, "ticker").agg(weighted.alias("conviction"))


def longterm_picks(scores: DataFrame, bounds: DataFrame, near: DataFrame, n: int = 20, min_score: float = 0.0) -> DataFrame:
    """Ranked buys with targets, stop, reward to risk and a dip level.

    ``bounds`` and ``near`` carry the price band of the plan's horizon and of
    the one-month horizon.
    """
    df = scores.filter(F.col("score") > min_score).join(bounds.select("ticker", "price", "price_lo", "price_median", "price_hi"), "ticker")
    df = df.join(near.select("ticker", F.col("price_lo").alias("_dip")), "ticker", "left").filter("price > 0")
    risk = F.col("price") - F.col("price_lo")
    df = df.withColumns(
        {
            "add_on_dip_below": F.least("price", F.coalesce("_dip", F.col("price") * 0.92)),
            "upside_pct": F.col("price_hi") / F.col("price") - 1,
            "downside_pct": F.col("price_lo") / F.col("price") - 1,
            "reward_risk": F.when(risk > 1e-9, (F.col("price_hi") - F.col("price")) / risk),
            "place": F.row_number().over(Window.orderBy(F.desc("score"), "ticker")),
        }
    )
    return df.filter(F.col("place") <= n).drop("_dip")


def invest_plan(names: DataFrame, bands: DataFrame, quality: DataFrame, barred: DataFrame, parity: DataFrame, deployable: Column, top: int = 8, pool: int = 24, cap: float = 0.25, min_position: float = 50.0) -> DataFrame:
    """Names (date, ticker, conviction, price) to sized positions or a reason.

    The pool is the strongest names by conviction; one is skipped for negative
    conviction, no band, no horizon with a positive median, or a compliance
    reason, and the first ``top`` left are sized.  One row per pool name.
    """
    from barleaf.operators.sizing import blend, to_positions

    order = Window.partitionBy("date").orderBy(F.desc("conviction"), "ticker")
    df = names.filter("price > 0").withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= max(top * 3, pool))
    any_band = bands.select("date", "ticker").distinct().withColumn("_has", F.lit(True))
    chosen = hold_horizon(bands, quality, ("date", "ticker"))
    df = df.join(any_band, ["date", "ticker"], "left").join(chosen, ["date", "ticker"], "left").join(barred.select("ticker", "reason"), "ticker", "left")
    why = (
        F.when(F.col("conviction") <= 0, "negative blended conviction")
        .when(F.col("_has").isNull(), "no price bounds available")
        .when(F.col("horizon").isNull(), "no horizon with positive median edge")
        .when(F.col("reason").isNotNull(), F.col("reason"))
    )
    df = df.withColumn("skipped", why)
    df = df.withColumn("_ok", F.sum(F.when(F.col("skipped").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.filter(F.col("_ok") <= top).filter(F.col("skipped").isNotNull() | (F.col("_ok") > 0))
    picked = df.filter("skipped is null")
    kelly = picked.select("date", "ticker", F.greatest(F.lit(0.0), F.col("reward_downside")).alias("score"))
    weights = blend(kelly, parity, 0.5, cap).join(picked.select("date", "ticker", "price"), ["date", "ticker"])
    sized = to_positions(weights, deployable, min_position).select("date", "ticker", "weight", "dollars", "shares", "whole_shares")
    out = df.join(sized, ["date", "ticker"], "left")
    small = F.col("skipped").isNull() & F.col("weight").isNull()
    label = F.coalesce(*[F.when(F.col("horizon") == h, v) for h, v in HOLD_LABELS.items()], F.concat(F.lit("~"), F.col("horizon").cast("string"), F.lit(" trading days")))
    return out.withColumn("skipped", F.when(small, "allocation below minimum").otherwise(F.col("skipped"))).select(
        "date", "ticker", "conviction", "price", "horizon", label.alias("hold"), "annualized_edge", "reward_downside", "weight", "dollars", "shares", "whole_shares", "skipped"
    )


# -- linear fits from sums ----------------------------------------------------


def moment_sums(features: Sequence[str], target: str) -> list[Column]:
    """n, sums and products of (1, x..., y): all a least-squares fit needs."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    return [F.sum(a * b).alias(f"m_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]


def moment_names(k: int) -> list[str]:
    return [f"m_{i}_{j}" for i in range(k + 2) for j in range(k + 2) if j >= i]


def solve_ridge(moments: pd.DataFrame, keys: list[str], features: list[str], ridge: float) -> pd.DataFrame:
    """Standardised ridge from the product sums of each row (one fit per row)."""
    k, out = len(features), []
    for _, row in moments.iterrows():
        full = np.zeros((k + 2, k + 2))
        for i in range(k + 2):
            for j in range(i, k + 2):
                full[i, j] = full[j, i] = row[f"m_{i}_{j}"]
        n = full[0, 0]
        mean = full[0, 1 : k + 1] / n
        cov = full[1 : k + 1, 1 : k + 1] / n - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-24, None))
        y_mean = full[0, k + 1] / n
        rhs = (full[1 : k + 1, k + 1] / n - mean * y_mean) / sd
        beta = np.linalg.solve(cov / np.outer(sd, sd) + ridge / n * np.eye(k), rhs) / sd
        out.append([*[row[c] for c in keys], float(y_mean - beta @ mean), beta.tolist(), mean.tolist(), float(n)])
    return pd.DataFrame(out, columns=[*keys, "intercept", "beta", "mean", "n_rows"])


def fit_linear(train: DataFrame, features: list[str], target: str, by: list[str], ridge: float = 1.0, least: int = 100) -> DataFrame:
    """One ridge fit per group; the rows themselves never leave their tasks."""
    rows = train.dropna(subset=[*features, target])
    sums = rows.groupBy(*by).agg(*moment_sums(features, target)).filter(F.col("m_0_0") >= least)
    kinds = dict(rows.select(*by).dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["intercept double", "beta array<double>", "mean array<double>", "n_rows double"])
    return sums.mapInPandas(lambda it: (solve_ridge(pdf, by, features, ridge) for pdf in it if len(pdf)), schema)


def linear_score(features: list[str]) -> Column:
    return F.col("intercept") + sum(F.col(c) * F.get(F.col("beta"), F.lit(i)) for i, c in enumerate(features))


def linear_contributions(features: list[str]) -> list[Column]:
    """Contribution of each feature against its training mean."""
    return [(F.col(c) - F.get(F.col("mean"), F.lit(i))) * F.get(F.col("beta"), F.lit(i)) for i, c in enumerate(features)]


def walk_forward(rows: DataFrame, folds: DataFrame, features: list[str], target: str, ridge: float = 1.0) -> DataFrame:
    """Out-of-sample scores: fit on each fold's training rows, score its tests."""
    from barleaf.operators.calibration import assign_folds

    placed = assign_folds(rows.select("date", "ticker", *features, target), folds)
    models = fit_linear(placed.filter("role = 'train'"), features, target, ["fold"], ridge)
    tests = placed.filter("role = 'test'").dropna(subset=features).join(models, "fold")
    return tests.select("fold", "date", "ticker", target, linear_score(features).alias("score"))


def latest_scores(rows: DataFrame, model: DataFrame, features: list[str]) -> DataFrame:
    """Scores of the newest date's complete rows under a stored one-row model."""
    newest = rows.agg(F.max("date")).scalar()
    today = rows.filter(F.col("date") == newest).dropna(subset=features)
    fitted = today.withColumns({c: model.select(c).scalar() for c in ("intercept", "beta")})
    return fitted.select("date", "ticker", linear_score(features).alias("score"))


def importance(rows: DataFrame, model: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute contribution per feature, largest first (one-row model)."""
    df = rows.dropna(subset=features).withColumns({c: model.select(c).scalar() for c in ("beta", "mean")})
    means = df.agg(*[F.avg(F.abs(c)).alias(f) for f, c in zip(features, linear_contributions(features), strict=True)])
    return means.unpivot([], features, "feature", "importance").orderBy(F.desc("importance"))


def trailing_fits(rows: DataFrame, features: list[str], target: str, every: int, window: int = 252, ridge: float = 1.0, least: int = 100) -> DataFrame:
    """A fit per rebalance date on the ``window`` dates before it.

    Sums are taken per date first and then rolled over dates (one row each), so
    overlapping windows cost nothing extra; the result is keyed by fit date.
    """
    known = rows.dropna(subset=[*features, target])
    daily = known.groupBy("date").agg(*moment_sums(features, target))
    order = Window.orderBy("date")
    before = order.rowsBetween(-window, -1)
    names = moment_names(len(features))
    rolled = daily.select("date", (F.row_number().over(order) - 1).alias("_i"), *[F.sum(c).over(before).alias(c) for c in names])
    anchors = rolled.filter((F.col("_i") >= window) & ((F.col("_i") - window) % every == 0) & (F.col("m_0_0") >= least)).drop("_i")
    schema = "date date, intercept double, beta array<double>, mean array<double>, n_rows double"
    return anchors.mapInPandas(lambda it: (solve_ridge(pdf, ["date"], features, ridge) for pdf in it if len(pdf)), schema)


# -- ensembles and windows of rows --------------------------------------------


def blend_models(predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Mean of model scores weighted by positive validation IC, equal if none."""
    lead = metrics.select("model", F.greatest("ic", F.lit(0.0)).alias("_w"))
    total = lead.agg(F.sum("_w")).scalar()
    w = F.when(total > 0, F.col("_w")).otherwise(1.0)
    df = predictions.join(lead, "model")
    return df.groupBy("date", "ticker").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))


def stack_models(predictions: DataFrame, models: list[str], target: str, ridge: float = 1.0) -> DataFrame:
    """Ridge over base scores: pivot by the fixed model list, then one fit."""
    wide = predictions.groupBy("date", "ticker", target).pivot("model", models).agg(F.first("score")).dropna(subset=models)
    model = fit_linear(wide.withColumn("one", F.lit(1)), models, target, ["one"], ridge)
    return wide.withColumn("one", F.lit(1)).join(model, "one").select("date", "ticker", target, linear_score(models).alias("score"))


def compare_models(metrics: DataFrame) -> DataFrame:
    lead = F.greatest("ic", F.lit(0.0))
    everyone = Window.partitionBy()
    share = F.when(F.sum(lead).over(everyone) > 0, lead / F.sum(lead).over(everyone)).otherwise(1.0 / F.count("*").over(everyone))
    return metrics.select("model", "ic", "mae", "r2", share.alias("weight")).orderBy(F.desc("ic"), "model")


def lookback_windows(df: DataFrame, columns: list[str], n: int, only: str | None = None) -> DataFrame:
    """Last n rows per ticker as an array of arrays, padded with the first row.

    ``only`` limits which rows get a window, so arrays are built just for the
    rows that will be scored.
    """
    frame = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)
    seen = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(frame)
    rows = df.select("date", "ticker", *([only] if only else []), seen.alias("_w"))
    rows = rows.filter(only) if only else rows
    pad = F.array_repeat(F.get("_w", F.lit(0)), F.lit(n) - F.size("_w"))
    return rows.select("date", "ticker", F.concat(pad, "_w").alias("window"))
