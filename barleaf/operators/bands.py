"""Conditional return bands: linear quantiles of the features with a conformal margin.

A quantile minimises the pinball loss.  The loss is bounded from above by a
weighted square that touches it at the current residuals (Hunter and Lange's
majorisation), so every step is a weighted least-squares fit whose product sums
the tasks add up; all horizons and quantiles go through the same pass.  Only
those sums, a few dozen numbers per horizon and quantile, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barleaf.functions.ranking import distinct_counts, running
from barleaf.operators.forecast import QUANTILES, monotone, q_name, split_date
from barleaf.session import cut

STEPS = 25
#: The width under which a residual counts as zero, as a share of the mean residual: per step, and at least.
SHRINK, NARROWEST = 0.6, 1e-3


def standardised(rows: DataFrame, features: Sequence[str], by: str) -> tuple[DataFrame, DataFrame]:
    """Rows as (by, u, y), u a one and the features in units of their spread, and the per-group means and spreads."""
    means = [F.avg(c).alias(f"_mean{i}") for i, c in enumerate(features)]
    spreads = [F.greatest(F.stddev_pop(c), F.lit(1e-12)).alias(f"_sd{i}") for i, c in enumerate(features)]
    stats = rows.groupBy(by).agg(*means, *spreads, F.count("*").cast("double").alias("n"))
    z = [(F.col(c) - F.col(f"_mean{i}")) / F.col(f"_sd{i}") for i, c in enumerate(features)]
    # one row per group of a few
    return rows.join(F.broadcast(stats), by).select(by, F.array(F.lit(1.0), *z).alias("u"), F.col("y").cast("double").alias("y")), stats


def _sums(rows: DataFrame, keys: list[str], terms: int, weight: Column) -> list:
    u = [F.get("u", F.lit(i)) for i in range(terms)]
    gram = [F.sum(weight * u[i] * u[j]).alias(f"g{i}_{j}") for i in range(terms) for j in range(i, terms)]
    right = [F.sum(weight * u[i] * F.col("y")).alias(f"h{i}") for i in range(terms)]
    return rows.groupBy(*keys).agg(*gram, *right).collect()


def _solve(row, terms: int) -> list[float]:
    a = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(terms)] for i in range(terms)])
    return np.linalg.solve(a + 1e-9 * a[0, 0] * np.eye(terms), [row[f"h{i}"] for i in range(terms)]).tolist()


def fit_quantiles(rows: DataFrame, features: Sequence[str], quantiles: Sequence[float] = QUANTILES, by: str = "horizon", steps: int = STEPS) -> DataFrame:
    """(by, quantile, beta, means, spreads, n) from rows (by, features, y) without nulls.

    ``beta`` is in standardised units, the constant first.
    """
    spark, terms = rows.sparkSession, len(features) + 1
    u, stats = standardised(rows, features, by)
    u = cut(u)  # read by every step
    kind = dict(rows.dtypes)[by]
    plain = {r[by]: _solve(r, terms) for r in _sums(u, [by], terms, F.lit(1.0))}

    def held(values: list[tuple], schema: str) -> DataFrame:
        # a few rows of a size that Spark doesn't know: without the hint it would send all of ``u`` through the driver instead
        return F.broadcast(spark.createDataFrame(values, schema))

    fitted = F.aggregate(F.zip_with("u", "beta", lambda x, b: x * b), F.lit(0.0), lambda s, x: s + x)
    start = held([(k, b) for k, b in plain.items()], f"{by} {kind}, beta array<double>")
    scale = {r[by]: r["s"] for r in u.join(start, by).groupBy(by).agg(F.avg(F.abs(F.col("y") - fitted)).alias("s")).collect()}
    betas = {(k, q): b for k, b in plain.items() for q in quantiles}
    for step in range(steps):
        width = max(SHRINK**step, NARROWEST)
        model = held([(k, q, b, scale[k] * width) for (k, q), b in betas.items()], f"{by} {kind}, quantile double, beta array<double>, width double")
        r = F.col("y") - F.col("fit")
        weight = F.when(r > 0, F.col("quantile")).otherwise(1 - F.col("quantile")) / F.greatest(F.abs(r), F.col("width"))
        weighed = u.join(model, by).withColumn("fit", fitted).withColumn("w", weight)
        betas = {(row[by], row["quantile"]): _solve(row, terms) for row in _sums(weighed, [by, "quantile"], terms, F.col("w"))}
    model = held([(k, q, b) for (k, q), b in betas.items()], f"{by} {kind}, quantile double, beta array<double>")
    k = range(len(features))
    return model.join(stats.select(by, F.array(*[f"_mean{i}" for i in k]).alias("means"), F.array(*[f"_sd{i}" for i in k]).alias("spreads"), "n"), by)


def quantile_bands(rows: DataFrame, model: DataFrame, features: Sequence[str], quantiles: Sequence[float] = QUANTILES, by: str = "horizon") -> DataFrame:
    """``rows`` with one column per quantile, each at least the one before it."""
    per = [F.max(F.when(F.col("quantile") == q, F.struct("beta", "means", "spreads"))).alias(f"_{q_name(q)}") for q in quantiles]
    wide = model.groupBy(by).agg(*per)

    def at(q: float) -> Column:
        m = F.col(f"_{q_name(q)}")
        return F.get(m["beta"], F.lit(0)) + sum(F.get(m["beta"], F.lit(i + 1)) * (F.col(c) - F.get(m["means"], F.lit(i))) / F.get(m["spreads"], F.lit(i)) for i, c in enumerate(features))

    names = [q_name(q) for q in quantiles]
    return monotone(rows.join(F.broadcast(wide), by).withColumns({q_name(q): at(q) for q in quantiles}).drop(*[f"_{n}" for n in names]), names)


def conformal(scored: DataFrame, lo: str, hi: str, alpha: float = 0.10, by: str = "horizon") -> DataFrame:
    """(by, n_cal, margin, coverage): the order statistic of how far y lies outside the band, the higher neighbour of its level."""
    rows = scored.select(by, F.greatest(F.col(lo) - F.col("y"), F.col("y") - F.col(hi)).alias("score"))
    counts = cut(running(distinct_counts(rows, "score", (by,)), "score", ["_n"], (by,)))
    # one row per group of a few
    sizes = F.broadcast(counts.groupBy(by).agg(F.sum("_n").alias("n_cal")))
    position = F.least(F.ceil((F.col("n_cal") + 1) * (1 - alpha) - 1e-9) + 1, F.col("n_cal"))
    placed = counts.join(sizes, by)
    margin = placed.groupBy(by, "n_cal").agg(F.min(F.when(F.col("upto__n") >= position, F.col("score"))).alias("margin"))
    inside = F.sum(F.when(F.col("score") <= F.col("margin"), F.col("_n")).otherwise(0)) / F.col("n_cal")
    return counts.join(F.broadcast(margin), by).groupBy(by, "n_cal", "margin").agg(inside.alias("coverage"))


def fitted_bands(rows: DataFrame, features: Sequence[str], quantiles: Sequence[float] = QUANTILES, alpha: float = 0.10, fraction: float = 0.2, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """The quantile model, fitted on all but the last ``fraction`` of dates, and its margins, from those.

    ``rows``: (horizon, date, features, y).
    """
    known = rows.dropna(subset=[*features, "y"])
    at = split_date(known, fraction)
    model = fit_quantiles(known.filter(F.col("date") < at), features, quantiles, steps=steps)
    scored = quantile_bands(known.filter(F.col("date") >= at), model, features, quantiles)
    return model, conformal(scored, q_name(quantiles[0]), q_name(quantiles[-1]), alpha)


def price_bounds(latest: DataFrame, model: DataFrame, margins: DataFrame, features: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Price bands of (ticker, price, features) at every horizon: the outer quantiles widened by the margin."""
    each = latest.withColumn("horizon", F.explode(margins.agg(F.collect_list("horizon")).scalar()))
    rows = quantile_bands(each.join(F.broadcast(margins.select("horizon", "margin", "coverage")), "horizon"), model, features, quantiles)
    lo, hi = F.col(q_name(quantiles[0])) - F.col("margin"), F.col(q_name(quantiles[-1])) + F.col("margin")
    rows = rows.withColumns({"lo": lo, "median": F.col("q50"), "hi": hi})
    return rows.withColumns({f"price_{c}": F.col("price") * (1 + F.col(c)) for c in ("lo", "q25", "median", "q75", "hi")})
