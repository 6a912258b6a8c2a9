"""Conditional quantile bands: the optimality condition, coverage, order."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleaf.operators import bands as B
from barleaf.operators import forecast as FC

NAMES = ["a", "b", "c"]


def drawn(seed=1, days=300, names=12):
    """Returns whose spread follows ``a``, wider at the longer horizon."""
    rng = np.random.default_rng(seed)
    out = []
    for horizon in (5, 20):
        x = rng.normal(size=(days * names, 3))
        y = 0.2 * x[:, 1] + np.exp(0.5 * x[:, 0]) * rng.standard_t(4, size=days * names) * horizon / 5
        out += [(horizon, dt.date(2020, 1, 1) + dt.timedelta(days=i // names), f"T{i % names}", *map(float, x[i]), float(y[i])) for i in range(days * names)]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(drawn(), "horizon int, date date, ticker string, a double, b double, c double, y double").cache()


def test_fits_meet_the_optimality_condition(rows):
    """At the minimum of the pinball loss, inputs weighted by (q - [y below]) cancel out."""
    model = {(r.horizon, r.quantile): r for r in B.fit_quantiles(rows, NAMES).collect()}
    data = rows.toPandas()
    assert len(model) == 10
    for (horizon, q), m in model.items():
        part = data[data["horizon"] == horizon]
        u = np.column_stack([np.ones(len(part)), (part[NAMES].to_numpy() - m.means) / m.spreads])
        below = part["y"].to_numpy() < u @ m.beta
        assert np.abs(u.T @ (q - below)).max() / len(part) < 0.004, (horizon, q)
    assert model[5, 0.95].beta[1] > 0.5 and model[5, 0.05].beta[1] < -0.5 and abs(model[5, 0.5].beta[1]) < 0.1


def test_no_other_line_has_a_lower_loss(rows):
    model = B.fit_quantiles(rows.filter("horizon = 5"), NAMES, [0.05, 0.5]).collect()
    data = rows.filter("horizon = 5").toPandas()
    rng = np.random.default_rng(0)
    for m in model:
        u = np.column_stack([np.ones(len(data)), (data[NAMES].to_numpy() - m.means) / m.spreads])
        loss = lambda b: np.mean([max(m.quantile * e, (m.quantile - 1) * e) for e in data["y"] - u @ b])  # noqa: B023, E731
        best = loss(np.array(m.beta))
        assert all(loss(np.array(m.beta) + rng.normal(0, s, 4)) > best - 1e-4 for s in (0.01, 0.05, 0.2) for _ in range(5))


def test_bands_cover_are_ordered_and_widen(rows):
    model, margins = B.fitted_bands(rows, NAMES)
    known = {r.horizon: r for r in margins.collect()}
    assert all(0.9 <= r.coverage <= 0.93 and r.n_cal == 60 * 12 for r in known.values())
    latest = rows.filter("horizon = 5").groupBy("ticker").agg(F.max_by(F.struct(*NAMES), "date").alias("r")).select("ticker", F.lit(100.0).alias("price"), "r.*")
    out = B.price_bounds(latest, model, margins, NAMES).toPandas()
    assert len(out) == 24 and (out["price_lo"] <= out["price_median"]).all() and (out["price_median"] <= out["price_hi"]).all()
    assert (out["q25"] <= out["median"]).all() and (out["median"] <= out["q75"]).all()
    wide = out.assign(w=out["hi"] - out["lo"]).pivot(index="ticker", columns="horizon", values="w")
    assert (wide[20] > wide[5]).mean() > 0.9


def test_margin_equals_the_order_statistic(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=173)
    scored = spark.createDataFrame([(1, float(v), -0.5, 0.5) for v in y], "horizon int, y double, q05 double, q95 double")
    got = B.conformal(scored, "q05", "q95").first()
    s = np.maximum(-0.5 - y, y - 0.5)
    want = np.quantile(s, np.ceil(174 * 0.9) / 173, method="higher")
    assert got.margin == pytest.approx(want) and got.coverage == pytest.approx((s <= want).mean()) and got.n_cal == 173


def test_a_constant_feature_and_null_rows(spark, rows):
    flat = rows.withColumn("c", F.lit(2.0)).withColumn("b", F.when(F.col("ticker") != "T1", F.col("b")))
    model, margins = B.fitted_bands(flat, NAMES, steps=5)
    assert margins.count() == 2 and all(np.isfinite(r.beta).all() for r in model.collect())
    assert FC.QUANTILES == (0.05, 0.25, 0.50, 0.75, 0.95)
