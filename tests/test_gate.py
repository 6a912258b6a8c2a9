"""Permutation gate: known answers on planted and on pure-noise labels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleaf.operators import calibration as C
from barleaf.operators import gate as G


def labelled(spark, signal, seed=11, names=30, days=420):
    """Signal and noise columns; the label follows the signal with the given strength."""
    rng = np.random.default_rng(seed)
    sig, noise = rng.normal(size=(days, names)), rng.normal(size=(days, names))
    y = signal * sig + rng.normal(size=(days, names))
    rows = [(f"T{j:02d}", i, float(sig[i, j]), float(noise[i, j]), float(y[i, j])) for i in range(days) for j in range(names)]
    return spark.createDataFrame(rows, "ticker string, i int, sig double, noise double, y double").selectExpr("ticker", "date_add(date'2020-01-01', i) as date", "sig", "noise", "y")


@pytest.mark.parametrize("block", [4096, 64, 7])
def test_shuffles_are_permutations(spark, block):
    rows = labelled(spark, 1.0, days=20).withColumn("half", F.col("ticker") < "T15")
    out = G.shuffled_labels(rows, "y", ("half",), 10, 0, block).collect()
    assert len(out) == 600
    for half in (True, False):
        real = sorted(r.y for r in out if r.half == half)
        for s in range(1, 11):
            assert sorted(r.labels[s] for r in out if r.half == half) == real
            assert block < 10 or np.mean([r.labels[s] == r.y for r in out]) < 0.1
    assert all(r.labels[0] == r.y for r in out)


def test_shuffles_do_not_follow_the_layout(spark):
    rows = labelled(spark, 1.0, days=20)

    def found(df, seed=0):
        return {(r.date, r.ticker): r.labels for r in G.shuffled_labels(df, "y", seed=seed, block=100).collect()}

    assert found(rows) == found(rows.repartition(7, "sig")) != found(rows, 1)


def test_batched_fits_equal_single_fits(spark):
    from barleaf.operators.forecast import fit_linear

    rows = G.shuffled_labels(labelled(spark, 0.5, days=60), "y", block=200).withColumn("one", F.lit(1))
    fits = G.batched_fits(rows, ["sig", "noise"], ["one"], 11).first()
    for s in (0, 1, 10):
        alone = fit_linear(rows.withColumn("t", F.col("labels")[s]), ["sig", "noise"], "t", ["one"]).first()
        assert np.allclose(fits.betas[s], alone.beta) and np.isclose(fits.intercepts[s], alone.intercept)
    assert abs(fits.betas[0][0] - 0.5) < 0.1 and all(abs(fits.betas[s][0]) < 0.15 for s in range(1, 11))


def test_gate_passes_skill_and_stops_noise(spark):
    both = labelled(spark, 0.3).withColumn("horizon", F.lit(5)).unionByName(labelled(spark, 0.0, 12).withColumn("horizon", F.lit(20)))
    folds = C.walk_forward_folds(both, 5)
    out = {r.horizon: r for r in G.shuffled_label_gate(both, folds, ["sig", "noise"], "y", ("horizon",)).collect()}
    assert out[5].passed and out[5].real_abs_ic > 0.2 and out[5].icir > 1 and out[5].shuffled_ic_p95 < out[5].real_abs_ic
    assert not out[20].passed and out[20].real_abs_ic < 0.1
    assert all(r.n_shuffles == 10 and r.n_folds == 5 for r in out.values())
    alone = G.shuffled_label_gate(both.filter("horizon = 5"), folds, ["sig", "noise"], "y").first()
    assert np.isclose(alone.real_abs_ic, out[5].real_abs_ic) and np.isclose(alone.shuffled_ic_p95, out[5].shuffled_ic_p95)
