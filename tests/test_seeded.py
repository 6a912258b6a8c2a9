"""Seeded random numbers, isolation forests and posterior draws."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleaf.operators import learned as L

COLS = ["a", "b", "c"]


def rows_of(spark, n=60, days=2, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        x = rng.normal(size=(n, 3))
        x[:, 2] = np.round(x[:, 2])  # ties
        x[0] = [9.0, -9.0, 9.0]
        rows += [(f"d{d}", f"T{i:03d}", *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "date string, ticker string, a double, b double, c double")


def unit(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52


def slow_path(x, inside, rows, key, depth, deepest, out, node=1):
    """Plain recursion over one tree."""
    mine = [i for i in rows if i in inside]
    size = len(mine)
    live = [j for j in range(x.shape[1]) if size and x[mine, j].max() > x[mine, j].min()]
    if size <= 1 or depth >= deepest or not live:
        rest = 0 if size <= 1 else 1 if size == 2 else 2 * (math.log(size - 1) + 0.5772156649015329) - 2 * (size - 1) / size
        for i in rows:
            out[i] = depth + rest
        return
    code = hashlib.md5(f"{key}|{node}".encode()).hexdigest()
    j = live[int(code[13:21], 16) % len(live)]
    lo, hi = x[mine, j].min(), x[mine, j].max()
    cut = lo + int(code[:13], 16) / 2**52 * (hi - lo)
    slow_path(x, inside, [i for i in rows if x[i, j] <= cut], key, depth + 1, deepest, out, 2 * node)
    slow_path(x, inside, [i for i in rows if x[i, j] > cut], key, depth + 1, deepest, out, 2 * node + 1)


@pytest.mark.parametrize("sample", [256, 16])
def test_forest_equals_plain_recursion(spark, sample):
    df = rows_of(spark)
    got = {(r.date, r.ticker): r.score for r in L.isolation_scores(df.repartition(5), COLS, trees=12, sample=sample).collect()}
    data = df.toPandas()
    for date, part in data.groupby("date"):
        part = part.reset_index(drop=True)
        x, n = part[COLS].to_numpy(), len(part)
        psi, total = min(n, sample), np.zeros(n)
        for tree in range(12):
            order = sorted(range(n), key=lambda i: (unit(42, date, tree, part.ticker[i]), part.ticker[i]))
            out = {}
            slow_path(x, set(order[:psi]), list(range(n)), f"42|{date}|{tree}", 0, math.ceil(math.log2(psi)), out)
            total += [out[i] for i in range(n)]
        norm = 2 * (math.log(psi - 1) + 0.5772156649015329) - 2 * (psi - 1) / psi
        want = -(2.0 ** (-(total / 12) / norm))
        assert all(abs(got[date, t] - w) < 1e-9 for t, w in zip(part.ticker, want))


def test_a_planted_outlier_is_isolated_first(spark):
    scores = L.isolation_scores(rows_of(spark), COLS, trees=60)
    assert [r.ticker for r in scores.groupBy("date").agg(F.min_by("ticker", "score").alias("ticker")).collect()] == ["T000", "T000"]


def test_posterior_draws(spark):
    """Order statistics of uniform numbers are beta draws: mean and variance by the formula, the same on any layout."""
    df = spark.range(4000).withColumn("d", L.beta_draw(F.lit(3), F.lit(7), F.lit("s"), F.col("id").cast("string")))
    d = np.array([r.d for r in df.collect()])
    assert abs(d.mean() - 0.3) < 0.01 and abs(d.var() - 0.3 * 0.7 / 11) < 0.002
    assert sorted(d) == sorted(r.d for r in df.repartition(7).collect())
    one = spark.range(1).select(L.beta_draw(F.lit(1), F.lit(1), F.lit("s"), F.lit("x")).alias("d")).first().d
    assert one == unit("s", "x", 1)
