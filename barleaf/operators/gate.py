"""Permutation gate: does a fit rank names better than fits on shuffled labels?

All refits of a group come from one pass of product sums: a training row
carries its label and its N shuffled labels side by side, the sums of the inputs
with each of them are array positions, and one system is solved with N + 1 right
hand sides.  No refit reads the rows again.

A shuffle is a cyclic shift inside random blocks: rows are dealt into blocks of
about ``BLOCK`` by a seeded hash of their key and ordered by it, and the s-th
shuffle gives a row the label s places on.  Every shuffle is a permutation of
all labels, the same on any cluster layout, and costs one exchange for all N.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.operators import calibration as C
from barleaf.operators import forecast as FC

SHUFFLES = 10
BLOCK = 4096


def shuffled_labels(rows: DataFrame, target: str, by: Sequence[str] = (), shuffles: int = SHUFFLES, seed: int = 0, block: int = BLOCK, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """``rows`` with ``labels``: the label, then its shuffled stand-ins, permuted within ``by``."""
    code = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    sizes = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count("*") / block)).alias("_blocks"))
    dealt = rows.withColumn("_code", code)
    dealt = dealt.join(sizes, list(by)) if by else dealt.withColumn("_blocks", sizes.select("_blocks").scalar())
    dealt = dealt.withColumn("_block", F.conv(F.substring("_code", 1, 8), 16, 10).cast("long") % F.col("_blocks"))
    whole = Window.partitionBy(*by, "_block")
    order = whole.orderBy("_code", *keys)
    placed = dealt.withColumns({"_place": F.row_number().over(order) - 1, "_size": F.count("*").over(whole)})
    # the block's first labels stand behind its last ones
    first = F.array_sort(F.collect_list(F.when(F.col("_place") < shuffles, F.struct("_place", F.col(target).alias("y")))).over(whole))
    placed = placed.withColumn("_first", first)
    ahead = [F.when(F.col("_place") + s < F.col("_size"), F.lead(target, s).over(order)).otherwise(F.get(F.col("_first.y"), F.pmod(F.col("_place") + s, F.col("_size")).cast("int"))) for s in range(1, shuffles + 1)]
    return placed.withColumn("labels", F.array(F.col(target).cast("double"), *[a.cast("double") for a in ahead])).drop("_code", "_blocks", "_block", "_place", "_size", "_first")


def batched_fits(rows: DataFrame, features: Sequence[str], by: Sequence[str], fits: int, ridge: float = 1.0, least: int = 100) -> DataFrame:
    """Standardised ridge per group for each position of ``labels``: ``intercepts`` and ``betas``."""
    ones = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    gram = [F.sum(a * b).alias(f"g_{i}_{j}") for i, a in enumerate(ones) for j, b in enumerate(ones) if j >= i]
    right = [F.array(*[F.sum(a * F.get("labels", F.lit(s))) for s in range(fits)]).alias(f"r_{i}") for i, a in enumerate(ones)]
    sums = rows.groupBy(*by).agg(*gram, *right).filter(F.col("g_0_0") >= least)
    k = len(features)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for _, row in pdf.iterrows():
                full = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                xy = np.array([row[f"r_{i}"] for i in range(k + 1)])
                n, mean = full[0, 0], full[0, 1:] / full[0, 0]
                cov = full[1:, 1:] / n - np.outer(mean, mean)
                sd = np.sqrt(np.clip(np.diag(cov), 1e-24, None))
                rhs = (xy[1:] / n - np.outer(mean, xy[0] / n)) / sd[:, None]
                beta = np.linalg.solve(cov / np.outer(sd, sd) + ridge / n * np.eye(k), rhs) / sd[:, None]
                out.append([*[row[c] for c in by], (xy[0] / n - mean @ beta).tolist(), beta.T.tolist()])
            yield pd.DataFrame(out, columns=[*by, "intercepts", "betas"])

    kinds = dict(rows.dtypes)
    return sums.mapInPandas(solve, ", ".join([*[f"{c} {kinds[c]}" for c in by], "intercepts array<double>", "betas array<array<double>>"]))


def walk_forward_metrics(placed: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), ridge: float = 1.0) -> DataFrame:
    """Mean rank correlation over folds, its ratio to its spread, and the fold count, from rows with (fold, role)."""
    models = FC.fit_linear(placed.filter("role = 'train'"), list(features), target, [*by, "fold"], ridge)
    tests = placed.filter("role = 'test'").join(models, [*by, "fold"]).withColumn("score", FC.linear_score(list(features)))
    folds = C.fold_metrics(tests, target, "score", (*by, "fold"))
    sd = F.stddev_pop("ic")
    return folds.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.when(sd > 1e-9, F.avg("ic") / sd).otherwise(0.0).alias("icir"), F.count("*").alias("n_folds"))


def shuffled_label_gate(rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), shuffles: int = SHUFFLES, seed: int = 0, ridge: float = 1.0, block: int = BLOCK) -> DataFrame:
    """One row per group: the model's mean rank correlation over all folds against
    the null that refits on shuffled labels give on the last fold.

    The gate passes if the correlation is above the null's 95th percentile.  A
    refit without a date to score counts as zero.
    """
    placed = C.assign_folds(rows.dropna(subset=[*features, target]).select(*by, "date", "ticker", *features, target), folds)
    real = walk_forward_metrics(placed, features, target, by, ridge)
    final = placed.filter(F.col("fold") == folds.agg(F.max("fold")).scalar())
    train = shuffled_labels(final.filter("role = 'train'"), target, by, shuffles, seed, block)
    group = [*by] or ["_all"]
    if not by:
        train, final = train.withColumn("_all", F.lit(1)), final.withColumn("_all", F.lit(1))
        real = real.withColumn("_all", F.lit(1))
    fits = batched_fits(train, features, group, shuffles + 1, ridge)
    score = lambda a, b: a + sum(F.col(c) * F.get(b, F.lit(j)) for j, c in enumerate(features))
    scores = F.posexplode(F.zip_with("intercepts", "betas", score)).alias("shuffle", "score")
    tests = final.filter("role = 'test'").join(fits, group).select(*group, "date", "ticker", target, scores).filter("shuffle > 0")
    ic = C.per_date_ic(tests, target, "score", (*group, "shuffle")).select(*group, "shuffle", F.abs("ic").alias("_null"))
    all_fits = fits.select(*group, F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("shuffle"))
    null = all_fits.join(ic, [*group, "shuffle"], "left").groupBy(*group).agg(
        F.avg(F.coalesce("_null", F.lit(0.0))).alias("shuffled_ic_mean"), F.percentile(F.coalesce("_null", F.lit(0.0)), 0.95).alias("shuffled_ic_p95"), F.count("*").alias("n_shuffles")
    )
    out = real.join(null, group, "left").withColumn("real_abs_ic", F.abs("ic_mean"))
    return out.withColumn("passed", F.col("real_abs_ic") > F.col("shuffled_ic_p95")).select(*by, "real_abs_ic", "shuffled_ic_mean", "shuffled_ic_p95", "n_shuffles", "passed", "ic_mean", "icir", "n_folds")
