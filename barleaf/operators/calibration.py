"""Splits, leakage checks, fold metrics, drift and the prediction ledger."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.ranking import distinct_counts, ordinal_ranks, running_in_ranges, spearman
from barleaf.operators import evaluate as V
from barleaf.session import cut

# -- splits: tables of one row per date ---------------------------------------


def numbered_dates(df: DataFrame) -> DataFrame:
    dates = df.select("date").distinct()
    return dates.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))


def even_block(i: Column, n: Column, blocks: int) -> Column:
    """Block number when n items are cut into near-equal runs, larger ones first."""
    size, extra = F.floor(n / blocks), n % blocks
    long_part = extra * (size + 1)
    return F.when(i < long_part, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - long_part) / F.greatest(size, F.lit(1)))).cast("int")


def walk_forward_folds(df: DataFrame, horizon_days: int, n_splits: int = 5, embargo_days: int = 5, min_train: float = 0.4) -> DataFrame:
    """One row per fold: purge cut and test range, in calendar days.

    The first 40 % of dates only train; a training date must lie more than
    horizon + embargo days before the fold's first test date.
    """
    dates = numbered_dates(df)
    start = F.floor(F.col("n") * min_train)
    tail = dates.filter(F.col("i") >= start).withColumn("fold", even_block(F.col("i") - start, F.col("n") - start, n_splits))
    folds = tail.groupBy("fold").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    return folds.withColumn("train_end", F.date_sub("test_start", horizon_days + embargo_days))


def assign_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with (fold, role); a date is joined to the few folds it belongs to.

    The fold table has one row per fold, so it rides with every task.
    """
    f = F.broadcast(folds.select("fold", "train_end", "test_start", "test_end"))
    inside = (F.col("date") < F.col("train_end")) | F.col("date").between(F.col("test_start"), F.col("test_end"))
    both = rows.join(f, inside)
    return both.withColumn("role", F.when(F.col("date") < F.col("train_end"), "train").otherwise("test")).drop("train_end", "test_start", "test_end")


def overlap_free(rows: DataFrame, folds: DataFrame, horizon_days: int) -> DataFrame:
    """Per fold, whether no training label reaches the first test date."""
    last = assign_folds(rows.select("date").distinct(), folds).filter("role = 'train'").groupBy("fold").agg(F.max("date").alias("last_train"))
    return last.join(folds, "fold").select("fold", "last_train", "test_start", (F.date_add("last_train", horizon_days) < F.col("test_start")).alias("clean"))


def combinatorial_dates(df: DataFrame, horizon_days: int, n_groups: int = 6, n_test: int = 2, embargo_days: int = 5) -> DataFrame:
    """(fold, date, role) for every choice of held-out date groups.

    A training date within horizon + embargo days of a held-out group, either
    side, is dropped.  The combinations are a literal table of C(6, 2) rows.
    """
    dates = numbered_dates(df).withColumn("grp", even_block(F.col("i"), F.col("n"), n_groups))
    spans = dates.groupBy("grp").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    picks = [(fold, list(c)) for fold, c in enumerate(combinations(range(n_groups), n_test))]
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.array(*[F.lit(g) for g in c]).alias("held")) for k, c in picks]))
    paths = dates.select("date", "grp", table.alias("p")).select("date", "grp", "p.*")
    pad = horizon_days + embargo_days
    edges = spans.agg(F.array_sort(F.collect_list(F.struct("grp", "lo", "hi")))).scalar()
    paths = paths.withColumn("_edges", edges)
    near = F.exists(
        F.filter("_edges", lambda s: F.array_contains(F.col("held"), s["grp"])),
        lambda s: F.col("date").between(F.date_sub(s["lo"], pad), F.date_add(s["hi"], pad)),
    )
    test = F.array_contains("held", F.col("grp"))
    return paths.withColumn("role", F.when(test, "test").when(~near, "train")).filter("role is not null").select("fold", "date", "role")


def calendar_windows(df: DataFrame, train_years: int = 4, test_years: int = 1, step_years: int = 1) -> DataFrame:
    """Calendar walk-forward table: train 4 years, test 1, moving by 1."""
    span = df.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    folds = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.months_between("_hi", "_lo") / (12 * step_years))).cast("int")))
    k = df.sparkSession.range(1).withColumn("_lo", span["lo"]).withColumn("_hi", span["hi"]).where("_lo is not null").withColumn("fold", folds).withColumn("fold", F.col("fold").cast("long"))
    starts = k.withColumn("train_start", F.add_months("_lo", F.col("fold").cast("int") * 12 * step_years))
    w = starts.withColumn("train_end", F.add_months("train_start", 12 * train_years)).withColumn("test_end", F.add_months("train_end", 12 * test_years))
    return w.filter(F.col("test_end") <= F.col("_hi")).select("fold", "train_start", "train_end", F.col("train_end").alias("test_start"), "test_end")


def expected_max_normal(trials: int) -> float:
    """Expected best of N standard normal draws (extreme-value approximation)."""
    n, gamma, q = max(2, trials), 0.5772156649, NormalDist().inv_cdf
    return (1 - gamma) * q(1 - 1.0 / n) + gamma * q(1 - 1.0 / (n * math.e))


def deflate(metrics: DataFrame, trials: int) -> DataFrame:
    """ICIR less the best-of-N null for the number of folds, and a pass flag."""
    null = F.when(F.col("n_folds") >= 2, expected_max_normal(trials) / F.sqrt("n_folds")).otherwise(0.0)
    return metrics.withColumn("null_max_icir", null).withColumn("deflated_icir", F.col("icir") - null).withColumn("credible", F.col("icir") > null)


# -- rank correlation and fold metrics ----------------------------------------


def per_date_ic(df: DataFrame, target: str, score: str, by: tuple[str, ...] = (), min_names: int = 10) -> DataFrame:
    """Mean of within-date rank correlations over dates with enough names.

    A date holds one row per name, so its tie-averaged ranks are windows.
    """
    rows = df.filter(F.col(target).isNotNull() & F.col(score).isNotNull())
    group = [*by, "date"]

    def mean_rank(c):
        over = Window.partitionBy(*group).orderBy(c)
        return F.rank().over(over) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2.0

    ranked = rows.select(*group, F.col(score), mean_rank(target).alias("_ry"), mean_rank(score).alias("_rp"))
    daily = ranked.groupBy(*group).agg(F.count("*").alias("_n"), F.stddev_pop(score).alias("_sd"), F.corr("_ry", "_rp").alias("ic"))
    live = daily.filter((F.col("_n") >= min_names) & (F.col("_sd") > 1e-12) & F.col("ic").isNotNull() & ~F.isnan("ic"))
    return live.groupBy(*by).agg(F.avg("ic").alias("ic"), F.count("*").alias("n_dates"))


def pooled_ic(df: DataFrame, target: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation over all rows at once; ranks are split by value range."""
    return spearman(df, target, score, by)


def fold_metrics(df: DataFrame, target: str, score: str, by: tuple[str, ...] = ("fold", "model"), priority: str | None = None) -> DataFrame:
    y, p = F.col(target), F.col(score)
    rows = df.filter(y.isNotNull() & p.isNotNull())
    stats = rows.groupBy(*by).agg(
        F.avg(F.when(F.abs(y) > 1e-9, (F.signum(p) == F.signum(y)).cast("double"))).alias("hit_rate"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count("*"))).alias("r2"),
        F.count("*").alias("n"),
    )
    out = stats.join(per_date_ic(rows, target, score, by).drop("n_dates"), list(by), "left").fillna(0.0, ["ic"])
    if priority is None:
        return out.withColumn("univ_ic", F.col("ic"))
    narrow = per_date_ic(rows.filter(priority), target, score, by).select(*by, F.col("ic").alias("univ_ic"))
    return out.join(narrow, list(by), "left").withColumn("univ_ic", F.coalesce("univ_ic", "ic"))


def aggregate_folds(folds: DataFrame) -> DataFrame:
    """Per model: means over folds, population spread and their ratio."""
    def ratio(c):
        sd = F.stddev_pop(c)
        return F.when(sd > 1e-9, F.avg(c) / sd).otherwise(0.0)

    return folds.groupBy("model").agg(
        F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), ratio("ic").alias("icir"),
        F.avg("univ_ic").alias("univ_ic_mean"), ratio("univ_ic").alias("univ_icir"),
        F.avg("hit_rate").alias("hit_rate"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"), F.count("*").alias("n_folds"),
    )


def selection(models: DataFrame, universe_weight: float = 0.0) -> DataFrame:
    """Models ordered by positive mean IC, blended ICIR, then mean IC."""
    score = (1.0 - universe_weight) * F.col("icir") + universe_weight * F.col("univ_icir")
    return models.withColumn("selection", score).withColumn(
        "place", F.row_number().over(Window.orderBy((F.col("ic_mean") > 0).desc(), F.desc("selection"), F.desc("ic_mean"), "model"))
    )


def futile(folds: DataFrame, upto_fold: int, keep_top: int = 2, share: float = 0.35) -> DataFrame:
    """Models to stop after a fold: mean IC at or below 0 or far under the leader."""
    means = folds.filter(F.col("fold") <= upto_fold).groupBy("model").agg(F.avg("ic").alias("m"))
    everyone = Window.partitionBy()
    ranked = means.withColumn("lead", F.max("m").over(everyone)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("m"), "model")))
    bad = (F.col("m") <= 0) | ((F.col("lead") > 0) & (F.col("m") < share * F.col("lead")))
    return ranked.withColumn("pruned", (F.col("place") > keep_top) & bad).select("model", "m", "place", "pruned")


def fold_by_model(folds: DataFrame, models: list[str]) -> DataFrame:
    return folds.groupBy("fold").pivot("model", models).agg(F.avg("ic"))


# -- drift --------------------------------------------------------------------


def drift(reference: DataFrame, current: DataFrame, columns: list[str], limit: float = 0.01, least: int = 30) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column, asymptotic p-value.

    Both samples are melted, combined per distinct value before any shuffle of
    rows, and all columns are ranked in one set of ranges of (column, value), so
    any number of columns costs one exchange and none fills a task.
    """
    a = reference.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value").withColumn("ref", F.lit(1))
    b = current.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value").withColumn("ref", F.lit(0))
    both = a.unionByName(b)
    counts = distinct_counts(both, "value", ("feature",), {"_a": F.sum("ref"), "_b": F.sum(1 - F.col("ref"))})
    counts = cut(counts)
    steps = running_in_ranges(counts, "value", ["_a", "_b"], ("feature",))
    sizes = counts.groupBy("feature").agg(F.sum("_a").alias("ref_n"), F.sum("_b").alias("cur_n")).filter((F.col("ref_n") >= least) & (F.col("cur_n") >= least))
    gap = F.abs(F.col("upto__a") / F.col("ref_n") - F.col("upto__b") / F.col("cur_n"))
    out = steps.join(sizes, "feature").groupBy("feature").agg(F.max(gap).alias("ks_stat"), F.first("ref_n").alias("ref_n"), F.first("cur_n").alias("cur_n"))
    lam = F.col("ks_stat") * F.sqrt(F.col("ref_n") * F.col("cur_n") / (F.col("ref_n") + F.col("cur_n")))
    terms = F.lit(0.0)
    for k in range(1, 51):
        terms = terms + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("p_value", p).withColumn("drift", F.col("p_value") < limit)


# -- leakage ------------------------------------------------------------------


def sharpe_of(prices: DataFrame, weights: DataFrame, name: str, **options) -> DataFrame:
    return V.metrics(V.daily_results(prices, weights, **options)).select(F.col("sharpe").alias(name))


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames as one row."""
    return left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns])


def shift_test(prices: DataFrame, weights: DataFrame, shift: int = 1) -> DataFrame:
    """Sharpe with weights moved into the past; a jump over 0.3 is suspect."""
    early = weights.select(
        "date", "ticker", F.coalesce(F.lead("weight", shift).over(Window.partitionBy("ticker").orderBy("date")), F.lit(0.0)).alias("weight")
    )
    both = side_by_side(sharpe_of(prices, weights, "base_sharpe"), sharpe_of(prices, early, "shifted_sharpe"))
    delta = F.col("shifted_sharpe") - F.col("base_sharpe")
    return both.withColumn("delta", delta).withColumn("leak_suspect", F.col("delta") > 0.3)


def delay_test(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """Sharpe at delay 1 and 3: it may fade but not collapse."""
    both = side_by_side(sharpe_of(prices, weights, "base_sharpe", delay=1), sharpe_of(prices, weights, "delayed_sharpe", delay=3))
    base, late = F.col("base_sharpe"), F.col("delayed_sharpe")
    return both.withColumn("robust", (late > 0) & (base - late < 0.5 * F.abs(base + 1e-6) + 1.0))


def shuffle_column(df: DataFrame, column: str, keys: list[str], seed: int = 0, buckets: int | None = None) -> DataFrame:
    """Permute a column over all rows, the same way on any cluster layout.

    Rows are numbered twice, by key and by a seeded hash of the key, and joined
    on the number.  Numbers come from hash buckets (a count per bucket plus a
    rank inside), so no task sorts the whole table; ``buckets`` follows the
    session's shuffle width and does not change the permutation.
    """
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.xxhash64(*keys, F.lit(seed))
    place = F.xxhash64(*keys, F.lit(f"place-{seed}"))

    def numbered(value: Column, rest: list[str]) -> DataFrame:
        # 24 top bits of the hash order the buckets, the full hash the rows
        rows = df.select(*rest, value.alias("_h"), *keys) if not set(keys) <= set(rest) else df.select(*rest, value.alias("_h"))
        rows = rows.withColumn("_b", F.floor(F.shiftrightunsigned("_h", 1) / (2**63 / buckets)).cast("int"))
        sizes = rows.groupBy("_b").agg(F.count("*").alias("_c"))
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offset = sizes.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
        inside = Window.partitionBy("_b").orderBy("_h", *keys)
        return rows.join(F.broadcast(offset), "_b").withColumn("_no", F.col("_o") + F.row_number().over(inside)).drop("_b", "_o", "_h")

    left = numbered(place, [c for c in df.columns if c != column])
    right = numbered(order, [column]).select("_no", column)
    return left.join(right, "_no").drop("_no")


def shuffle_test(prices: DataFrame, weights: DataFrame, seed: int = 0) -> DataFrame:
    return sharpe_of(prices, shuffle_column(weights, "weight", ["date", "ticker"], seed), "shuffled_sharpe")


# -- the ledger ---------------------------------------------------------------


def prediction_id(source: Column) -> Column:
    key = F.concat_ws("|", F.upper("ticker"), F.col("as_of").cast("string"), F.col("horizon_days").cast("string"), source)
    return F.substring(F.sha1(key), 1, 12)


def record(existing: DataFrame | None, records: DataFrame, source: str) -> DataFrame:
    """New predictions; ones on file are left out.

    A prediction is told by ticker, as-of date, horizon and source; the short id
    is a label.
    """
    rows = records.withColumn("source", F.lit(source)).withColumn("id", prediction_id(F.lit(source))).withColumn("_t", F.upper("ticker"))
    key = ["_t", "as_of", "horizon_days", "source"]
    rows = rows.dropDuplicates(key)
    if existing is not None:
        rows = rows.join(existing.select(F.upper("ticker").alias("_t"), *key[1:]), key, "left_anti")
    return rows.drop("_t")


#: What tells one prediction from another; the short id is a label that two may share.
LEDGER_KEY = ["ticker", "as_of", "horizon_days", "source"]


def resolve(predictions: DataFrame, prices: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Score predictions at the h-th bar after their own as-of bar.

    The as-of bar comes from one running carry over bars stacked with the
    predictions' dates, the terminal bar from an equi-join on the bar number.
    """
    todo = predictions
    if done is not None:
        on_file = done.select(F.upper("ticker").alias("_t"), *LEDGER_KEY[1:])
        todo = predictions.withColumn("_t", F.upper("ticker")).join(on_file, ["_t", *LEDGER_KEY[1:]], "left_anti").drop("_t")
    numbered = prices.filter("adj_close is not null").select(
        "ticker", "date", "adj_close", F.row_number().over(Window.partitionBy("ticker").orderBy("date")).alias("no")
    )
    marks = todo.select("ticker", F.col("as_of").alias("date")).distinct()
    stacked = numbered.withColumn("_mark", F.lit(False)).unionByName(marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True)
    upto = Window.partitionBy("ticker").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stacked.select(
        "ticker", "date", "_mark", F.max("no").over(upto).alias("no"), F.max_by("adj_close", "no").over(upto).alias("asof_price")
    ).filter("_mark and no is not null")
    entry = carried.select("ticker", F.col("date").alias("as_of"), "no", "asof_price")
    due = todo.join(entry, ["ticker", "as_of"]).withColumn("no", F.col("no") + F.col("horizon_days"))
    bars = numbered.select("ticker", "no", F.col("date").alias("matured_on"), F.col("adj_close").alias("terminal_price"))
    df = due.join(bars, ["ticker", "no"])
    return outcome(df)


def outcome(df: DataFrame) -> DataFrame:
    """Scores of matured predictions with ``matured_on``, ``terminal_price`` and ``asof_price``."""
    start = F.coalesce("entry_price", "asof_price")
    realized = F.col("terminal_price") / start - 1
    forecast = F.col("band_median") / start - 1
    up = F.coalesce(forecast >= 0, F.lit(True))
    return df.select(
        F.col("id").alias("prediction_id"), *LEDGER_KEY, "matured_on", "terminal_price",
        realized.alias("realized_return"), forecast.alias("forecast_return"),
        ((realized > 0) == up).alias("hit"),
        F.col("terminal_price").between(F.col("band_lo"), F.col("band_hi")).alias("in_band"),
    )


def ledger(predictions: DataFrame, resolutions: DataFrame) -> DataFrame:
    return predictions.join(resolutions.drop("prediction_id"), LEDGER_KEY, "left")


def pending(predictions: DataFrame, resolutions: DataFrame) -> DataFrame:
    return predictions.join(resolutions.select(*LEDGER_KEY), LEDGER_KEY, "left_anti")


def calibration_report(book: DataFrame) -> DataFrame:
    """Hit rate, band coverage and rank correlation by source and horizon."""
    done = book.filter("realized_return is not null")
    by = ("source", "horizon_days")
    stats = done.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg(F.col("in_band").cast("double")).alias("band_coverage"),
        F.avg("realized_return").alias("avg_realized"), F.avg("forecast_return").alias("avg_forecast"),
    )
    rho = ordinal_spearman(done, "conviction", "realized_return", "id", by)
    return stats.join(rho, list(by), "left")


def ordinal_spearman(df: DataFrame, x: str, y: str, tie: str, by: tuple[str, ...], least: int = 5) -> DataFrame:
    """Rank correlation with ties broken by ``tie``; null under five rows.

    The two permutations share mean and variance, so only the sum of squared
    rank differences is needed: 1 - 6 sum d^2 / (n (n^2 - 1)).
    """
    rows = df.filter(F.col(x).isNotNull()).select(*by, x, y, tie)
    ranks = ordinal_ranks(ordinal_ranks(rows, x, tie, "_rx", by), y, tie, "_ry", by)
    d = (F.col("_rx") - F.col("_ry")).cast("double")
    n = F.count("*").cast("double")
    rho = 1 - 6 * F.sum(d * d) / (n * (n * n - 1))
    return ranks.groupBy(*by).agg(F.when(F.count("*") >= least, rho).alias("conviction_ic"))


def horizon_hits(predictions: DataFrame, prices: DataFrame, targets: DataFrame, min_score: float = 0.003, top: int = 20) -> DataFrame:
    """Hit rate, mean return and the top picks of each horizon that has elapsed.

    ``targets`` is a small table (horizon, target_date); a horizon is measured
    at the last available date on or before its target, and only once the data
    reach the target.
    """
    last = prices.agg(F.max("date")).scalar()
    days = prices.select("date", F.col("date").alias("day")).distinct()
    asked = targets.filter(F.col("target_date") <= last)
    marked = days.unionByName(asked.select(F.col("target_date").alias("date")).distinct(), allowMissingColumns=True)
    carried = marked.select("date", F.max("day").over(Window.orderBy("date")).alias("day")).distinct()
    actual = asked.join(carried.withColumnRenamed("date", "target_date"), "target_date").select("horizon", "target_date", F.col("day").alias("date")).filter("date is not null")
    marks = actual.join(prices.select("date", "ticker", "adj_close"), "date")
    rows = predictions.filter("entry_price > 0").join(marks, "ticker").withColumn("ret", F.col("adj_close") / F.col("entry_price") - 1)
    rows = rows.withColumn("hit", ((F.col("score") > 0) == (F.col("ret") > 0)).cast("int"))
    order = Window.partitionBy("horizon").orderBy(F.desc("score"), "ticker")
    picks = rows.filter(F.col("score") >= min_score).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
    named = picks.groupBy("horizon").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "ticker"))), lambda s: s["ticker"]).alias("top_picks"))
    stats = rows.groupBy("horizon", "target_date", F.col("date").alias("actual_date")).agg(
        F.avg("hit").alias("hit_rate"), F.avg("ret").alias("mean_return"), F.count("*").alias("n")
    )
    return stats.join(named, "horizon", "left")
