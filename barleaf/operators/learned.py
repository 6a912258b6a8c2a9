"""Rules that learn from a trailing window, as joins to their fit dates."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.windows import by_ticker
from barleaf.operators import forecast as FC
from barleaf.operators import kernels as K

# The inputs of the three learned rules.
FOREST = ["mom_5d", "mom_20d", "mom_60d", "vol_20d", "rsi_14", "sma_gap_50", "sma_gap_200", "rel_vol_20", "dd_from_high_60", "excess_ret_1d"]
BOOSTED = ["mom_5d", "mom_20d", "mom_60d", "vol_20d", "rsi_14", "sma_gap_50", "sma_gap_200", "atr_14", "rel_vol_20", "dd_from_high_60", "excess_ret_1d"]
ATTRIBUTED = ["mom_5d", "mom_20d", "mom_60d", "vol_20d", "rsi_14", "sma_gap_50", "rel_vol_20", "excess_ret_1d"]


def numbered(f: DataFrame) -> DataFrame:
    """(date, i): dates from 0, one row each."""
    return f.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def labelled(f: DataFrame, columns: list[str], ahead: int) -> DataFrame:
    """Complete rows with the return ``ahead`` rows later, per ticker."""
    forward = F.lead("adj_close", ahead).over(by_ticker()) / F.col("adj_close") - 1
    return f.select("date", "ticker", *columns, forward.alias("fwd_ret")).dropna()


def best_rows(scored: DataFrame, k: int) -> DataFrame:
    """Weight 1/k for the k best of each date; other names get no row."""
    top = scored.withColumn("_r", K.rank_in_date("score")).filter(F.col("_r") <= k)
    return top.select("date", "ticker", F.lit(1.0 / k).alias("weight"))


def tree_signal(f: DataFrame, columns: list[str], classify: bool, every: int = 5, window: int = 252, k: int = 8, refit: int = 252) -> DataFrame:
    """Top-k by a forest (or boosted trees) fitted on the ``window`` dates before.

    Fits run every ``refit`` dates and score the rebalance dates up to the next
    one; labels that reach past the fit date are left out of it.  The driver
    loops over the few fits, rows stay distributed.
    """
    rows = labelled(f, columns, every)
    dates = numbered(rows)
    rows = VectorAssembler(inputCols=columns, outputCol="x").transform(rows.join(dates, "date"))
    rows = rows.select("i", "date", "ticker", "x", F.col("fwd_ret"), (F.col("fwd_ret") > 0).cast("double").alias("up"))
    last = dates.agg(F.max("i").alias("i")).first()["i"]
    out = None
    for start in range(window, last + 1, refit):
        train = rows.filter((F.col("i") >= start - window) & (F.col("i") < start - every))
        ask = rows.filter((F.col("i") >= start) & (F.col("i") < start + refit) & ((F.col("i") - window) % every == 0))
        if classify:
            model = RandomForestClassifier(featuresCol="x", labelCol="up", numTrees=50, maxDepth=4, seed=42).fit(train)
            score = F.get(vector_to_array("probability"), F.lit(1))
        else:
            model = GBTRegressor(featuresCol="x", labelCol="fwd_ret", maxIter=20, maxDepth=4, stepSize=0.05, seed=42).fit(train)
            score = F.col("prediction")
        part = model.transform(ask).select("date", "ticker", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return K.rebalance(best_rows(out, k), f, every)


def attribution_signal(f: DataFrame, every: int = 21, window: int = 252, k: int = 8) -> DataFrame:
    """Top-k by the sum of positive linear contributions, refitted every
    rebalance date from rolled product sums."""
    rows = labelled(f, ATTRIBUTED, 5)
    models = FC.trailing_fits(rows, ATTRIBUTED, "fwd_ret", every, window)
    scored = rows.join(models, "date")
    positive = sum(F.greatest(c, F.lit(0.0)) for c in FC.linear_contributions(ATTRIBUTED))
    return K.rebalance(best_rows(scored.select("date", "ticker", positive.alias("score")), k), f, every)


def cluster_parity(f: DataFrame, every: int = 63, window: int = 252, n: int = 20) -> DataFrame:
    """Low and high volatility halves at 0.5 each, inverse volatility inside.

    Each row joins the few anchors whose trailing window holds it; a day without
    a return counts as 0, as in a filled matrix.
    """
    dates = numbered(f)
    rows = f.select("date", "ticker", "ret_1d", "mom_20d").join(dates, "date")
    last = dates.agg(F.max("i")).scalar()
    first, final = F.ceil(F.col("i") / every).cast("int"), F.floor(F.least(F.col("i") + window, last) / every).cast("int")
    held = rows.filter(final >= first).select("*", F.explode(F.sequence(first, final)).alias("_k")).withColumn("_a", F.col("_k") * every)
    inside = F.when(F.col("_a") - F.col("i") < window, F.coalesce("ret_1d", F.lit(0.0)))
    length = F.least(F.col("_a") + 1, F.lit(window))
    stats = held.groupBy("_a", "ticker").agg(F.sum(inside).alias("s1"), F.sum(inside * inside).alias("s2"), F.coalesce(F.avg("mom_20d"), F.lit(0.0)).alias("mom"))
    book = Window.partitionBy("_a")
    vol = F.sqrt(F.greatest(F.coalesce("s2", F.lit(0.0)) / length - F.pow(F.coalesce("s1", F.lit(0.0)) / length, 2), F.lit(0.0))) + 1e-8
    df = stats.withColumn("vol", vol).withColumn("_n", F.count("*").over(book)).filter((F.col("_n") >= 4) & (length >= 30))
    df = df.withColumn("_low", F.row_number().over(book.orderBy("vol", "ticker")) <= F.floor(F.col("_n") / 2))
    df = df.withColumn("w", 0.5 / F.col("vol") / F.sum(1.0 / F.col("vol")).over(Window.partitionBy("_a", "_low")))
    df = df.withColumn("_m", F.row_number().over(book.orderBy(F.desc("mom"), F.desc("ticker")))).filter(F.col("_m") <= n)
    df = df.withColumn("weight", F.col("w") / F.sum("w").over(book)).join(dates.withColumnRenamed("i", "_a"), "_a")
    return K.rebalance(df.filter("weight > 0").select("date", "ticker", "weight"), f, every)


# -- seeded random numbers ------------------------------------------------------


def uniform(*key) -> Column:
    """A number in [0, 1) that follows the key alone: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def choice(n: Column, *key) -> Column:
    """A whole number under ``n`` from other bits of the same hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 14, 8), 16, 10).cast("long") % n


def beta_draw(a: Column, b: Column, *key) -> Column:
    """A draw from Beta(a, b) for whole a and b: of a + b - 1 uniform numbers the a-th smallest."""
    numbers = F.transform(F.sequence(F.lit(1), (a + b - 1).cast("int")), lambda j: uniform(*key, j.cast("string")))
    return F.get(F.array_sort(numbers), (a - 1).cast("int"))


# -- isolation forests ------------------------------------------------------------

TREES, SAMPLE, SEED = 100, 256, 42


def mean_path(n: Column) -> Column:
    """Expected path length of an unsuccessful search among ``n`` random keys."""
    m = n.cast("double")
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(F.greatest(m - 1, F.lit(1.0))) + 0.5772156649015329) - 2 * (m - 1) / m)


def isolation_scores(rows: DataFrame, columns: list[str], by: str = "date", name: str = "ticker", trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(by, name, score) of an isolation forest per group; the lower, the easier to isolate.

    Every tree takes up to ``sample`` names of its group.  A node splits on one
    of the columns that vary in it, at a uniform place in the range of its
    sample, and the trees of all groups grow level by level: a level is a
    minimum and a maximum per node.  Rows are laid out by (group, tree) once;
    a row keeps its node and, when it reaches a leaf, its path.  All random
    numbers follow (seed, group, tree, node).
    """
    spread = rows.select(by, name, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(n, by, "tree")
    group = Window.partitionBy(by, "tree")
    order = group.orderBy(uniform(F.lit(f"{seed}"), F.col(by).cast("string"), F.col("tree").cast("string"), F.col(name)), name)
    df = spread.withColumns({"_in": F.row_number().over(order) <= sample, "_psi": F.least(F.count("*").over(group), F.lit(sample))})
    df = df.withColumns({"_node": F.lit(1).cast("long"), "_path": F.lit(None).cast("double")})
    node = Window.partitionBy(by, "tree", "_node")
    deepest = F.ceil(F.log2(F.greatest("_psi", F.lit(2)).cast("double")) - 1e-9)
    for depth in range(math.ceil(math.log2(sample)) + 1):
        mine = [F.when(F.col("_in"), F.get("x", F.lit(j))) for j in range(len(columns))]
        ranges = F.array(*[F.struct(F.lit(j).alias("j"), F.min(c).over(node).alias("lo"), F.max(c).over(node).alias("hi")) for j, c in enumerate(mine)])
        df = df.withColumns({"_ranges": ranges, "_size": F.count(F.when(F.col("_in"), 1)).over(node)})
        df = df.withColumn("_live", F.filter("_ranges", lambda r: r["hi"] > r["lo"])).drop("_ranges")
        leaf = (F.col("_size") <= 1) | (F.lit(depth) >= deepest) | (F.size("_live") == 0)
        df = df.withColumn("_path", F.coalesce("_path", F.when(leaf, F.lit(float(depth)) + mean_path(F.col("_size")))))
        key = F.lit(f"{seed}"), F.col(by).cast("string"), F.col("tree").cast("string"), F.col("_node").cast("string")
        pick = F.get("_live", choice(F.greatest(F.size("_live"), F.lit(1)), *key).cast("int"))
        df = df.withColumn("_pick", pick)
        at = F.col("_pick.lo") + uniform(*key) * (F.col("_pick.hi") - F.col("_pick.lo"))
        right = (F.get("x", F.col("_pick.j")) > at).cast("long")
        # a row that has its path stays in its node and no longer matters
        df = df.withColumn("_node", F.when(F.col("_path").isNull(), 2 * F.col("_node") + right).otherwise(F.col("_node"))).drop("_live", "_size", "_pick")
    paths = df.groupBy(by, name).agg(F.avg("_path").alias("_mean"), F.first("_psi").alias("_psi"))
    return paths.select(by, name, F.round(-F.pow(F.lit(2.0), -F.col("_mean") / F.greatest(mean_path(F.col("_psi")), F.lit(1e-12))), 10).alias("score"))


def normal_names(f: DataFrame, every: int = 21, k: int = 8, contamination: float = 0.1) -> DataFrame:
    """Momentum leaders among names that an isolation forest finds normal.

    A name whose score is under the date's ``contamination`` quantile is left out.
    """
    columns = "mom_20d vol_20d rsi_14 rel_vol_20 sma_gap_50 dd_from_high_60".split()
    rows = f.select("date", "ticker", *columns).dropna()
    kept = K.kept_dates(rows, every).select("date")
    day = Window.partitionBy("date")
    df = rows.join(kept, "date", "left_semi").withColumn("_n", F.count("*").over(day)).filter("_n >= 10")
    scores = isolation_scores(df, columns)
    scores = scores.withColumn("_limit", F.percentile("score", F.lit(contamination)).over(day)).filter(F.col("score") >= F.col("_limit") - 1e-9)
    df = df.join(scores.select("date", "ticker"), ["date", "ticker"])
    df = df.withColumn("_r", K.rank_in_date("mom_20d")).filter(F.col("_r") <= k)
    signal = df.select("date", "ticker", (1.0 / F.count("*").over(day)).alias("weight"))
    return K.rebalance(signal, f, every)


def quintile(c: str, n: Column, buckets: int) -> Column:
    place = F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy("date").orderBy(F.col(c).asc_nulls_last(), "ticker")) - 1)
    return F.least(F.floor(place / n * buckets), F.lit(buckets - 1)).cast("int")


def bandit(f: DataFrame, every: int = 5, buckets: int = 5, k: int = 8, seed: int = SEED) -> DataFrame:
    """Momentum quintile with the best draw from its posterior of past day signs.

    The counts never depend on the choice, so they are running sums over
    rebalance dates; a quintile's draw follows (seed, date number, quintile).
    """
    dates = numbered(f)
    rows = f.select("date", "ticker", "mom_20d", "ret_1d").join(dates, "date")
    day = rows.filter("mom_20d is not null").withColumn("_n", F.count("*").over(Window.partitionBy("date")))
    day = day.filter((F.col("i") % every == 0) & (F.col("_n") >= buckets * 2)).withColumn("bucket", quintile("mom_20d", F.col("_n"), buckets))
    past = rows.filter("ret_1d is not null").withColumn("_n", F.count("*").over(Window.partitionBy("date")))
    past = past.filter((F.col("i") + 1) % every == 0).withColumn("bucket", quintile("mom_20d", F.col("_n"), buckets)).filter("bucket is not null")
    signs = past.groupBy("i", "bucket").agg((F.avg("ret_1d") > 0).cast("int").alias("won")).select((F.col("i") + 1).alias("i"), "bucket", "won")
    asked = day.select("i").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    before = Window.partitionBy("bucket").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    state = asked.join(signs, ["i", "bucket"], "left").select(
        "i", "bucket", F.coalesce(F.sum("won").over(before), F.lit(0)).alias("a"), F.coalesce(F.count("won").over(before), F.lit(0)).alias("n")
    )
    draw = beta_draw(1 + F.col("a"), 1 + F.col("n") - F.col("a"), F.lit(f"{seed}"), F.col("i").cast("string"), F.col("bucket").cast("string"))
    best = state.withColumn("draw", draw).groupBy("i").agg(F.max_by("bucket", F.struct("draw", -F.col("bucket"))).alias("bucket"))
    top = day.join(best, ["i", "bucket"]).withColumn("_r", K.rank_in_date("mom_20d")).filter(F.col("_r") <= k)
    signal = top.select("date", "ticker", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))
    return K.rebalance(signal, f, every)


MOMENTA = ["mom_5d", "mom_10d", "mom_20d", "mom_60d", "mom_120d"]


def evolving(f: DataFrame, every: int = 21, window: int = 63, k: int = 8) -> DataFrame:
    """Momentum column with the best fading score of its past leaders' returns.

    A column's score at a date is a sum of earlier windows' mean/deviation with
    weights 0.1 * 0.9**age; the window figures come from sums rolled by date.
    """
    dates = numbered(f)
    rows = f.select("date", "ticker", "ret_1d", *MOMENTA).join(dates, "date")
    long = rows.select("i", "date", "ticker", "ret_1d", F.explode(F.array(*[F.struct(F.lit(j).alias("c"), F.col(m).alias("v")) for j, m in enumerate(MOMENTA)])).alias("p")).select("i", "date", "ticker", "ret_1d", "p.*").filter("v is not null")
    led = long.filter("ret_1d is not null").withColumn("_r", K.rank_in_date("v", by=("date", "c"))).filter(F.col("_r") <= k)
    daily = led.groupBy("c", "i").agg(F.sum("ret_1d").alias("s1"), F.sum(F.col("ret_1d") * F.col("ret_1d")).alias("s2"), F.count("*").alias("n"))
    anchors = dates.filter((F.col("i") >= window) & ((F.col("i") - window) % every == 0)).select("date", F.col("i").alias("a"), ((F.col("i") - window) / every).cast("int").alias("g"))
    # each day belongs to the few anchors whose window holds it
    first, last = F.ceil((F.col("i") + 1 - window) / every).cast("int"), F.floor(F.col("i") / every).cast("int")
    spread = daily.withColumn("g", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, first, F.lit(0))))).filter((F.col("i") >= F.col("g") * every) & (F.col("i") < F.col("g") * every + window))
    sums = spread.groupBy("c", "g").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))
    mean = F.col("s1") / F.col("n")
    dev = F.sqrt((F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1))
    grid = anchors.select("g", F.explode(F.sequence(F.lit(0), F.lit(len(MOMENTA) - 1))).alias("c")).join(sums, ["g", "c"], "left")
    grid = grid.withColumn("x", F.when(F.col("n") > 1, mean / dev))
    seen = Window.partitionBy("c").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    # only windows with data age the score, so age counts them
    grid = grid.withColumn("_t", F.count("x").over(Window.partitionBy("c").orderBy("g")))
    total = F.sum(0.1 * F.col("x") * F.pow(F.lit(0.9), -F.col("_t"))).over(seen) * F.pow(F.lit(0.9), F.count("x").over(seen))
    best = grid.withColumn("score", F.coalesce(total, F.lit(0.0))).groupBy("g").agg(F.max_by("c", F.struct(F.round("score", 12), -F.col("c"))).alias("c"))
    picks = long.join(anchors.join(best, "g").select("date", "c"), ["date", "c"]).withColumn("_r", K.rank_in_date("v")).filter(F.col("_r") <= k)
    signal = picks.select("date", "ticker", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))
    return K.rebalance(signal, f, every)
