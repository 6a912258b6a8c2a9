"""Exact ranks and order statistics over groups too large for one task.

A plain window sorts a whole group in one task.  Here each group is cut into
value ranges first: cut points come from an approximate quantile sketch (a few
dozen numbers per group), rows of equal value are counted together, and a
running count over ranges is added to the rank inside each range.  The ranks
are exact whatever the cut points are; they only balance the work, so their
number follows the session's shuffle width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.session import cut

RANGES = 32


def distinct_counts(df: DataFrame, value: str, by: tuple[str, ...] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and distinct value with its count (map-side combined)."""
    sums = [c.alias(n) for n, c in (extra or {}).items()]
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), *sums)


def running(counts: DataFrame, value: str, columns: list[str], by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Exact running totals of ``columns`` in value order within each group.

    ``ranges`` is the number of tasks a group is spread over, by default the
    session's shuffle partitions and at least ``RANGES``.
    """
    ranges = ranges or max(RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = cut(counts)  # read by the sketch and by both branches below
    sketch = counts.groupBy(*by).agg(
        F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(1000, 10 * ranges)).alias("_cuts")
    )
    # the same cut points must serve both branches below, so they are written
    sketch = cut(sketch)
    if by:
        placed = counts.join(sketch, list(by))
    else:
        placed = counts.withColumn("_cuts", sketch.select("_cuts").scalar())
    placed = placed.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns])
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(offsets, [*by, "_range"])
    return placed.select(
        *[c for c in counts.columns],
        *[(F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(f"upto_{c}") for c in columns],
    )


def running_in_ranges(counts: DataFrame, value: str, columns: list[str], by: tuple[str, ...]) -> DataFrame:
    """``running`` for many groups at once: one range partitioning of (group, value) serves all.

    Groups of any size share the ranges; each (group, range) adds what its group
    has in earlier ranges.
    """
    ranges = max(RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = counts.repartitionByRange(ranges, *by, value).sortWithinPartitions(*by, value)
    lined = cut(lined.withColumn("_range", F.spark_partition_id()))
    totals = lined.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns])
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = lined.join(offsets, [*by, "_range"])
    return placed.select(*counts.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(f"upto_{c}") for c in columns])


def average_ranks(df: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Tie-averaged rank of ``value`` inside each group, joined back by value."""
    counts = running(distinct_counts(df, value, by), value, ["_n"], by)
    ranks = counts.select(*by, value, (F.col("upto__n") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])


def placed(df: DataFrame, order: list[Column | str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """1-based place of every row in ``order`` within its group, groups of any size.

    Rows are cut into ranges of (group, order) by sampled borders, numbered
    inside, and each range adds the rows of its group in earlier ranges.
    """
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = df.repartitionByRange(ranges, *by, *order).sortWithinPartitions(*by, *order)
    # range numbers must be the same in both branches below, so they are written
    lined = cut(lined.withColumns({"_range": F.spark_partition_id(), "_line": F.monotonically_increasing_id()}))
    sizes = lined.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, "_range").orderBy("_line")
    return lined.join(offsets, [*by, "_range"]).withColumn(name, F.col("_o") + F.row_number().over(inside)).drop("_range", "_line", "_o")


def ordinal_ranks(df: DataFrame, value: str, tie: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank with ties in ``tie`` order; rows without a value or group are left out."""
    known = df.dropna(subset=[*by, value])
    return placed(known, [value, tie], name, by)


def order_statistic(df: DataFrame, value: str, position: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Value at 1-based ``position`` (an expression of the group size ``n``)."""
    counts = running(distinct_counts(df, value, by), value, ["_n"], by)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    found = counts.join(sizes, list(by)) if by else counts.withColumn("n", sizes.select("n").scalar())
    return found.filter(F.col("upto__n") >= position).groupBy(*by).agg(F.min(value).alias(value), F.first("n").alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation with tie-averaged ranks, groups of any size."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_ranks(average_ranks(pairs, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("ic"), F.count("*").alias("n"))
