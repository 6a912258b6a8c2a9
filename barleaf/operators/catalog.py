"""Feature catalog: which named columns a table holds and how well they are filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(family, feature, place, defined, present, filled): one row per catalogued name.

    ``filled`` is the share of non-null rows, null for a name the table lacks.
    One pass over the table counts every column; the catalog itself is fixed.
    """
    wanted = list(dict.fromkeys(c for names in groups.values() for c in names))
    present = [c for c in wanted if c in df.columns]
    rows = F.count("*").alias("_rows")
    counts = df.agg(rows, *[F.count(c).alias(c) for c in present])
    listed = [F.struct(F.lit(g).alias("family"), F.lit(c).alias("feature"), F.lit(i).alias("place"), F.lit(len(names)).alias("defined"), F.lit(c in present).alias("present"),
                       (F.col(c) / F.greatest("_rows", F.lit(1)) if c in present else F.lit(None).cast("double")).alias("filled"))
              for g, names in groups.items() for i, c in enumerate(names)]
    return counts.select(F.explode(F.array(*listed)).alias("r")).select("r.*")


def resolved(df: DataFrame, groups: dict[str, list[str]], wanted: list[str] | None = None, least: float = 0.6) -> DataFrame:
    """Features of the ``wanted`` groups (all by default) that the table holds and
    fills in at least ``least`` of its rows."""
    chosen = {g: groups[g] for g in (wanted or groups) if g in groups}
    return coverage(df, chosen).filter(F.col("present") & (F.col("filled") >= least)).select("family", "feature", "filled")


def report(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Defined and present names per group."""
    names = F.array_sort(F.collect_list(F.when(F.col("present"), F.struct("place", "feature"))))
    return coverage(df, groups).groupBy("family", "defined").agg(
        F.count_if("present").alias("present"), F.transform(names, lambda r: r["feature"]).alias("columns")
    )
