"""Helpers shared by the corpus operators: inputs, stored intermediates, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barleaf.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """The session's shuffle width, which a cluster job sets to fit its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder that all executors reach."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    Each value of the columns ``folders``, the last ones, gets a folder, so a filter on them reads only its own.
    """
    path = fresh(df.sparkSession, label)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` as ``(node, label)``, label the smallest node.

    Alternating large and small stars (Kiveris et al. 2014): every round is two
    keyed minima and two joins, the number of edges never grows, and chains
    shrink geometrically.  Null ends and self links are ignored; nodes without
    any link do not appear.  The graph never leaves the executors.  A round's edges
    are written as Parquet, so that few edges are read by few tasks and small sides
    are broadcast, whatever the shuffle's width.
    """

    def both(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select("lo", "hi")).toDF("u", "v")

    def state(edges: DataFrame) -> tuple:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003), F.sum(F.xxhash64("lo", "hi") % 998_244_353)).first()
        return tuple(row)

    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = stored(edges, "edges")
    before = state(edges)
    while before[0]:
        sym = both(edges)
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
