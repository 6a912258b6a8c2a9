"""Adapters from the landed tables to panel shapes.

Each adapter aggregates to one row per key before any window runs, with Spark's
map-side partial aggregation, so a key that holds a third of the raw rows
reaches the reducers as one partial row per input task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barleaf.session import staged

BENCHMARK = "Brand#1"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_owner(spark: SparkSession, rows: DataFrame, key: str, folder: str, name: str, owner: str, label: str) -> DataFrame:
    """``rows`` with ``label`` of the part or customer they name.

    Both tables grow together, so both are dealt by key.  Left to itself Spark
    sends the smaller one whole through the driver as long as its file is small.
    """
    owners = table(spark, folder, name).select(F.col(owner).alias(key), F.col(label).alias("ticker"))
    return rows.join(owners.hint("shuffle_hash"), key)


def branded(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    """``lines`` with the brand of their part as ``ticker``."""
    return with_owner(spark, lines, "l_partkey", folder, "part", "p_partkey", "p_brand")


def days(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, date) with what any order of lines gives, and the least and the largest order of the day.

    Every buffer is of fixed size, so lines are summed in hash tables and never sorted.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_orderkey", "l_quantity", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    # an order without a number comes before all others, as in the order of structs
    least = F.when(F.count("l_orderkey") == F.count("*"), F.min("l_orderkey"))
    return branded(spark, folder, lines).groupBy("ticker", "date").agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum("l_quantity").cast("long").alias("volume"),
        least.alias("least"), F.max("l_orderkey").alias("largest"),
    )


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per brand: unit price of each line, ordered within the day.

    A day's first and last line belong to its least and largest order, so only
    the lines of such orders are brought into their full order; the other
    figures need none (``days``, written once).
    """
    daily = staged(spark, f"days:{folder}", lambda: days(spark, folder))
    ends = daily.select(F.explode(F.array("least", "largest")).alias("_order")).distinct()
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    few = lines.join(ends, F.col("l_orderkey").eqNullSafe(F.col("_order")), "left_semi")
    prices = branded(spark, folder, few).groupBy("ticker", "date").agg(F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"))
    prices = prices.withColumnsRenamed({"ticker": "_ticker", "date": "_date"})
    return (
        daily.join(prices, F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("date").eqNullSafe(F.col("_date")))
        .withColumn("adj_close", F.col("close"))
        .select("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")
    )


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Sanitised bars, written once per application and read back."""
    from barleaf.operators.quality import sanitize_bars

    return staged(spark, f"panel:{folder}", lambda: sanitize_bars(bars(spark, folder)).repartition("ticker"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("event_type").alias("ticker"), F.col("value").alias("price"), "user_id", "props"
    )


# Filing form given to each order priority of the landed orders.
FORMS = {
    "1-URGENT": "8-K",
    "2-HIGH": "4",
    "3-MEDIUM": "4/A",
    "4-NOT SPECIFIED": "424B5",
    "5-LOW": "10-Q",
}


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: market segment as the filer, priority as the form."""
    form = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in FORMS.items()])
    orders = table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), form.alias("form"))
    return with_owner(spark, orders, "o_custkey", folder, "customer", "c_custkey", "c_mktsegment").select("ticker", "date", "form")


def filing_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Panel the filing features sit on: every segment on every order date
    that has an urgent order somewhere."""
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    days = urgent.select(F.to_date("o_orderdate").alias("date")).distinct()
    names = table(spark, folder, "customer").groupBy().agg(F.collect_set("c_mktsegment").alias("names"))
    return days.select("date", F.explode(names.select("names").scalar()).alias("ticker"))


def macro_series(spark: SparkSession, folder: str) -> DataFrame:
    """Two daily series of order value, long form (date, series_id, value).

    The peak series only prints on days with a blocked order, so the two
    calendars differ.
    """
    orders = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderstatus")
    daily = orders.groupBy("date").agg(
        F.avg("o_totalprice").alias("level"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("peak"),
    )
    return daily.unpivot("date", ["level", "peak"], "series_id", "value").filter("value is not null")


def tone_series(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse daily tone and volume per brand, from returned lines.

    Rates are decimal figures held in doubles: they are summed as decimals, so a
    mean is the same in any order of lines, and one of exactly 0.03 is 0.03.
    """
    rate = lambda c: F.col(c).cast("decimal(18,10)")
    lines = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), (rate("l_discount") - rate("l_tax")).alias("tone")
    )
    mean = (F.sum("tone") / F.count("tone")).cast("double")
    return branded(spark, folder, lines).groupBy("ticker", "date").agg(
        mean.alias("gdelt_tone"), F.count("*").alias("gdelt_vol")
    )


def view_series(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse daily attention counts per brand, from open lines."""
    lines = table(spark, folder, "lineitem").filter("l_linestatus = 'O'").select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), "l_quantity"
    )
    return branded(spark, folder, lines).groupBy("ticker", "date").agg(
        F.sum("l_quantity").cast("long").alias("wiki_views")
    )


def news(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as point-in-time events, one hour apart from a fixed epoch.

    The invented prose holds no lexicon words, so the scores come from the
    document's length; texts travel whole.
    """
    docs = table(spark, folder, "documents")
    known = F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 3600)
    score = (F.col("n_chars") % 201) / 100.0 - 1.0
    flags = F.when(F.col("n_chars") > 4000, F.array(F.lit("long"), F.lit("review"))).when(
        F.col("n_chars") > 2000, F.array(F.lit("long"))
    )
    return docs.select(
        F.col("doc_id").alias("event_id"),
        "source",
        F.concat(F.lit("doc/"), "doc_id").alias("source_url"),
        known.alias("published_at"),
        known.alias("known_at"),
        F.array("source", "lang").alias("tickers"),
        F.array(F.col("lang")).alias("sectors"),
        F.when(F.col("doc_id") % 2 == 0, "news").otherwise("note").alias("event_type"),
        score.cast("double").alias("sentiment"),
        F.lit(0.45).alias("confidence"),
        (F.col("doc_id") % 10 / 10.0).cast("double").alias("novelty"),
        (F.col("n_chars") % 100 / 100.0).cast("double").alias("magnitude"),
        F.lit("1d").alias("time_horizon"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("summary"),
        F.col("text").alias("content"),
        F.coalesce(flags, F.array().cast("array<string>")).alias("risk_flags"),
        F.when(F.col("n_chars") % 3 != 0, score).cast("double").alias("finbert_sentiment"),
    )


def news_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per source and day of the known range: the text features' panel."""
    days = table(spark, folder, "documents").select(
        F.to_date(F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 3600)).alias("date"), "source"
    )
    names = days.groupBy().agg(F.collect_set("source").alias("names"))
    return days.select("date").distinct().select("date", F.explode(names.select("names").scalar()).alias("ticker"))


# -- sources keyed by the brands of the bars ------------------------------------

BRANDS = 25


def brand_news(spark: SparkSession, folder: str) -> DataFrame:
    """The news events dealt to brands, over the years that the bars cover."""
    day = F.lit(788918400) + (F.col("event_id") * 37 % 2400) * 86400 + 3600
    brand = F.concat(F.lit("Brand#"), (F.col("event_id") % BRANDS + 1).cast("string"))
    return news(spark, folder).withColumns({"known_at": F.timestamp_seconds(day), "tickers": F.array(brand)})


def brand_filings(spark: SparkSession, folder: str) -> DataFrame:
    """One filing per line: the order's date and priority, the part's brand."""
    form = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in FORMS.items()])
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), form.alias("form"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    return branded(spark, folder, lines).join(orders, lines.l_orderkey == orders.o_orderkey).select("ticker", "date", "form")


def meetings(spark: SparkSession, folder: str) -> DataFrame:
    """(event_name, date): days whose largest order is pending are rate meetings,
    days whose smallest one is are price reports."""
    size = F.struct("o_totalprice", "o_orderkey")
    daily = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max_by("o_orderstatus", size).alias("FOMC Meeting"), F.min_by("o_orderstatus", size).alias("CPI"))
    return daily.unpivot("date", ["FOMC Meeting", "CPI"], "event_name", "status").filter("status = 'P'").select("event_name", "date")
