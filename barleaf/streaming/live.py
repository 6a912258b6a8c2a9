"""Live prices, bars, alerts, deduplication and resolution as streams.

Every function takes a streaming (or batch) DataFrame of ticks
(event_id, ts, ticker, price) and returns one; sinks are set by the caller.
State is bounded by a watermark or holds one row per ticker.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barleaf.functions.windows import running_max
from barleaf.operators import calibration, tablerules


def latest_prices(ticks: DataFrame) -> DataFrame:
    """Newest price per ticker (update or complete mode); one state row each."""
    newest = F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id")).alias("r")
    return ticks.groupBy("ticker").agg(newest).select("ticker", "r.ts", "r.price")


def bars(ticks: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count per tumbling window; late rows beyond
    the watermark are dropped, and Spark counts them in its progress report."""
    at = F.struct("ts", "event_id")
    frame = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    out = frame.groupBy(F.window("ts", length), "ticker").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.count("*").alias("n"),
    )
    return out.select(F.col("window.start").alias("start"), "ticker", "open", "high", "low", "close", "n")


def moving_average(ticks: DataFrame, length: str = "20 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean price over sliding windows."""
    frame = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    out = frame.groupBy(F.window("ts", length, slide), "ticker").agg(F.avg("price").alias("mean_price"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "ticker", "mean_price", "n")


def threshold_alerts(ticks: DataFrame, rules: DataFrame, events: DataFrame) -> DataFrame:
    """Stream-static join of each tick to its ticker's rules; only what the
    batch rules call triggered at the tick's price passes."""
    status, action = tablerules.standing_verdict()
    rows = ticks.join(rules, "ticker").join(events.select("event_key", "event_value"), "event_key", "left")
    return rows.filter(status == "TRIGGERED").select("event_id", "ts", "ticker", "kind", "price", action.alias("action"))


def alert_sink(path: str):
    """foreachBatch writer: JSON lines per batch, rewritten whole if a batch is retried."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("level", F.lit("ERROR")).write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def unique_articles(articles: DataFrame, key: str = "event_id", ts: str = "ts", keep: str = "90 days") -> DataFrame:
    """First copy of each article within the retention time."""
    return articles.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key]) if articles.isStreaming else articles.dropDuplicates([key])


def resolving_sink(predictions: DataFrame, prices_path: str, out_path: str):
    """foreachBatch: append the batch's prices, resolve what has matured.

    For predictions that are on file whole; ``resolutions`` keeps them as state
    instead and reads no price twice.  What is already resolved is left out by
    an anti-join on its own key, so a retried batch or an overlapping one adds
    nothing twice.  Of two prices for a day the newest batch's counts.
    """
    kinds = dict(predictions.dtypes)
    key = ", ".join(f"{c} {kinds[c]}" for c in calibration.LEDGER_KEY)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("ticker", "date", "adj_close").write.mode("overwrite").parquet(f"{prices_path}/batch={number}")
        prices = spark.read.parquet(prices_path).groupBy("ticker", "date").agg(F.max_by("adj_close", F.struct("batch", "adj_close")).alias("adj_close"))
        done = spark.read.schema(key).parquet(f"{out_path}/batch=*") if number else None
        fresh = calibration.resolve(predictions, prices, done)
        fresh.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return write


# -- predictions, resolved as prices arrive -------------------------------------

_DAY_MS = 86_400_000
OPEN = ["id", "as_of", "horizon_days", "source", "entry_price", "band_lo", "band_median", "band_hi", "name"]
MATURED = "id string, ticker string, as_of date, horizon_days int, source string, entry_price double, band_lo double, band_median double, band_hi double, matured_on date, terminal_price double, asof_price double"


class Maturing(StatefulProcessor):
    """Per ticker the bars seen so far and the predictions still open.

    The bars are one row per date, so their state is bounded by the calendar;
    predictions leave the state when they mature.  A bar counts once the
    watermark has passed it: then no earlier one can come and its number is
    final.  One timer waits for the next bar at which something matures.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getValueState("bars", "days array<int>, prices array<double>")
        self.open = handle.getListState("open", "id string, as_of int, horizon_days int, source string, entry_price double, band_lo double, band_median double, band_hi double, name string")

    def _history(self) -> dict[int, float]:
        held = self.bars.get()
        return dict(zip(held[0], held[1])) if held is not None else {}

    def _waiting(self) -> list[tuple]:
        return list(self.open.get())

    @staticmethod
    def _due(days: np.ndarray, waiting: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Place of each prediction's as-of bar and of its maturing bar; -1 where not known."""
        as_of = np.array([p[1] for p in waiting], np.int64)
        at = np.searchsorted(days, as_of, side="right") - 1
        due = at + np.array([p[2] for p in waiting], np.int64)
        return at, np.where((at >= 0) & (due < len(days)), due, -1)

    def _arm(self, days: np.ndarray, waiting: list[tuple]) -> None:
        """Wait for the first bar at which an open prediction matures."""
        if not waiting or not len(days):
            return
        _, due = self._due(days, waiting)
        if (due >= 0).any():
            self.handle.registerTimer(int(days[due[due >= 0]].min()) * _DAY_MS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        history, waiting = self._history(), {tuple(p[1:4]): p for p in self._waiting()}
        for part in rows:
            for r in part.itertuples(index=False):
                if r.adj_close is not None and r.adj_close == r.adj_close:
                    history[int(r.day)] = float(r.adj_close)
                elif r.id is not None:
                    number = lambda v: None if v is None or v != v else float(v)
                    row = (r.id, int(r.as_of_day), int(r.horizon_days), r.source, number(r.entry_price), number(r.band_lo), number(r.band_median), number(r.band_hi), r.name)
                    waiting.setdefault(row[1:4], row)
        days = sorted(history)
        if days:
            self.bars.update((days, [history[d] for d in days]))
        if waiting:
            self.open.put(list(waiting.values()))
        self._arm(np.array(days, np.int64), list(waiting.values()))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        history, waiting = self._history(), self._waiting()
        if not waiting:
            return
        days = np.array(sorted(history), np.int64)
        at, due = self._due(days, waiting)
        final = timerValues.getCurrentWatermarkInMs() // _DAY_MS
        ripe = (due >= 0) & (np.where(due >= 0, days[due], 0) <= final)
        rest = [p for p, done in zip(waiting, ripe) if not done]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        self._arm(days, rest)
        day = lambda n: dt.date(1970, 1, 1) + dt.timedelta(days=int(n))
        out = [(p[0], p[8], day(p[1]), p[2], p[3], *p[4:8], day(days[due[i]]), history[int(days[due[i]])], history[int(days[at[i]])]) for i, p in enumerate(waiting) if ripe[i]]
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in MATURED.split(", ")])
            yield frame.astype({c: "float64" for c in ("entry_price", "band_lo", "band_median", "band_hi")})

    def close(self) -> None:
        pass


def resolutions(predictions: DataFrame, prices: DataFrame, late: str = "3 days") -> DataFrame:
    """Scores of predictions as their bars arrive, as ``calibration.resolve`` gives them.

    Both are streams: predictions as recorded, prices (ticker, date, adj_close)
    with one row per ticker and date, of which the newest counts.  A bar that
    comes more than ``late`` behind the newest one is dropped.  A prediction
    that is told twice while open counts once.
    """
    day = lambda c: F.unix_date(c)
    bars = prices.filter("adj_close is not null").select("ticker", F.col("date").cast("timestamp").alias("at"), day("date").alias("day"), F.col("adj_close").cast("double").alias("adj_close"))
    calls = predictions.select(
        "ticker", F.col("as_of").cast("timestamp").alias("at"), "id", day("as_of").alias("as_of_day"), F.col("horizon_days").cast("int").alias("horizon_days"), "source",
        *[F.col(c).cast("double").alias(c) for c in ("entry_price", "band_lo", "band_median", "band_hi")], F.col("ticker").alias("name"),
    )
    both = bars.unionByName(calls, allowMissingColumns=True).withWatermark("at", late)
    matured = both.groupBy("ticker").transformWithStateInPandas(statefulProcessor=Maturing(), outputStructType=MATURED, outputMode="Append", timeMode="EventTime")
    return calibration.outcome(matured)


# -- the equity log -------------------------------------------------------------


class EquityLog:
    """foreachBatch writer of equity with running peak and drawdown, in event-time order.

    Rows wait until the watermark (the newest time less ``late`` seconds) has
    passed them.  Closed rows are cut into slices of time: a slice takes its own
    running maximum, and only one row per slice, then the account's stored
    peak, carries over.  An account of any size is spread over its slices, and
    the state is one row per account.  Everything a batch writes is a folder of
    its own, so a retried batch replaces what it wrote.  Rows later than the
    watermark go to ``late``.

    ``equity``: account, ts, event_id, equity; rows without account are left out.
    """

    SCHEMA = "account string, ts timestamp, event_id long, equity double"

    def __init__(self, folder: str, late: int = 600, slice_seconds: int = 3600):
        self.folder, self.late, self.slice = folder, late, slice_seconds
        self.last = -1

    def _at(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/batch={number}"

    def write(self, batch: DataFrame, number: int) -> None:
        self._close(batch.select("account", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("equity").cast("double").alias("equity")), number, False)

    def finish(self, spark: SparkSession) -> None:
        """Close what still waits; call it once the stream has ended."""
        self._close(spark.createDataFrame([], self.SCHEMA), self.last + 1, True)

    def _close(self, rows: DataFrame, number: int, everything: bool) -> None:
        spark, first = rows.sparkSession, number == 0
        read = lambda kind, schema: spark.createDataFrame([], schema) if first else spark.read.schema(schema).parquet(self._at(kind, number - 1))
        peaks, marks = read("peaks", "account string, stored double"), read("mark", "mark timestamp")
        rows = rows.filter("account is not null")
        passed = marks.agg(F.max("mark")).scalar()
        rows.filter(F.col("ts") <= passed).write.mode("overwrite").parquet(self._at("late", number))
        fresh = rows.filter(passed.isNull() | (F.col("ts") > passed))
        waiting = fresh.unionByName(read("open", self.SCHEMA))
        newest = waiting.agg((F.max("ts") - F.expr(f"interval {0 if everything else self.late} seconds")).alias("mark"))
        newest.unionByName(marks).agg(F.max("mark").alias("mark")).write.mode("overwrite").parquet(self._at("mark", number))
        mark = spark.read.schema("mark timestamp").parquet(self._at("mark", number)).select("mark").scalar()
        waiting.filter(mark.isNull() | (F.col("ts") > mark)).write.mode("overwrite").parquet(self._at("open", number))
        closed = waiting.filter(F.col("ts") <= mark).withColumn("_slice", F.floor(F.unix_timestamp("ts") / self.slice))
        log = running_max(closed, "equity", "_run", ("account",), ("ts", "event_id"), "_slice").drop("_slice").join(peaks, "account", "left")
        log = log.withColumn("peak", F.greatest("_run", "stored")).drop("_run", "stored")
        log.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak")).write.mode("overwrite").parquet(self._at("log", number))
        tops = closed.select("account", F.col("equity").alias("stored")).unionByName(peaks).groupBy("account").agg(F.max("stored").alias("stored"))
        tops.write.mode("overwrite").parquet(self._at("peaks", number))
        self.last = number

    def read(self, spark: SparkSession, kind: str = "log") -> DataFrame:
        """All ``log`` or ``late`` rows written so far."""
        schema = self.SCHEMA + (", peak double, drawdown double" if kind == "log" else "")
        return spark.read.schema(schema).parquet(f"{self.folder}/{kind}/batch=*")


def equity_log(equity: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """The same log of a whole table."""
    rows = equity.filter("account is not null").withColumn("_slice", F.floor(F.unix_timestamp("ts") / slice_seconds))
    out = running_max(rows, "equity", "peak", ("account",), ("ts", "event_id"), "_slice").drop("_slice")
    return out.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def late_rows(arrivals: DataFrame, late: str = "10 minutes", block: int = 3600) -> DataFrame:
    """Rows that a watermark of ``late`` would drop: those more than ``late`` behind
    the newest time among the rows that arrived before them.

    ``arrivals``: event_id, ts, arrived (timestamp); rows arrive in the order of
    (arrived, event_id).
    """
    rows = arrivals.withColumn("_block", F.floor(F.unix_timestamp("arrived") / block))
    # a row is never behind itself, so the maximum may include it
    seen = running_max(rows, "ts", "newest", (), ("arrived", "event_id"), "_block").drop("_block")
    return seen.filter(F.col("ts") < F.col("newest") - F.expr(f"interval {late}"))


def standing_now(ticks: DataFrame, rules: DataFrame, events: DataFrame) -> DataFrame:
    """All standing rules at the latest price of each ticker."""
    return tablerules.standing_rules(rules, latest_prices(ticks), events)
