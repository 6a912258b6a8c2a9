"""Streaming queries: run to completion over the landed events, then read.

Batch twins of the same functions carry the SQL check; tests compare the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.plans.decision_queries import event_values, threshold_rules
from barleaf.plans.forecast_queries import RESOLVED, recorded
from barleaf.plans.registry import add_query
from barleaf.sources import files as S
from barleaf.sources import tables as T
from barleaf.streaming import live as L


def stream_ticks(s, d) -> DataFrame:
    """The events table read as a file stream."""
    batch = T.table(s, d, "events")
    raw = s.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("ticker"), F.col("value").alias("price"))


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has landed into Parquet and read it back.

    A complete result is written whole by every batch; update mode would keep
    only the last batch's keys, so it is refused.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"drain takes append or complete, not {mode}")
    spark = df.sparkSession
    out, state = S.fresh_path(spark, name), S.fresh_path(spark, f"{name}-state")
    writer = df.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.parquet(out)


TICKS = "ticks as (select event_id, ts, event_type as ticker, value as price from events)"
_BAR = "started ticker open:6 high:6 low:6 close:6 n:i"
_TEXT = "date_format(start, 'yyyy-MM-dd HH:mm:ss') as started"
BARS5 = """
out as (select strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M:%S') as started, ticker, arg_min(price, row(ts, event_id)) as open, max(price) as high, min(price) as low,
   arg_max(price, row(ts, event_id)) as close, count(*) as n from ticks group by 1, 2)"""
add_query("live_bars", _BAR, lambda s, d: L.bars(T.ticks(s, d)).selectExpr("*", _TEXT), TICKS, BARS5)
add_query("live_latest_price", "ticker price:6", lambda s, d: drain(L.latest_prices(stream_ticks(s, d)), "latest", "complete"), TICKS, "out as (select ticker, arg_max(price, row(ts, event_id)) as price from ticks group by 1)")
add_query("live_moving_average", "started ticker mean_price:8 n:i", lambda s, d: L.moving_average(T.ticks(s, d)).selectExpr("*", _TEXT), TICKS,
          "sl as (select time_bucket(interval '5 minutes', ts) - to_minutes(cast(5 * k as int)) as st, ticker, price from ticks, (select unnest(range(0, 4)) as k))",
          "out as (select strftime(st, '%Y-%m-%d %H:%M:%S') as started, ticker, avg(price) as mean_price, count(*) as n from sl group by 1, 2)")
# a window is written once the watermark, ten minutes behind the newest tick, has passed its end
add_query("live_bars_stream", _BAR, lambda s, d: drain(L.bars(stream_ticks(s, d)), "bars").selectExpr("*", _TEXT), TICKS,
          BARS5.replace("group by 1, 2)", "where time_bucket(interval '5 minutes', ts) + interval 5 minutes <= (select max(ts) from ticks) - interval 10 minutes group by 1, 2)"))


def rules(s, d):
    kinds = threshold_rules(s, d)
    t = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "error")]), F.col("p_partkey").cast("int") % 5 + 1)
    small = {c: (F.col(c) / 20).alias(c) for c in ("stop_below", "trim_above", "floor", "sell_below", "strength_lo", "strength_hi", "recovery_lo", "capitulation_below")}
    told = [F.min(c).alias(c) for c in ("event_key", "event_sell_value", "rating", "rating_below")]
    return kinds.withColumn("ticker", t).groupBy("ticker", "kind").agg(*told, *[F.min(v).alias(c) for c, v in small.items()])


ALERTS = [
    TICKS,
    """rl as (select ['click', 'view', 'purchase', 'signup', 'error'][p_partkey % 5 + 1] as ticker, ['stop_and_trim', 'floor', 'probation_band', 'exit_band', 'event_kill_switch', 'rating_review', 'hold', 'probation_floor'][p_size % 8 + 1] as kind,
        min(p_retailprice) / 20 as p, min(case when p_partkey % 4 <> 0 then ['click', 'view', 'raise'][p_partkey % 3 + 1] end) as event_key, min(case when p_size % 5 <> 0 then p_size % 7 end) as rating from part group by 1, 2)""",
    "ev as (select event_type as event_key, case when avg(value) > 49 then 'true' else 'false' end as event_value from events group by 1)",
    """al as (select ticker, kind, case when kind = 'stop_and_trim' and price < p * 2 then 'SELL ALL' when kind = 'stop_and_trim' and price > p * 6 then 'TRIM 1/2'
        when kind in ('floor', 'probation_floor') and price < p * 2.5 then 'SELL (hard floor)' when kind in ('floor', 'probation_floor') and event_value = 'true' then 'SELL (event)'
        when kind = 'probation_band' and price < p * 2 then 'SELL' when kind = 'probation_band' and price between p * 3 and p * 3.5 then 'SELL into strength' when kind = 'probation_band' and event_value = 'true' then 'SELL (event)'
        when kind = 'exit_band' and price >= p * 5 then 'SELL (recovery exit)' when kind = 'exit_band' and price < p * 1.5 then 'SELL (capitulation exit)'
        when kind = 'event_kill_switch' and event_value = 'true' then 'SELL SAME DAY' when kind = 'rating_review' and rating < 2 then 'REVIEW position' end as action from ticks join rl using (ticker) left join ev using (event_key))""",
    "out as (select ticker, kind, action, count(*) as n from al where action is not null group by 1, 2, 3)",
]
add_query(
    "live_threshold_alerts", "ticker kind action n:i", lambda s, d: drain(L.threshold_alerts(stream_ticks(s, d), rules(s, d), event_values(s, d)), "alerts").groupBy("ticker", "kind", "action").agg(F.count("*").alias("n")), *ALERTS,
)


def repeated(s, d):
    """The event stream read twice over: every article arrives two times."""
    t = stream_ticks(s, d)
    return L.unique_articles(t.unionByName(stream_ticks(s, d)))


add_query("live_unique_articles", "event_id:i ticker price:6", lambda s, d: drain(repeated(s, d), "unique"), TICKS, "out as (select event_id, ticker, price from ticks)")


def equity(s, d):
    return stream_ticks(s, d).select(F.col("ticker").alias("account"), "ts", "event_id", (F.col("price") + 1000).alias("equity"))


def run(df: DataFrame, write, name: str) -> None:
    """Run a stream through a foreachBatch writer until it has read what has landed."""
    state = S.fresh_path(df.sparkSession, f"{name}-state")
    df.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def peaks(s, d):
    log = L.EquityLog(S.fresh_path(s, "equity"))
    run(equity(s, d), log.write, "equity")
    log.finish(s)
    return log.read(s)


add_query(
    "live_equity_log", "account stamp equity:6 peak:6 drawdown:9", lambda s, d: peaks(s, d).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), TICKS,
    "out as (select ticker as account, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as stamp, price + 1000 as equity, max(price + 1000) over w as peak, (price + 1000 - max(price + 1000) over w) / max(price + 1000) over w as drawdown from ticks window w as (partition by ticker order by ts, event_id))",
)


# -- predictions against arriving prices ----------------------------------------


def landed(df: DataFrame, name: str) -> DataFrame:
    """A stream over a table's files."""
    path = S.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def with_rocksdb(s, build):
    """State with timers needs the RocksDB store, set for the run only."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return build()
    finally:
        s.conf.set(key, before)


def streamed_resolutions(s, d):
    prices = T.panel(s, d).select("ticker", "date", "adj_close")
    # a later bar of no listed name moves the watermark past the last real one
    end = prices.agg(F.lit("~end").alias("ticker"), F.date_add(F.max("date"), 10).alias("date"), F.lit(1.0).alias("adj_close"))
    calls = recorded(s, d).select("id", "ticker", "as_of", "horizon_days", "source", "entry_price", "band_lo", "band_median", "band_hi")
    return with_rocksdb(s, lambda: drain(L.resolutions(landed(calls, "calls"), landed(prices.unionByName(end), "prices")), "resolutions"))


add_query("ledger_resolve_stream", "prediction_id matured_on:d terminal_price realized_return:6 forecast_return:6 hit in_band", streamed_resolutions, *RESOLVED, relation="resolved")


# -- late rows and the alert sink ------------------------------------------------


def arrivals(s, d):
    """Ticks that travel up to seven hours, by a rule on their id."""
    return T.ticks(s, d).select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("arrived", F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(event_id * 7919 % 400 as int), 0)"))


add_query(
    "live_late_rows", "event_id:i behind:i", lambda s, d: L.late_rows(arrivals(s, d)).withColumn("behind", F.unix_timestamp("newest") - F.unix_timestamp("ts")), TICKS,
    "ar as (select event_id, ts, ts + to_minutes(cast(event_id * 7919 % 400 as int)) as arrived from ticks)",
    "sn as (select *, max(ts) over (order by arrived, event_id) as newest from ar)",
    "out as (select event_id, cast(floor(epoch(newest)) as bigint) - cast(floor(epoch(ts)) as bigint) as behind from sn where ts < newest - interval 10 minutes)",
)


def alerted(s, d):
    path = S.fresh_path(s, "alert-log")
    run(L.threshold_alerts(stream_ticks(s, d), rules(s, d), event_values(s, d)), L.alert_sink(path), "alert-log")
    back = s.read.schema("ticker string, kind string, action string, level string").json(f"{path}/batch=*")
    return back.groupBy("ticker", "kind", "action", "level").agg(F.count("*").alias("n"))


add_query("live_alert_log", "ticker kind action level n:i", alerted, *ALERTS, "log as (select *, 'ERROR' as level from out)", relation="log")
