"""Streams over several batches, out of order, against their batch twins."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from barleaf.operators import calibration as C
from barleaf.plans.stream_queries import drain, run, with_rocksdb
from barleaf.streaming import live
from tests.test_known_answers import START

T0 = dt.datetime(2024, 1, 1, 9)


def landed(spark, path, batches, schema):
    """A file stream that reads one batch after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/batch={k}")
        for part in os.listdir(f"{path}/batch={k}"):
            if part.endswith(".parquet"):
                os.utime(f"{path}/batch={k}/{part}", (1_700_000_000 + 100 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


# -- the equity log --------------------------------------------------------------

EQUITY = "account string, ts timestamp, event_id long, equity double"


def ticks(n=400, disorder=500, seed=5):
    """Rows of three accounts, one of them with most rows, up to ``disorder`` seconds out of order."""
    pick = random.Random(seed)
    rows = [(pick.choice(["hot", "hot", "hot", "b", "c"]), T0 + dt.timedelta(seconds=60 * (i // 2)), i, 1000.0 + pick.randint(-300, 300)) for i in range(n)]
    return rows, sorted(rows, key=lambda r: (r[1].timestamp() + pick.uniform(0, disorder), r[2]))


def slow_log(rows):
    peak, out = {}, set()
    for account, ts, i, value in sorted(rows, key=lambda r: (r[1], r[2])):
        peak[account] = max(value, peak.get(account, value))
        out.add((account, ts, i, value, peak[account]))
    return out


def log_rows(df):
    return {tuple(r)[:5] for r in df.select("account", "ts", "event_id", "equity", "peak").collect()}


@pytest.mark.parametrize("slice_seconds", [3600, 120])
def test_equity_log_of_an_unordered_stream(spark, tmp_path, slice_seconds):
    rows, arriving = ticks()
    batches = [arriving[k : k + 90] for k in range(0, len(arriving), 90)]
    log = live.EquityLog(str(tmp_path / "log"), late=600, slice_seconds=slice_seconds)
    run(landed(spark, str(tmp_path / "in"), batches, EQUITY), log.write, "equity")
    before = log_rows(log.read(spark))
    assert before < slow_log(rows)  # the newest rows wait for the watermark
    log.finish(spark)
    assert log.last == len(batches) and log.read(spark, "late").count() == 0
    assert log_rows(log.read(spark)) == slow_log(rows)
    assert log_rows(live.equity_log(spark.createDataFrame(rows, EQUITY), slice_seconds)) == slow_log(rows)


def test_equity_log_survives_a_repeated_batch_and_parts_late_rows(spark, tmp_path):
    log = live.EquityLog(str(tmp_path / "log"), late=60)
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    frame = lambda *rows: spark.createDataFrame(list(rows), EQUITY)
    log.write(frame(("a", at(0), 1, 100.0), ("a", at(10), 2, 90.0)), 0)
    second = frame(("a", at(9.5), 3, 120.0), ("a", at(3), 4, 500.0), ("a", at(20), 5, 60.0), (None, at(20), 6, 1.0))
    log.write(second, 1)
    log.write(second, 1)  # the same batch again, as after a lost driver
    log.finish(spark)
    assert log_rows(log.read(spark)) == {("a", at(0), 1, 100.0, 100.0), ("a", at(9.5), 3, 120.0, 120.0), ("a", at(10), 2, 90.0, 120.0), ("a", at(20), 5, 60.0, 120.0)}
    assert [r.event_id for r in log.read(spark, "late").collect()] == [4]  # nine minutes had been closed


def test_late_rows_by_arrival(spark):
    pick = random.Random(8)
    rows = [(i, T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i + pick.choice([0, 0, 5, 45, 200]))) for i in range(300)]
    want, newest = set(), T0
    for i, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if ts < newest - dt.timedelta(minutes=10):
            want.add(i)
        newest = max(newest, ts)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, arrived timestamp")
    for block in (3600, 60):
        assert {r.event_id for r in live.late_rows(df, block=block).collect()} == want
    assert 20 < len(want) < 280


# -- predictions -------------------------------------------------------------------

CALLS = "id string, ticker string, as_of date, horizon_days int, source string, entry_price double, band_lo double, band_median double, band_hi double"
PRICES = "ticker string, date date, adj_close double"


def day(n):
    return START + dt.timedelta(days=n)


def outcomes(df):
    return {(r.prediction_id, r.ticker, r.as_of, r.horizon_days, r.source, r.matured_on, r.terminal_price, r.realized_return, r.forecast_return, r.hit, r.in_band) for r in df.collect()}


def test_streamed_resolutions_equal_the_batch(spark, tmp_path):
    pick = random.Random(9)
    open_days = {t: [i for i in range(60) if pick.random() < 0.8] for t in ("A", "B", "C")}
    bars = [(t, day(i), 100.0 + pick.randint(-20, 20)) for t, days in open_days.items() for i in days]
    calls = [(f"{t}{i}{h}", t, day(i), h, "x", pick.choice([None, 100.0]), 80.0, pick.choice([None, 105.0, 95.0]), 120.0) for t in ("A", "B", "D") for i in range(-2, 58, 3) for h in (1, 5, 21, 200)]
    # two days out of order, a price told twice, a call told twice, and the calls of a day before its bars
    arriving = sorted(bars, key=lambda r: (r[1] + dt.timedelta(days=pick.choice([0, 0, 1, 2])), r[0]))
    arriving = [*arriving[:40], arriving[39], *arriving[40:]]
    prices = [arriving[k : k + 30] for k in range(0, len(arriving), 30)]
    made = sorted([*calls, calls[0]], key=lambda r: r[2])
    want = outcomes(C.resolve(spark.createDataFrame(calls, CALLS), spark.createDataFrame(bars, PRICES)))
    assert len(want) > 60
    end = [("~end", day(400), 1.0)]
    calls_in = landed(spark, str(tmp_path / "calls"), [made[k : k + 70] for k in range(0, len(made), 70)], CALLS)
    prices_in = landed(spark, str(tmp_path / "prices"), [*prices, end], PRICES)
    got = with_rocksdb(spark, lambda: drain(live.resolutions(calls_in, prices_in, "90 days"), "resolved"))
    assert got.count() == len(want) and outcomes(got) == want


def test_resolutions_wait_for_the_watermark(spark, tmp_path):
    """Nothing is scored while an earlier bar may still come."""
    call = [("p", "A", day(0), 2, "x", 100.0, 0.0, 110.0, 500.0)]
    # day 1 comes after day 3: without waiting, day 3 would count as the second bar
    prices = [[("A", day(0), 100.0), ("A", day(3), 130.0)], [("A", day(1), 110.0)], [("A", day(4), 140.0)], [("A", day(9), 150.0)]]
    calls_in = landed(spark, str(tmp_path / "calls"), [call], CALLS)
    got = with_rocksdb(spark, lambda: drain(live.resolutions(calls_in, landed(spark, str(tmp_path / "prices"), prices, PRICES), "3 days"), "resolved"))
    assert [(r.matured_on, r.terminal_price) for r in got.collect()] == [(day(3), 130.0)]


# -- the ledger's key ----------------------------------------------------------------


def test_predictions_of_equal_short_id_stay_apart(spark):
    calls = spark.createDataFrame([("same", "A", day(0), 1, "x", 100.0, 0.0, 110.0, 500.0), ("same", "B", day(0), 1, "x", 100.0, 0.0, 90.0, 500.0), ("same", "B", day(0), 9, "x", 100.0, 0.0, 90.0, 500.0)], CALLS)
    prices = spark.createDataFrame([(t, day(i), 100.0 + (10 if t == "A" else -10) * i) for t in "AB" for i in range(3)], PRICES)
    first = C.resolve(calls, prices)
    assert {(r.ticker, r.horizon_days, r.terminal_price, r.hit) for r in first.collect()} == {("A", 1, 110.0, True), ("B", 1, 90.0, True)}
    book = {(r.ticker, r.horizon_days): r.terminal_price for r in C.ledger(calls, first).collect()}
    assert book == {("A", 1): 110.0, ("B", 1): 90.0, ("B", 9): None}
    assert [(r.ticker, r.horizon_days) for r in C.pending(calls, first).collect()] == [("B", 9)]
    assert C.resolve(calls, prices, first.filter("ticker = 'A'")).select("ticker").collect() == [("B",)]


# -- places ---------------------------------------------------------------------------


def test_places_of_ties_with_a_common_start(spark):
    from barleaf.functions import ranking

    rows = [("g" if i % 3 else "h", float(i % 4 == 0), f"a-long-common-start-{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id string")
    out = ranking.ordinal_ranks(df, "v", "id", "r", ("g",)).collect()
    for g in "gh":
        mine = sorted((r.v, r.id) for r in out if r.g == g)
        assert {(r.v, r.id): r.r for r in out if r.g == g} == {x: i for i, x in enumerate(mine, 1)}
    assert len(out) == 3000
