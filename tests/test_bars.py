"""Daily bars: the order of lines within a day, and what a large table asks of the driver and of sorts."""

from __future__ import annotations

import contextlib
import io
import re

import numpy as np
import pandas as pd

from barleaf.sources import tables

SMALL = "/root/testdata/sf0.001"


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_bars_send_no_parts_through_the_driver_and_sort_few_lines(spark):
    assert not re.search(r"BroadcastHashJoin \[(l_partkey|o_custkey)", explained(tables.bars(spark, SMALL)))
    assert not re.search(r"\bSort(Aggregate)?[ (]", explained(tables.days(spark, SMALL)))
    for some in (tables.bars(spark, SMALL), tables.tone_series(spark, SMALL), tables.view_series(spark, SMALL), tables.brand_filings(spark, SMALL), tables.filings(spark, SMALL)):
        assert re.search(r"ShuffledHashJoin \[(l_partkey|o_custkey)", explained(some))


def test_bars_open_and_close_by_the_full_order_of_lines(spark, tmp_path):
    rng = np.random.default_rng(11)
    n = 4000
    lines = pd.DataFrame({
        "l_orderkey": pd.array(rng.integers(0, 60, n), dtype="Int64"), "l_linenumber": rng.integers(1, 3, n).astype("int32"), "l_partkey": rng.integers(0, 40, n),
        "l_suppkey": rng.integers(0, 3, n), "l_extendedprice": rng.integers(100, 9000, n) / 4, "l_quantity": rng.integers(1, 9, n).astype(float),
        "l_shipdate": pd.Timestamp("2000-01-01") + pd.to_timedelta(rng.integers(0, 20, n), unit="D"),
    }).drop_duplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    lines.loc[lines.index[::501], "l_orderkey"] = pd.NA
    parts = pd.DataFrame({"p_partkey": range(40), "p_brand": [f"Brand#{k % 3}" for k in range(40)]})
    spark.createDataFrame(parts).write.parquet(f"{tmp_path}/part.parquet")
    rows = spark.createDataFrame([[None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r] for r in lines.astype(object).values.tolist()], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["ticker"], str(r["date"])): r for r in tables.bars(spark, str(tmp_path)).collect()}

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    both = lines.merge(parts, left_on="l_partkey", right_on="p_partkey").sort_values(order, na_position="first")
    both["price"] = both.l_extendedprice / both.l_quantity
    groups = both.groupby(["p_brand", both.l_shipdate.dt.strftime("%Y-%m-%d")])
    assert len(got) == len(groups)
    for key, g in groups:
        r = got[key]
        assert (r["open"], r["close"], r["adj_close"]) == (g.price.iloc[0], g.price.iloc[-1], g.price.iloc[-1])
        assert (r["high"], r["low"], r["volume"]) == (g.price.max(), g.price.min(), int(g.l_quantity.sum()))
