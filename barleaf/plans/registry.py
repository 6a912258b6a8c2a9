"""Named queries and, where SQL can say the same thing, their DuckDB text.

Both sides present results alike: dates as ISO text, doubles rounded to a stated
number of digits with negative zero folded, integers as 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def fields(spec: str) -> list[tuple[str, str]]:
    """``date:d ticker weight:9 n:i`` -> [(name, kind)]; digits mean rounding."""
    return [tuple((item + ":").split(":")[:2]) for item in spec.split()]


def present(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in fields(spec):
        c = F.col(name)
        if kind == "d":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("long")
        elif kind.isdigit():
            r = F.round(c.cast("double"), int(kind))
            c = F.when(r == 0, 0.0).otherwise(r)
        out.append(c.alias(name))
    return df.select(*out)


def present_sql(relation: str, spec: str) -> str:
    out = []
    for name, kind in fields(spec):
        if kind == "d":
            e = f"cast({name} as varchar)"
        elif kind == "i":
            e = f"cast({name} as bigint)"
        elif kind.isdigit():
            r = f"round(cast({name} as double), {kind})"
            e = f"case when {r} = 0 then cast(0 as double) else {r} end"
        else:
            e = name
        out.append(f"{e} as {name}")
    return f"select {', '.join(out)} from {relation}"


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts)


def add_query(name: str, spec: str, build: Query, *parts: str, relation: str = "out") -> None:
    """Register a query; ``parts`` are the oracle's CTEs, the last feeding out."""
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = lambda spark, folder: present(build(spark, folder), spec)
    if parts:
        ORACLES[name] = f"{ctes(*parts)}\n{present_sql(relation, spec)}"
