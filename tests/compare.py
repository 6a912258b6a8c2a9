"""Run a query on Spark and its SQL on DuckDB and compare the two results."""

from __future__ import annotations

import hashlib
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v) -> str:
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return "[" + ",".join(cell(x) for x in list(v)) + "]"
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str, list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(cell(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def spark_side(df):
    rows = [tuple(r) for r in df.collect()]
    return sorted(df.columns), digest(df.columns, rows)


def duck_side(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), digest(names, cur.fetchall())


def compare(spark, con, folder, query, sql):
    t = time.time()
    cols, (n, h, lines) = spark_side(query(spark, folder))
    took = time.time() - t
    t = time.time()
    names, (m, g, other) = duck_side(con, sql)
    return {
        "match": cols == names and h == g,
        "columns": (cols, names),
        "rows": (n, m),
        "spark_s": round(took, 2),
        "duck_s": round(time.time() - t, 2),
        "only_spark": sorted(set(lines) - set(other))[:3],
        "only_duck": sorted(set(other) - set(lines))[:3],
        "n_diff": len(set(lines) ^ set(other)),
    }
