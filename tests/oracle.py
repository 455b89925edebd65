"""Compares registered queries with their SQL twins, value by value.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else 0.0 if value == 0 else value
    return value


def _kind(value) -> str:
    return "none" if value is None else type(value).__name__


def differences(spark_df, con, sql: str) -> list[str]:
    names = sorted(spark_df.columns)
    rows = [tuple(_cell(r[n]) for n in names) for r in spark_df.collect()]
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    if sorted(theirs) != names:
        return [f"columns {names} against {sorted(theirs)}"]
    at = [theirs.index(n) for n in names]
    expected = [tuple(_cell(r[i]) for i in at) for r in cursor.fetchall()]
    if len(rows) != len(expected):
        return [f"{len(rows)} rows against {len(expected)}"]
    out = []
    for i, n in enumerate(names):
        kinds = [{_kind(r[i]) for r in side} - {"none"} for side in (rows, expected)]
        if kinds[0] != kinds[1]:
            out.append(f"{n}: types {kinds[0]} against {kinds[1]}")
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    left, right = set(rows), set(expected)
    if left != right or sorted(rows, key=key) != sorted(expected, key=key):
        a, b = sorted(left - right, key=key)[:2], sorted(right - left, key=key)[:2]
        out.append(f"{len(left - right)} rows differ of {len(rows)}: {names} {a} against {b}")
    return out


def main(sf: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from keepwell.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = database(sf), oracle_sql(), 0
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = build(spark, sf)
            found = differences(df, con, sqls[name]) if name in sqls else [f"no SQL, {df.count()} rows"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if not found else found}", flush=True)
    print(f"{bad} with findings")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
