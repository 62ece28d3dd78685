"""Runs registered queries next to their oracle SQL and compares whole results.

    python -m tests.checking [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from marketpulse.schemas import GIVEN  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10] if str(value).endswith("00:00:00") else value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))


def kinds(types: dict[str, str]) -> dict[str, str]:
    families = {
        "int": "int", "bigint": "int", "hugeint": "int", "integer": "int", "smallint": "int",
        "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date",
    }
    return {k: families.get(v.lower(), v.lower()) for k, v in types.items()}


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    df = contract.queries()[name](spark, folder)
    columns = [c.to_pylist() for c in df.toArrow().columns]
    got = list(zip(*columns))
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)}"
    result = con.sql(sql)
    want = result.fetchall()
    spark_types = kinds({f.name: f.dataType.simpleString() for f in df.schema.fields})
    duck_types = kinds({c: str(t) for c, t in zip(result.columns, result.types)})
    left, right = rows_of(df.columns, got), rows_of(result.columns, want)
    if spark_types != duck_types:
        return False, f"types {spark_types} <> {duck_types}"
    if left == right:
        return True, f"{len(left)} rows"
    in_left, in_right = set(left), set(right)
    only_left = [r for r in left if r not in in_right][:3]
    only_right = [r for r in right if r not in in_left][:3]
    return False, f"{len(left)} vs {len(right)} rows; spark {only_left} oracle {only_right}"


if __name__ == "__main__":
    from marketpulse.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark, con = local_session("8"), connect(folder)
    bad = []
    for name in names:
        started = time.time()
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - started:.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
