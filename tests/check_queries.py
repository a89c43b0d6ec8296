"""Run registered queries next to their SQL: ``python tests/check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as E  # noqa: E402
from codeloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v: object) -> object:
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
        return str(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:] or list(E.queries())
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name in wanted:
        begun = time.time()
        try:
            frame = E.queries()[name](spark, folder)
            rows = [tuple(r) for r in frame.collect()]
        except Exception as error:  # noqa: BLE001
            print(f"{name:20s} SPARK ERROR {str(error)[:600]}")
            bad += 1
            continue
        took = time.time() - begun
        sql = E.oracle_sql().get(name)
        if sql is None:
            print(f"{name:20s} rows only  {len(rows):7d} rows {took:6.2f}s")
            continue
        begun = time.time()
        try:
            result = con.sql(sql)
            expected, columns = result.fetchall(), result.columns
        except Exception as error:  # noqa: BLE001
            print(f"{name:20s} SQL ERROR {str(error)[:600]}")
            bad += 1
            continue
        mine, theirs = canonical(rows, frame.columns), canonical(expected, columns)
        same = sorted(frame.columns) == sorted(columns) and mine == theirs
        bad += not same
        print(
            f"{name:20s} {'ok       ' if same else 'DIFFERENT'}  {len(rows):7d} rows {took:6.2f}s sql {time.time() - begun:5.2f}s",
            flush=True,
        )
        if not same:
            print("   columns", sorted(frame.columns), sorted(columns), len(mine), len(theirs))
            left, right = set(mine) - set(theirs), set(theirs) - set(mine)
            for row in sorted(left)[:4]:
                print("   spark", row)
            for row in sorted(right)[:4]:
                print("   sql  ", row)
    print("bad:", bad)


if __name__ == "__main__":
    main()
