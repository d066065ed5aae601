"""Runs every registered query next to its SQL and compares the rows.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def plain(value: object) -> object:
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.4f}"
    return None if value is None else str(value)


def ordered(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(plain(row[i]) for i in place) for row in rows]
    return sorted(columns), sorted(cells, key=lambda r: tuple((c is not None, str(c)) for c in r))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return ordered(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, text: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(text)
    columns = [d[0] for d in result.description]
    return ordered(columns, result.fetchall())


def main(sf_dir: str, names: list[str]) -> int:
    from __spark_entry__ import ALL

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name, (query, text) in ALL.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = spark_rows(query(spark, sf_dir))
            took = time.time() - start
            start = time.time()
            want = duck_rows(connection, text) if text else None
            other = time.time() - start
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {str(error)[:1500]}")
            bad += 1
            continue
        state = "rows " if want is None else "ok   " if got == want else "DIFF "
        print(f"{state} {name}: {len(got[1])} rows, spark {took:.2f}s, sql {other:.2f}s")
        if state == "DIFF ":
            bad += 1
            print("   columns", got[0], want[0])
            print("   sizes", len(got[1]), len(want[1]))
            left = [r for r in got[1] if r not in set(want[1])][:3]
            right = [r for r in want[1] if r not in set(got[1])][:3]
            print("   only spark", left)
            print("   only sql  ", right)
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(1 if main(arguments[0], arguments[1:]) else 0)
