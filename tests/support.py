"""Session and comparison helpers for the tests."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TESTDATA = "/root/testdata/sf0.001"


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', 4)}]").appName("lethe-tests")
             .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{glob}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_matches(df: DataFrame, sf_dir: str, sql: str) -> int:
    """The DataFrame's rows are those of the SQL, order aside."""
    columns, expected = duck(sf_dir, sql)
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(columns), (sorted(df.columns), sorted(columns))
    a, b = rows_of(df.columns, got), rows_of(columns, expected)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
    return len(a)
