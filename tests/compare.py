"""Run proxy queries next to their SQL texts and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


def _value(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, Decimal)):
        return repr(float(v))
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, connection, sf: str, query, sql: str) -> str | None:
    """None when both give the same rows, else a description."""
    df = query(spark, sf)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if actual != expected:
        ours, theirs = set(actual), set(expected)
        return (
            f"{len(actual)} rows, expected {len(expected)}\n  columns {sorted(names)}\n"
            f"  only ours: {sorted(ours - theirs)[:2]}\n  only theirs: {sorted(theirs - ours)[:2]}"
        )
    return None if actual else "EMPTY"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    sf, names = sys.argv[1], sys.argv[2:]
    spark, connection = session(), duck(sf)
    sqls = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = difference(spark, connection, sf, query, sqls[name])
            else:
                problem = f"no SQL, {query(spark, sf).count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:38s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("problems:", failed)


if __name__ == "__main__":
    main()
