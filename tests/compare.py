"""Compare a Spark result with the result of SQL in DuckDB, row order aside."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def ordered(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(normal(row[i]) for i in places) for row in rows]
    return [names[i] for i in places], sorted(rows, key=repr)


def difference(frame, connection, sql: str) -> str | None:
    """None when equal, otherwise the first differences."""
    spark_names, spark_rows = ordered(frame.columns, frame.collect())
    result = connection.execute(sql)
    sql_names, sql_rows = ordered([d[0] for d in result.description], result.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} vs {sql_names}"
    kinds = {type(v) for r in spark_rows for v in r} ^ {type(v) for r in sql_rows for v in r}
    if spark_rows != sql_rows:
        only = [r for r in spark_rows if r not in set(sql_rows)][:3]
        other = [r for r in sql_rows if r not in set(spark_rows)][:3]
        return f"rows {len(spark_rows)} vs {len(sql_rows)}; types {kinds}; only Spark {only}; only SQL {other}"
    return None
