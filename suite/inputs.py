"""Views over the test tables, written once and used by both engines.

Every list holds SQL expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# events with NULLs, empty strings, dates, booleans and decimals.
DIRTY_EVENTS = [
    "event_id", "user_id", "ts",
    "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS event_date",
    "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '' "
    "WHEN event_id % 19 = 0 THEN ' ' ELSE event_type END AS category",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS amount",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 3 = 0 END AS active",
    "CAST(CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id - 5000 END AS DECIMAL(38,9)) AS precise_amount",
]
DIRTY_TYPES = [
    ("event_id", "INT64"), ("user_id", "INT64"), ("ts", "DATETIME"), ("event_date", "DATE"), ("category", "STRING"),
    ("amount", "FLOAT64"), ("active", "BOOL"), ("precise_amount", "NUMERIC"),
]

LINEITEM_TYPES = [
    ("l_orderkey", "INT64"), ("l_partkey", "INT64"), ("l_suppkey", "INT64"), ("l_linenumber", "INT64"),
    ("l_quantity", "FLOAT64"), ("l_extendedprice", "FLOAT64"), ("l_discount", "FLOAT64"), ("l_tax", "FLOAT64"),
    ("l_returnflag", "STRING"), ("l_linestatus", "STRING"), ("l_shipdate", "DATETIME"),
]

ORDERS_TYPES = [
    ("o_orderkey", "INT64"), ("o_custkey", "INT64"), ("o_orderstatus", "STRING"), ("o_totalprice", "FLOAT64"),
    ("o_orderdate", "DATETIME"), ("o_orderpriority", "STRING"),
]

ORDERS_BY_DAY = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "CAST(o_orderdate AS DATE) AS order_day",
    "o_orderpriority",
]
ORDERS_BY_DAY_TYPES = [
    ("o_orderkey", "INT64"), ("o_custkey", "INT64"), ("o_orderstatus", "STRING"), ("o_totalprice", "FLOAT64"),
    ("order_day", "DATE"), ("o_orderpriority", "STRING"),
]

# Decimals of several scales, among them one too wide for a NUMERIC.
DECIMAL_LINES = [
    "l_returnflag",
    "CAST(l_extendedprice AS DECIMAL(15,2)) AS price",
    "CAST(l_orderkey AS DECIMAL(38,0)) AS whole",
    "CAST(CASE WHEN l_linenumber % 2 = 0 THEN -l_tax ELSE l_tax END AS DECIMAL(12,4)) AS signed_tax",
    "CAST(CAST(l_quantity AS DECIMAL(10,2)) AS DECIMAL(36,12)) AS wide",
]
DECIMAL_TYPES = [
    ("l_returnflag", "STRING"), ("price", "NUMERIC"), ("whole", "BIGNUMERIC"), ("signed_tax", "NUMERIC"),
    ("wide", "BIGNUMERIC"),
]

# Decimal text with up to 39 integer and 38 fraction digits.
HUGE_LINES = [
    "l_returnflag",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat("
    "CASE WHEN l_orderkey % 3 = 0 THEN '-' ELSE '' END, CAST(l_orderkey AS VARCHAR(20)), "
    "CASE WHEN l_orderkey % 5 = 0 THEN '0000000000000000000000000000' ELSE '' END, "
    "'.', CAST(l_partkey AS VARCHAR(20)), '00000000000000000000000000000', CAST(l_suppkey AS VARCHAR(20))) END AS huge",
]

# Customers as cataloged relations.
CUSTOMER_RELATIONS = {
    "unique_id": "concat('source.shop.customer.', CAST(c_custkey AS VARCHAR(20)))",
    "resource_type": "'source'",
    "name": "c_name",
    "database": "concat('nation_', CAST(c_nationkey AS VARCHAR(20)))",
    "schema": "c_mktsegment",
    "profiled_at": "CASE WHEN c_custkey % 3 = 0 THEN '2026-09-01T00:00:00+00:00' END",
}

# Orders as cataloged relations that read their customer and, some of them, a relation nobody knows.
ORDER_RELATIONS = {
    "unique_id": "concat('model.shop.order.', CAST(o_orderkey AS VARCHAR(20)))",
    "resource_type": "'model'",
    "name": "concat('order_', CAST(o_orderkey AS VARCHAR(20)))",
    "database": "o_orderpriority",
    "schema": "o_orderstatus",
    "profiled_at": "CASE WHEN o_orderkey % 4 = 0 THEN '2026-09-02T00:00:00+00:00' END",
}


def listed(expressions: list[str], source: str) -> str:
    return f"SELECT {', '.join(expressions)} FROM {source}"
