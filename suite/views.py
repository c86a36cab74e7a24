"""Queries over metric tables: ranges, shares, latest slices, sorted breakdowns, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colmetry import profile_columns
from colmetry.operators import views
from suite.expected_sql import profile_sql
from suite.inputs import (
    DECIMAL_LINES, DECIMAL_TYPES, DIRTY_EVENTS, DIRTY_TYPES, LINEITEM_TYPES, ORDERS_BY_DAY, listed,
    table,
)

QUERIES, SQL = {}, {}

DIMENSIONS = ["event_date", "category"]


def metrics(spark, folder, dimensions=DIMENSIONS) -> DataFrame:
    """Metric rows of the dirty events, '' counted as missing."""
    events = table(spark, folder, "events").selectExpr(*DIRTY_EVENTS)
    return profile_columns(events, dimensions, treat_empty_string_as_null=True).withColumns({
        "unique_id": F.lit("events"), "treat_empty_string_as_null": F.lit(True),
    })


DIRTY = listed(DIRTY_EVENTS, "events")
METRICS = f"SELECT *, 'events' AS unique_id FROM ({profile_sql(DIRTY, DIRTY_TYPES, DIMENSIONS, flag=True)})"


def register(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    SQL[name] = sql


def over_dirty(name: str, query, sql: str) -> None:
    """A query over the dirty metrics whose SQL reads them as ``m``."""
    register(name, lambda spark, folder: query(metrics(spark, folder)), f"WITH m AS ({METRICS}) {sql}")


BY_COLUMN = "GROUP BY dimension_name, column_name"
INDIMENSION = "dimension_name IS NOT NULL"

over_dirty(
    "string_range_by_dim",
    # A slice that lacks the column is still one of its dimension.
    lambda m: views.range_summary(m.where("NOT (column_name = 'category' AND coalesce(dimension_value, '') = 'view')"), "string").select(
        "dimension_name", "column_name", "slices", "min_distinct", "max_distinct"),
    "SELECT dimension_name, 'category' AS column_name, COUNT(*) AS slices, "
    "MIN(distinct_count) FILTER (WHERE coalesce(dimension_value, '') <> 'view') AS min_distinct, "
    "MAX(distinct_count) FILTER (WHERE coalesce(dimension_value, '') <> 'view') AS max_distinct "
    f"FROM m WHERE {INDIMENSION} AND column_name = 'category' GROUP BY dimension_name",
)
over_dirty(
    "bool_range_by_dim",
    lambda m: views.range_summary(views.of_family(m, "boolean")).select(
        "dimension_name", "column_name", "slices", "min_true_rate", "max_true_rate"),
    "SELECT dimension_name, column_name, COUNT(*) AS slices, MIN(CAST(true_count AS DOUBLE) / record_count) AS min_true_rate, "
    "MAX(CAST(true_count AS DOUBLE) / record_count) AS max_true_rate "
    f"FROM m WHERE {INDIMENSION} AND column_type = 'BOOL' {BY_COLUMN}",
)


def range_sql(source: str, names, kinds: dict[str, str], dimension: str) -> str:
    """Ranges straight from the rows: the least minimum over slices is the minimum of the column."""
    from suite.expected_sql import value_text
    return " UNION ALL ".join(
        f"SELECT '{dimension}' AS dimension_name, '{n}' AS column_name, {value_text(f'MIN({n})', kinds[n])} AS min_value, "
        f"{value_text(f'MAX({n})', kinds[n])} AS max_value FROM ({source})" for n in names
    )


def ranges(m: DataFrame, family: str) -> DataFrame:
    return views.range_summary(views.of_family(m, family)).select("dimension_name", "column_name", "min_value", "max_value")


_KINDS = dict(DIRTY_TYPES)
over_dirty(
    "numeric_range_by_dim", lambda m: ranges(m, "numeric"),
    " UNION ALL ".join(range_sql(DIRTY, ["event_id", "user_id", "amount", "precise_amount"], _KINDS, d) for d in DIMENSIONS),
)
over_dirty(
    "temporal_range_by_dim", lambda m: ranges(m, "date"),
    " UNION ALL ".join(range_sql(DIRTY, ["ts", "event_date"], _KINDS, d) for d in DIMENSIONS),
)
register(
    "decimal_range_by_dim",
    lambda spark, folder: ranges(
        profile_columns(table(spark, folder, "lineitem").selectExpr(*DECIMAL_LINES), ["l_returnflag"])
        .withColumn("unique_id", F.lit("lines")), "numeric"),
    range_sql(listed(DECIMAL_LINES, "lineitem"), ["price", "whole", "signed_tax", "wide"], dict(DECIMAL_TYPES), "l_returnflag"),
)
register(
    "latest_partition",
    lambda spark, folder: views.latest_slice(
        profile_columns(table(spark, folder, "orders").selectExpr(*ORDERS_BY_DAY), ["order_day", "o_orderstatus"])
        .withColumn("unique_id", F.lit("orders"))),
    "SELECT 'orders' AS unique_id, 'order_day' AS dimension_name, CAST(o_orderdate AS DATE)::VARCHAR AS dimension_value, "
    "COUNT(*) AS record_count FROM orders GROUP BY ALL ORDER BY dimension_value DESC LIMIT 1",
)


def declared_temporal(spark, folder) -> DataFrame:
    """A timestamp dimension is temporal by its declared type, a date one by its values."""
    orders = table(spark, folder, "orders").selectExpr("*", "CAST(o_orderdate AS DATE) AS order_day")
    rows = profile_columns(orders, ["o_orderdate", "order_day", "o_orderstatus"]).withColumn("unique_id", F.lit("orders"))
    declared = spark.range(1).selectExpr("'orders' AS unique_id", "'o_orderdate' AS name", "'DATETIME' AS data_type")
    return views.temporal_dimensions(rows, declared)


register(
    "temporal_dimensions", declared_temporal,
    "SELECT 'orders' AS unique_id, 'o_orderdate' AS dimension_name, true AS temporal FROM orders HAVING COUNT(*) > 0 "
    "UNION ALL SELECT 'orders', 'order_day', true FROM orders HAVING COUNT(*) > 0 "
    "UNION ALL SELECT 'orders', 'o_orderstatus', COUNT(*) = COUNT(*) FILTER (WHERE regexp_matches(o_orderstatus, '^[0-9]{4}-')) FROM orders",
)
over_dirty(
    "row_share_by_dim",
    lambda m: views.row_share(m),
    ", s AS (SELECT DISTINCT unique_id, dimension_name, dimension_value, record_count FROM m) "
    "SELECT *, greatest(1, MAX(record_count) OVER (PARTITION BY dimension_name)) AS max_records, "
    "record_count / greatest(1, MAX(record_count) OVER (PARTITION BY dimension_name)) AS row_share FROM s",
)
over_dirty(
    "values_per_dimension", lambda m: views.values_per_dimension(m),
    "SELECT unique_id, dimension_name, COUNT(*) AS \"values\" FROM (SELECT DISTINCT unique_id, dimension_name, dimension_value "
    f"FROM m WHERE {INDIMENSION}) GROUP BY ALL",
)
over_dirty(
    "dimension_names", lambda m: views.dimension_names(m, "dimension_order"),
    "SELECT unique_id, dimension_name, MIN(dimension_order) AS first_seen FROM m "
    f"WHERE {INDIMENSION} GROUP BY ALL",
)


def numbered(ordered: DataFrame) -> DataFrame:
    """Sorted rows with their position from 0, which results compared as sets would lose."""
    placed = ordered.withColumn("_id", F.monotonically_increasing_id()).withColumns({
        "_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_before", F.expr("sum(_rows) OVER (ORDER BY _part) - _rows"))
    return placed.join(before.drop("_rows"), "_part").withColumn("position", F.col("_before") + F.col("_place")).drop(
        "_id", "_part", "_place", "_before")


def sorted_amounts(m: DataFrame, key: str | None, descending: bool = True, temporal: bool = False) -> DataFrame:
    rows = views.of_dimension(m, "event_date").where("column_name = 'amount'")
    return numbered(views.breakdown(rows, key, descending, temporal)).select(
        "position", "dimension_value", "record_count", "missing_rate", "min_value", "max_value")


_SLICES = "coalesce(dimension_value, ''), dimension_value IS NOT NULL"


def amounts_by(order: str) -> str:
    return (
        f"SELECT ROW_NUMBER() OVER (ORDER BY {order}, {_SLICES}) - 1 AS position, dimension_value, record_count, missing_rate, "
        "min_value, max_value FROM m WHERE dimension_name = 'event_date' AND column_name = 'amount'"
    )


over_dirty("breakdown_by_min", lambda m: sorted_amounts(m, "min", False), amounts_by("CAST(min_value AS DOUBLE) NULLS LAST"))
over_dirty("breakdown_by_missing", lambda m: sorted_amounts(m, "missing"), amounts_by("missing_rate DESC NULLS LAST"))
over_dirty("breakdown_newest_first", lambda m: sorted_amounts(m, None, temporal=True), amounts_by("dimension_value DESC NULLS LAST"))
over_dirty(
    "slice_order",
    lambda m: numbered(views.in_slice_order(m)).select("position", "dimension_name", "dimension_value", "column_name", "record_count"),
    "SELECT ROW_NUMBER() OVER (ORDER BY dimension_name IS NOT NULL, coalesce(dimension_name, ''), "
    f"{_SLICES}, column_order) - 1 AS position, dimension_name, dimension_value, column_name, record_count FROM m",
)
over_dirty(
    "newest_slices_first",
    lambda m: numbered(views.newest_first(views.of_dimension(m, "event_date"))).select(
        "position", "dimension_value", "column_name", "record_count"),
    "SELECT ROW_NUMBER() OVER (ORDER BY dimension_value DESC NULLS LAST, column_order) - 1 AS position, dimension_value, "
    "column_name, record_count FROM m WHERE dimension_name = 'event_date'",
)
register(
    "type_family_filter",
    lambda spark, folder: views.of_family(profile_columns(table(spark, folder, "lineitem"), ["l_linestatus"]), "numeric")
    .select("dimension_name", "dimension_value", "column_name", "column_type", "min_value"),
    "SELECT dimension_name, dimension_value, column_name, column_type, min_value FROM "
    f"({profile_sql('SELECT * FROM lineitem', LINEITEM_TYPES, ['l_linestatus'])}) "
    "WHERE column_type IN ('INT64', 'FLOAT64', 'NUMERIC', 'BIGNUMERIC')",
)
over_dirty(
    "metric_kinds",
    lambda m: m.select("column_name", views.metric_kind(F.col("column_type")).alias("kind"), "record_count"),
    "SELECT column_name, CASE column_type WHEN 'STRING' THEN 'string' WHEN 'BOOL' THEN 'boolean' ELSE 'range' END AS kind, "
    "record_count FROM m",
)
over_dirty(
    "overall_slices", lambda m: views.of_dimension(m, None).select("column_name", "record_count", "missing_count"),
    "SELECT column_name, record_count, missing_count FROM m WHERE dimension_name IS NULL",
)
over_dirty(
    "effective_missing",
    lambda m: views.effective_missing(
        m.withColumn("treat_empty_string_as_null", F.col("dimension_name").isNull())
    ).select("dimension_name", "dimension_value", "column_name", "effective_count", "effective_rate"),
    "SELECT dimension_name, dimension_value, column_name, "
    "CASE WHEN dimension_name IS NULL THEN missing_count ELSE null_count END AS effective_count, "
    "CASE WHEN dimension_name IS NULL THEN missing_rate ELSE null_rate END AS effective_rate FROM m",
)
over_dirty(
    "boolean_counts",
    lambda m: views.boolean_counts(m).select("dimension_name", "dimension_value", "true_count", "false_count", "true_rate", "false_rate"),
    " UNION ALL ".join(
        f"SELECT {name} AS dimension_name, {value} AS dimension_value, COUNT(*) FILTER (WHERE active) AS true_count, "
        "COUNT(*) FILTER (WHERE NOT active) AS false_count, CAST(COUNT(*) FILTER (WHERE active) AS DOUBLE) / COUNT(*) AS true_rate, "
        f"CAST(COUNT(*) FILTER (WHERE NOT active) AS DOUBLE) / COUNT(*) AS false_rate FROM ({DIRTY}) {group}"
        for name, value, group in [
            ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", ""),
            ("'event_date'", "CAST(event_date AS VARCHAR)", "GROUP BY event_date"),
            ("'category'", "category", "GROUP BY category"),
        ]
    ),
)
over_dirty(
    "decoded_values",
    lambda m: views.decoded(m).select("dimension_name", "dimension_value", "column_name", "min_int", "max_int", "min_double", "max_double"),
    "SELECT dimension_name, dimension_value, column_name, "
    + ", ".join(
        f"CASE WHEN column_type = '{kind}' THEN TRY_CAST({end}_value AS {target}) END AS {end}_{short}"
        for kind, target, short in (("INT64", "BIGINT", "int"), ("FLOAT64", "DOUBLE", "double")) for end in ("min", "max")
    ) + " FROM m",
)
over_dirty(
    "missing_rate_matrix",
    lambda m: views.missing_matrix(m.where("NOT (column_name = 'amount' AND coalesce(dimension_value, '') = 'view')")),
    "SELECT unique_id, dimension_name, dimension_value, column_order, column_name, "
    "NOT (column_name = 'amount' AND coalesce(dimension_value, '') = 'view') AS has_data, "
    "CASE WHEN column_name = 'amount' AND coalesce(dimension_value, '') = 'view' THEN NULL ELSE missing_rate END AS missing_rate "
    f"FROM m WHERE {INDIMENSION}",
)
over_dirty(
    "column_by_slice",
    lambda m: views.column_by_slice(
        m.where("NOT (column_name = 'amount' AND coalesce(dimension_value, '') = 'view')"), "amount"
    ).select("dimension_name", "dimension_value", "record_count", "has_data", "null_count", "max_value"),
    "SELECT dimension_name, dimension_value, record_count, coalesce(dimension_value, '') <> 'view' AS has_data, "
    "CASE WHEN coalesce(dimension_value, '') <> 'view' THEN null_count END AS null_count, "
    "CASE WHEN coalesce(dimension_value, '') <> 'view' THEN max_value END AS max_value FROM m WHERE column_name = 'amount'",
)
over_dirty(
    "nested_slices",
    lambda m: views.nest_slices(m).select(
        "dimension_name", "dimension_value", "record_count",
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["column_name"], c["null_count"], c["max_value"])), ",").alias("columns"),
    ),
    "SELECT dimension_name, dimension_value, ANY_VALUE(record_count) AS record_count, "
    "string_agg(concat_ws(':', column_name, null_count, max_value), ',' ORDER BY column_order) AS \"columns\" FROM m "
    "GROUP BY dimension_name, dimension_value",
)


def described(m: DataFrame) -> DataFrame:
    spark = m.sparkSession
    declared = spark.range(1).selectExpr(
        "'events' AS unique_id", "inline(array(named_struct('name', 'amount', 'description', 'value of the event'), "
        "named_struct('name', 'ts', 'description', 'time of the event')))"
    )
    return views.with_descriptions(m, declared).select("dimension_value", "column_name", "record_count", "column_description")


over_dirty(
    "column_descriptions", described,
    "SELECT dimension_value, column_name, record_count, CASE column_name WHEN 'amount' THEN 'value of the event' "
    "WHEN 'ts' THEN 'time of the event' ELSE '' END AS column_description FROM m",
)
