"""Queries over whole tables: Overall and dimension profiles, the guard, skipped columns, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colmetry import Metric, StringMetric, guard_dimensions, profile, profile_columns, validate
from colmetry.operators.validate import dimension_totals
from colmetry.schema import resolve_columns
from colmetry.sources.files import staged
from suite.expected_sql import profile_sql
from suite.inputs import (
    DECIMAL_LINES, DECIMAL_TYPES, DIRTY_EVENTS, DIRTY_TYPES, HUGE_LINES, LINEITEM_TYPES, ORDERS_BY_DAY,
    ORDERS_BY_DAY_TYPES, ORDERS_TYPES, listed, table,
)

QUERIES, SQL = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def dirty(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*DIRTY_EVENTS)


DIRTY_SQL = listed(DIRTY_EVENTS, "events")

register(
    "overall_lineitem",
    lambda spark, folder: profile_columns(table(spark, folder, "lineitem")),
    profile_sql("SELECT * FROM lineitem", LINEITEM_TYPES),
)
register(
    "overall_orders",
    lambda spark, folder: profile_columns(table(spark, folder, "orders")),
    profile_sql("SELECT * FROM orders", ORDERS_TYPES),
)
register(
    "overall_events_dirty",
    lambda spark, folder: profile_columns(dirty(spark, folder)),
    profile_sql(DIRTY_SQL, DIRTY_TYPES),
)
register(
    "overall_empty_as_null",
    lambda spark, folder: profile_columns(dirty(spark, folder), treat_empty_string_as_null=True),
    profile_sql(DIRTY_SQL, DIRTY_TYPES, flag=True),
)
register(
    "overall_empty_input",
    lambda spark, folder: profile_columns(table(spark, folder, "lineitem"), ["l_returnflag"], where="l_quantity < 0"),
    profile_sql("SELECT * FROM lineitem WHERE l_quantity < 0", LINEITEM_TYPES, ["l_returnflag"]),
)
register(
    "overall_where",
    lambda spark, folder: profile_columns(
        table(spark, folder, "lineitem"), where="l_quantity > 40\n OR l_returnflag = 'R' -- large or returned"
    ),
    profile_sql("SELECT * FROM lineitem WHERE l_quantity > 40 OR l_returnflag = 'R'", LINEITEM_TYPES),
)
register(
    "dim_date_orders",
    lambda spark, folder: profile_columns(table(spark, folder, "orders").selectExpr(*ORDERS_BY_DAY), ["order_day"]),
    profile_sql(listed(ORDERS_BY_DAY, "orders"), ORDERS_BY_DAY_TYPES, ["order_day"]),
)
register(
    "dim_datetime_orders",
    lambda spark, folder: profile_columns(table(spark, folder, "orders"), ["o_orderdate"]),
    profile_sql("SELECT * FROM orders", ORDERS_TYPES, ["o_orderdate"]),
)
register(
    "dim_string_lineitem",
    lambda spark, folder: profile_columns(table(spark, folder, "lineitem"), ["l_returnflag"]),
    profile_sql("SELECT * FROM lineitem", LINEITEM_TYPES, ["l_returnflag"]),
)
register(
    "dim_null_bucket",
    lambda spark, folder: profile_columns(dirty(spark, folder), ["category"], treat_empty_string_as_null=True),
    profile_sql(DIRTY_SQL, DIRTY_TYPES, ["category"], flag=True),
)
register(
    "dim_where",
    lambda spark, folder: profile_columns(dirty(spark, folder), ["event_date"], where="active IS NOT NULL AND amount > 20"),
    profile_sql(f"SELECT * FROM ({DIRTY_SQL}) WHERE active IS NOT NULL AND amount > 20", DIRTY_TYPES, ["event_date"]),
)
register(
    "multi_dimension",
    lambda spark, folder: profile_columns(dirty(spark, folder), ["event_date", "category", "event_date"]),
    profile_sql(DIRTY_SQL, DIRTY_TYPES, ["event_date", "category", "event_date"]),
)
# One row per slice, a dimension with as many values as rows.
register(
    "dim_datetime_events",
    lambda spark, folder: profile_columns(table(spark, folder, "events"), ["ts"]),
    profile_sql("SELECT * FROM events", [
        ("event_id", "INT64"), ("ts", "DATETIME"), ("user_id", "INT64"), ("event_type", "STRING"), ("value", "FLOAT64"),
        ("props", "STRING"),
    ], ["ts"]),
)
register(
    "bool_profile",
    lambda spark, folder: profile_columns(dirty(spark, folder).select("active", "category"), ["category"]),
    profile_sql(DIRTY_SQL, [("active", "BOOL"), ("category", "STRING")], ["category"]),
)
register(
    "decimal_profile",
    lambda spark, folder: profile_columns(table(spark, folder, "lineitem").selectExpr(*DECIMAL_LINES), ["l_returnflag"]),
    profile_sql(listed(DECIMAL_LINES, "lineitem"), DECIMAL_TYPES, ["l_returnflag"]),
)


def instants(spark, folder) -> DataFrame:
    """Event times as instants, whatever the session time zone is."""
    instant = "timestampadd(MICROSECOND, timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {}), timestamp_micros(0))"
    return table(spark, folder, "events").selectExpr(
        "event_type", f"{instant.format('ts')} AS received",
        f"{instant.format('CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ)')} AS received_day",
    )


register(
    "timestamp_profile",
    lambda spark, folder: profile_columns(instants(spark, folder), ["received_day"]),
    profile_sql(
        "SELECT event_type, ts AS received, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS received_day FROM events",
        [("event_type", "STRING"), ("received", "TIMESTAMP"), ("received_day", "TIMESTAMP")], ["received_day"],
    ),
)
_HUGE_PROFILE = "SELECT {place} AS dimension_order, {name} AS dimension_name, {value} AS dimension_value, " \
    "COUNT(*) AS record_count, 0 AS column_order, 'huge' AS column_name, 'BIGNUMERIC' AS column_type, " \
    "'exact' AS column_description, COUNT(*) - COUNT(huge) AS null_count, " \
    "CAST(COUNT(*) - COUNT(huge) AS DOUBLE) / COUNT(*) AS null_rate, CAST(0 AS BIGINT) AS empty_string_count, " \
    "COUNT(*) - COUNT(huge) AS missing_count, CAST(COUNT(*) - COUNT(huge) AS DOUBLE) / COUNT(*) AS missing_rate, " \
    "CAST(NULL AS BIGINT) AS distinct_count, CAST(NULL AS DOUBLE) AS distinct_ratio, " \
    "arg_min(huge, place) AS min_value, arg_max(huge, place) AS max_value, CAST(NULL AS BIGINT) AS true_count " \
    "FROM keyed {group}"
register(
    "bignumeric_profile",
    lambda spark, folder: profile_columns(
        table(spark, folder, "lineitem").selectExpr(*HUGE_LINES), ["l_returnflag"],
        columns=[("huge", "bignumeric", "exact"), ("l_returnflag", "STRING", "")],
    ).where("column_name = 'huge'"),
    # Whole and fraction digits as two exact numbers; a negative value orders by both negated.
    f"WITH keyed AS (SELECT *, CASE WHEN huge IS NULL THEN NULL ELSE "
    "{'w': CAST(split_part(huge, '.', 1) AS DECIMAL(38,0)), "
    "'f': CASE WHEN huge LIKE '-%' THEN -1 ELSE 1 END * CAST('0.' || split_part(huge, '.', 2) AS DECIMAL(38,38))} "
    f"END AS place FROM ({listed(HUGE_LINES, 'lineitem')})) "
    + _HUGE_PROFILE.format(place=0, name="CAST(NULL AS VARCHAR)", value="CAST(NULL AS VARCHAR)", group="")
    + " UNION ALL "
    + _HUGE_PROFILE.format(place=1, name="'l_returnflag'", value="l_returnflag", group="GROUP BY l_returnflag"),
)
register(
    "declared_columns",
    lambda spark, folder: profile_columns(
        table(spark, folder, "customer"), ["c_mktsegment"],
        columns=[
            ("c_mktsegment", "string", "segment"), ("c_acctbal", "float", ""), ("c_custkey", "integer", "key"),
            ("c_nationkey", "STRING", "as text"), ("c_name", "JSON", ""),
        ],
    ),
    profile_sql(
        "SELECT c_mktsegment, c_acctbal, c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer",
        [("c_mktsegment", "STRING"), ("c_acctbal", "FLOAT64"), ("c_custkey", "INT64"), ("c_nationkey", "STRING")],
        ["c_mktsegment"],
        descriptions={"c_mktsegment": "segment", "c_custkey": "key", "c_nationkey": "as text"},
    ),
)
# Decimals keep their digits under either label, and a declared name may differ in case.
_WIDER = ["CAST(l_extendedprice AS DECIMAL(38,9)) AS price", "CAST(CAST(l_tax AS DECIMAL(20,4)) / 1 AS DECIMAL(38,20)) AS tax", "l_linenumber"]
register(
    "declared_wider_types",
    lambda spark, folder: profile_columns(
        table(spark, folder, "lineitem").selectExpr(*_WIDER),
        columns=[("PRICE", "BIGNUMERIC", ""), ("Tax", "NUMERIC", ""), ("l_linenumber", "NUMERIC", "")]),
    profile_sql(
        'SELECT price AS "PRICE", tax AS "Tax", CAST(l_linenumber AS DECIMAL(20,0)) AS l_linenumber FROM '
        f"({listed(_WIDER, 'lineitem')})",
        [("PRICE", "BIGNUMERIC"), ("Tax", "NUMERIC"), ("l_linenumber", "NUMERIC")]),
)
# Whole texts, whatever their length, are the strings that are counted.
register(
    "distinct_long_text",
    lambda spark, folder: profile_columns(table(spark, folder, "documents").select("text", "lang"), ["lang"]),
    profile_sql("SELECT text, lang FROM documents", [("text", "STRING"), ("lang", "STRING")], ["lang"]),
)
# A collated column counts by its own equality, here without regard to case.
register(
    "collated_profile",
    lambda spark, folder: profile_columns(table(spark, folder, "documents").selectExpr(
        "CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END COLLATE UTF8_LCASE AS lang", "text COLLATE UTF8_LCASE AS text"
    )).select("column_name", "record_count", "null_count", "distinct_count"),
    " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, COUNT(*) AS record_count, COUNT(*) - COUNT({name}) AS null_count, "
        f"COUNT(DISTINCT lower({name})) AS distinct_count FROM documents" for name in ("lang", "text")),
)
# Plain and collated columns in one table, one of the collated ones a dimension: each string keeps its own column's equality, and a slice
# is named by the least of its values.
_MIXED = [
    "CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 7 = 0 THEN NULL ELSE lang END{} AS lang", "source{} AS source",
    "CASE WHEN doc_id % 2 = 0 THEN initcap(source) WHEN doc_id % 5 = 0 THEN '' ELSE source END{} AS origin", "text{} AS text", "n_chars",
]
_COLLATED = [text.format(f" COLLATE {kind}" if kind else "") for text, kind in zip(_MIXED, ["UTF8_LCASE", "", "UNICODE_CI", "", ""])]
_MIXED_DOCUMENTS = listed([text.format("").replace("initcap(source)", "upper(source[1]) || source[2:]") for text in _MIXED], "documents")


def _mixed_sql(slice_: str, name: str, group: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {name} AS dimension_name, {slice_} AS dimension_value, '{column}' AS column_name, COUNT(*) AS record_count, "
        f"COUNT(*) - COUNT({column}) AS null_count, COUNT(*) FILTER (WHERE {empty}) AS empty_string_count, {distinct} AS distinct_count, "
        f"{least} AS min_value FROM d {group}"
        for column, empty, distinct, least in (
            ("lang", "lang = ''", "COUNT(DISTINCT lower(lang))", "CAST(NULL AS VARCHAR)"),
            ("source", "source = ''", "COUNT(DISTINCT source)", "CAST(NULL AS VARCHAR)"),
            ("origin", "origin = ''", "COUNT(DISTINCT lower(origin)) FILTER (WHERE origin <> '')", "CAST(NULL AS VARCHAR)"),
            ("text", "text = ''", "COUNT(DISTINCT text)", "CAST(NULL AS VARCHAR)"),
            ("n_chars", "false", "CAST(NULL AS BIGINT)", "CAST(MIN(n_chars) AS VARCHAR)")))


register(
    "mixed_collations_profile",
    lambda spark, folder: profile_columns(
        table(spark, folder, "documents").selectExpr(*_COLLATED), ["lang", "source", "origin"], treat_empty_string_as_null=True,
    ).select("dimension_name", "dimension_value", "column_name", "record_count", "null_count", "empty_string_count", "distinct_count", "min_value"),
    f"WITH d AS ({_MIXED_DOCUMENTS}) " + " UNION ALL ".join([
        _mixed_sql("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", ""), _mixed_sql("MIN(lang)", "'lang'", "GROUP BY lower(lang)"),
        _mixed_sql("source", "'source'", "GROUP BY source"), _mixed_sql("MIN(origin)", "'origin'", "GROUP BY lower(origin)"),
    ]),
)
# A dimension is found as columns are, in any case, under the declared name.
register(
    "dimension_any_case",
    lambda spark, folder: profile(
        table(spark, folder, "orders").withColumnRenamed("o_orderstatus", "Status").select("Status", "o_totalprice"), ["STATUS"],
        columns=[("status", "STRING", ""), ("o_totalprice", "FLOAT64", "")]).metrics,
    profile_sql("SELECT o_orderstatus AS status, o_totalprice FROM orders", [("status", "STRING"), ("o_totalprice", "FLOAT64")], ["status"]),
)
NEGATIVES = Metric("negative_count", ("FLOAT64", "INT64"), lambda c: F.count_if(c < 0), F.sum)
register(
    "added_metric",
    lambda spark, folder: profile_columns(
        table(spark, folder, "customer"), ["c_mktsegment"], added_metrics=[NEGATIVES]
    ).select("dimension_value", "column_name", "record_count", "null_count", "negative_count"),
    " UNION ALL ".join(
        f"SELECT {value} AS dimension_value, '{name}' AS column_name, COUNT(*) AS record_count, "
        f"COUNT(*) - COUNT({name}) AS null_count, "
        f"{f'COUNT(*) FILTER (WHERE {name} < 0)' if number else 'CAST(NULL AS BIGINT)'} AS negative_count "
        f"FROM customer {group}"
        for value, group in (("CAST(NULL AS VARCHAR)", ""), ("c_mktsegment", "GROUP BY c_mktsegment"))
        for name, number in (
            ("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False))
    ),
)


LONGEST = StringMetric("longest", lambda text, _: F.length(text), F.max)
CHARACTERS = StringMetric("characters", lambda text, rows: F.length(text) * rows, F.sum)
DIGIT_SHARE = StringMetric(
    "digit_share",
    lambda text, rows: F.struct(rows.alias("n"), F.when(text.rlike("[0-9]"), rows).otherwise(0).alias("digits")),
    lambda part: F.struct(F.sum(part["n"]).alias("n"), F.sum(part["digits"]).alias("digits")),
    lambda parts, _: parts["digits"] / parts["n"], "double",
)


def string_metrics(spark, folder) -> DataFrame:
    """Metrics of strings beside one of numbers, by two dimensions, with the guard's groups read again for Overall."""
    found = profile(table(spark, folder, "customer"), ["c_mktsegment", "c_name"], max_dimension_values=10 ** 12,
                    added_metrics=[LONGEST, NEGATIVES, CHARACTERS, DIGIT_SHARE], treat_empty_string_as_null=True)
    return found.metrics.select("dimension_name", "dimension_value", "column_name", "longest", "characters", "digit_share", "negative_count")


def _string_metrics_sql(name: str, kind: str, dimension: str | None) -> str:
    text = {
        "longest": f"MAX(length(NULLIF({name}, '')))", "characters": f"CAST(SUM(length(NULLIF({name}, ''))) AS BIGINT)",
        "digit_share": f"COUNT(*) FILTER (WHERE regexp_matches({name}, '[0-9]')) / "
                       f"CAST(NULLIF(COUNT(NULLIF({name}, '')), 0) AS DOUBLE)",
    }
    columns = [f"{sql if kind == 'STRING' else 'CAST(NULL AS DOUBLE)' if to == 'digit_share' else 'CAST(NULL AS BIGINT)'} AS {to}"
               for to, sql in text.items()]
    negative = "CAST(NULL AS BIGINT)" if kind == "STRING" else f"COUNT(*) FILTER (WHERE {name} < 0)"
    slice_of = (f"'{dimension}' AS dimension_name, CAST({dimension} AS VARCHAR) AS dimension_value" if dimension
                else "CAST(NULL AS VARCHAR) AS dimension_name, CAST(NULL AS VARCHAR) AS dimension_value")
    return (f"SELECT {slice_of}, '{name}' AS column_name, {', '.join(columns)}, {negative} AS negative_count FROM customer"
            + (f" GROUP BY {dimension}" if dimension else ""))


register(
    "string_metrics",
    string_metrics,
    " UNION ALL ".join(
        _string_metrics_sql(name, kind, dimension)
        for dimension in (None, "c_mktsegment", "c_name")
        for name, kind in (("c_custkey", "INT64"), ("c_name", "STRING"), ("c_nationkey", "INT64"), ("c_acctbal", "FLOAT64"),
                           ("c_mktsegment", "STRING"))
    ),
)


def overall_all_tables(spark, folder) -> DataFrame:
    """Overall of every table given."""
    found = None
    for name in TABLE_TYPES:
        rows = profile_columns(table(spark, folder, name)).withColumn("table_name", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found


TABLE_TYPES = {
    "region": [("r_regionkey", "INT64"), ("r_name", "STRING")],
    "nation": [("n_nationkey", "INT64"), ("n_name", "STRING"), ("n_regionkey", "INT64")],
    "supplier": [("s_suppkey", "INT64"), ("s_name", "STRING"), ("s_nationkey", "INT64"), ("s_acctbal", "FLOAT64")],
    "part": [("p_partkey", "INT64"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_type", "STRING"),
             ("p_size", "INT64"), ("p_retailprice", "FLOAT64")],
    "pages": [("page_id", "INT64"), ("url", "STRING"), ("html", "STRING")],
    "conversations": [("conv_id", "INT64"), ("turn", "INT64"), ("role", "STRING"), ("text", "STRING")],
    "benchmark": [("item_id", "INT64"), ("text", "STRING")],
    "labels": [("doc_id", "INT64"), ("quality", "INT64"), ("toxic", "INT64")],
    "customer": [("c_custkey", "INT64"), ("c_name", "STRING"), ("c_nationkey", "INT64"), ("c_acctbal", "FLOAT64"), ("c_mktsegment", "STRING")],
    "orders": ORDERS_TYPES,
    "lineitem": LINEITEM_TYPES,
    "events": [("event_id", "INT64"), ("ts", "DATETIME"), ("user_id", "INT64"), ("event_type", "STRING"), ("value", "FLOAT64"), ("props", "STRING")],
    "documents": [("doc_id", "INT64"), ("text", "STRING"), ("lang", "STRING"), ("source", "STRING"), ("n_chars", "INT64")],
    "embeddings": [("vec_id", "INT64"), ("label", "INT64")],
}
register("overall_all_tables", overall_all_tables, " UNION ALL ".join(
    f"SELECT *, '{name}' AS table_name FROM ({profile_sql(f'SELECT * FROM {name}', kinds)})"
    for name, kinds in TABLE_TYPES.items()
))


def skipped_columns(spark, folder) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    _, skipped = resolve_columns(embeddings)
    return profile_columns(embeddings).select(
        "column_name", "record_count", "null_count", "min_value", "max_value"
    ).withColumn("skipped_columns", F.lit(",".join(skipped)))


register("skipped_columns", skipped_columns, " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, COUNT(*) AS record_count, COUNT(*) - COUNT({name}) AS null_count, "
    f"CAST(MIN({name}) AS VARCHAR) AS min_value, CAST(MAX({name}) AS VARCHAR) AS max_value, "
    "'embedding' AS skipped_columns FROM embeddings" for name in ("vec_id", "label")
))

DOCUMENT_TYPES = [("doc_id", "INT64"), ("text", "STRING"), ("lang", "STRING"), ("source", "STRING"), ("n_chars", "INT64")]


def cardinality_guard(spark, folder) -> DataFrame:
    """Outcome of the guard per dimension asked for."""
    kept, skipped = guard_dimensions(table(spark, folder, "documents"), ["text", "lang", "source"], max_dimension_values=10)
    rows = [(name, None, None, "kept") for name in kept]
    rows += [(s.dimension, s.distinct_values, s.maximum_allowed, "skipped") for s in skipped]
    return spark.createDataFrame(rows, "dimension string, distinct_values bigint, maximum_allowed bigint, outcome string")


register("cardinality_guard", cardinality_guard, " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, CASE WHEN COUNT(DISTINCT {name}) > 10 THEN COUNT(DISTINCT {name}) END AS distinct_values, "
    f"CASE WHEN COUNT(DISTINCT {name}) > 10 THEN CAST(10 AS BIGINT) END AS maximum_allowed, "
    f"CASE WHEN COUNT(DISTINCT {name}) > 10 THEN 'skipped' ELSE 'kept' END AS outcome FROM documents"
    for name in ("text", "lang", "source")
))
register(
    "guarded_documents",
    lambda spark, folder: profile(table(spark, folder, "documents"), ["text", "lang"], max_dimension_values=10).metrics,
    profile_sql("SELECT * FROM documents", DOCUMENT_TYPES, ["lang"]),
)

# -- checks ------------------------------------------------------------------------------------------

# What is spoiled in the metrics of the dirty events by category, row by row.
SPOILED = [
    "'events' AS unique_id", "dimension_name", "dimension_value",
    "CASE WHEN dimension_value = 'error' AND column_name = 'ts' THEN record_count + 5 ELSE record_count END AS record_count",
    "column_order", "column_name",
    "CASE WHEN dimension_value = ' ' AND column_name = 'user_id' THEN 'STRING' ELSE column_type END AS column_type",
    "column_description",
    "CASE WHEN dimension_value = '' AND column_name = 'amount' THEN null_count + 1 ELSE null_count END AS null_count",
    "CASE WHEN dimension_value = 'click' AND column_name = 'amount' THEN 1.5 ELSE null_rate END AS null_rate",
    "empty_string_count", "missing_count",
    "CASE WHEN dimension_value = 'click' AND column_name = 'active' THEN 0.5 ELSE missing_rate END AS missing_rate",
    "CASE WHEN dimension_name IS NULL AND column_name = 'category' THEN record_count + 1 ELSE distinct_count END AS distinct_count",
    "CASE WHEN dimension_value = '' AND column_name = 'category' THEN NULL ELSE distinct_ratio END AS distinct_ratio",
    "min_value", "max_value",
    "CASE WHEN dimension_value = ' ' AND column_name = 'active' THEN -1 ELSE true_count END AS true_count",
]
# Missing column, missing bucket.
KEPT = "NOT (coalesce(dimension_value, '-') = ' ' AND column_name = 'ts') AND coalesce(dimension_value, '-') <> 'view'"


def relation_row(spark, *dimensions: str) -> DataFrame:
    return spark.createDataFrame(
        [("events", DIRTY_TYPES, list(dimensions), True)],
        "unique_id string, columns array<struct<name:string,data_type:string>>, dimensions array<string>, treat_empty_string_as_null boolean")


def events_metrics(spark, folder, dimensions: list[str]) -> DataFrame:
    """Written metrics of the dirty events, as a run checks them."""
    found = profile_columns(dirty(spark, folder), dimensions, treat_empty_string_as_null=True)
    return staged(found.withColumn("unique_id", F.lit("events")))


def validate_metrics(spark, folder) -> DataFrame:
    sound = events_metrics(spark, folder, ["category"])
    return validate(sound.where(KEPT).selectExpr(*(text.replace("'events' AS ", "") for text in SPOILED)), relation_row(spark, "category"))


_RATE = "COALESCE(CAST({} AS DOUBLE) / NULLIF(record_count, 0), 0.0)"


def _off(actual: str, expected: str) -> str:
    return (
        f"NOT COALESCE(abs({actual} - {expected}) <= greatest(1e-6 * greatest(abs({actual}), abs({expected})), 1e-9), false)"
    )


_ROW_CHECKS = {
    "missing_count": "missing_count <> null_count + CASE WHEN column_type = 'STRING' THEN empty_string_count ELSE 0 END",
    "count_bounds": "null_count + empty_string_count > record_count OR null_count + coalesce(true_count, 0) > record_count "
                    "OR coalesce(distinct_count, 0) > record_count - missing_count",
    "rates": f"{_off('null_rate', _RATE.format('null_count'))} OR {_off('missing_rate', _RATE.format('missing_count'))}",
    "distinct_ratio": f"distinct_count IS NOT NULL AND {_off('distinct_ratio', _RATE.format('distinct_count'))}",
    "ranges": "null_count < 0 OR missing_count < 0 OR true_count < 0 OR distinct_count < 0 OR null_rate NOT BETWEEN 0 AND 1 "
              "OR missing_rate NOT BETWEEN 0 AND 1 OR distinct_ratio NOT BETWEEN 0 AND 1",
}
_EXPECTED = ", ".join(f"('{n}', '{t}')" for n, t in DIRTY_TYPES)
_SPOILED_SQL = (
    f"metrics AS (SELECT {', '.join(SPOILED)} FROM ({profile_sql(DIRTY_SQL, DIRTY_TYPES, ['category'], flag=True)}) WHERE {KEPT}), "
    f"expected(column_name, column_type) AS (VALUES {_EXPECTED}), "
    "slices AS (SELECT unique_id, dimension_name, dimension_value, COUNT(*) AS n, COUNT(DISTINCT e.column_name) AS found, "
    "MAX(record_count) AS records, MIN(record_count) AS fewest FROM metrics m LEFT JOIN expected e "
    "USING (column_name, column_type) GROUP BY ALL) "
)
_EMPTY = "CAST(NULL AS VARCHAR)"
register("validate_metrics", validate_metrics, f"WITH {_SPOILED_SQL}" + " UNION ALL ".join(
    [
        f"SELECT '{check}' AS \"check\", unique_id, dimension_name, dimension_value, column_name FROM metrics WHERE {predicate}"
        for check, predicate in _ROW_CHECKS.items()
    ] + [
        f"SELECT 'columns', unique_id, dimension_name, dimension_value, {_EMPTY} FROM slices WHERE n <> 8 OR found <> 8",
        f"SELECT 'record_count', unique_id, dimension_name, dimension_value, {_EMPTY} FROM slices WHERE records <> fewest",
        f"SELECT 'reconciliation', unique_id, dimension_name, {_EMPTY}, {_EMPTY} FROM slices WHERE dimension_name IS NOT NULL "
        "GROUP BY unique_id, dimension_name HAVING SUM(records) <> (SELECT records FROM slices WHERE dimension_name IS NULL)",
    ]
))
register(
    "validate_sound_metrics",
    lambda spark, folder: validate(
        events_metrics(spark, folder, ["category", "event_date"]), relation_row(spark, "category", "event_date")),
    "SELECT '' AS \"check\", '' AS unique_id, '' AS dimension_name, '' AS dimension_value, '' AS column_name "
    "FROM events WHERE event_id < 0",
)
register(
    "validate_dimensions",
    lambda spark, folder: validate(
        events_metrics(spark, folder, ["category", "event_date"]).where("dimension_name IS NOT NULL"), relation_row(spark, "category")),
    "SELECT 'overall' AS \"check\", 'events' AS unique_id, CAST(NULL AS VARCHAR) AS dimension_name, "
    "CAST(NULL AS VARCHAR) AS dimension_value, CAST(NULL AS VARCHAR) AS column_name FROM events HAVING COUNT(*) > 0 "
    "UNION ALL SELECT 'unexpected_dimension', 'events', 'event_date', NULL, NULL FROM events HAVING COUNT(*) > 0",
)
register(
    "reconcile_dimension_counts",
    lambda spark, folder: dimension_totals(events_metrics(spark, folder, ["event_date", "category"])),
    "SELECT 'events' AS unique_id, CAST(NULL AS VARCHAR) AS dimension_name, CAST(1 AS BIGINT) AS slices, COUNT(*) AS records FROM events "
    + " ".join(
        f"UNION ALL SELECT 'events', '{d}', COUNT(DISTINCT {d}) + CAST(MAX(CASE WHEN {d} IS NULL THEN 1 ELSE 0 END) AS BIGINT), COUNT(*) "
        f"FROM ({DIRTY_SQL})" for d in ("event_date", "category")
    ),
)
