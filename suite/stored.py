"""Queries that write results and read them back, and the run history."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from colmetry import SnapshotStore, profile_columns
from colmetry.functions.configuration import default_profiling
from colmetry.operators import catalog
from colmetry.plans.tasks import profiled_names, run_summary
from colmetry.schema import COLUMNS_TYPE
from colmetry.sources import files
from colmetry.sources.json_catalog import CATALOG_ROW, from_nested
from colmetry.sources.snapshots import Snapshot, number_slices, read_tables, stage_slices
from suite.inputs import CUSTOMER_RELATIONS, DIRTY_EVENTS, DIRTY_TYPES, listed, table
from suite.expected_sql import profile_sql

QUERIES, SQL = {}, {}


def register(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    SQL[name] = sql


def scratch(spark) -> str:
    """A new folder in the session's shared folder, else in the warehouse; removed when the session ends."""
    root = files.scratch_root(spark, spark.conf.get("spark.sql.warehouse.dir") + "/_scratch")
    return files.temporary_folder(spark, f"{root}/suite-{uuid4().hex}")


def relations(frame: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Rows of a table as relations."""
    strings = F.array().cast("array<string>")
    return frame.selectExpr(*[f"{e} AS {n}" for n, e in expressions.items()]).withColumns({
        "relation_name": F.concat_ws(".", "database", "schema", "name"),
        "description": F.lit(""),
        "materialization": F.lit("table"),
        "tags": F.array(F.lit("daily"), F.col("schema")),
        "tests": strings,
        "upstream_ids": strings,
        "columns": F.array().cast(COLUMNS_TYPE),
        "profiling": default_profiling(),
        "profile_version": F.when(F.col("profiled_at").isNotNull(), F.lit(4)),
    })


def dirty_store(spark, folder) -> SnapshotStore:
    """A store holding the dirty events' metrics, written twice so that the second generation is current."""
    base = scratch(spark)
    store = SnapshotStore(spark, f"{base}/store")
    events = table(spark, folder, "events").selectExpr(*DIRTY_EVENTS)
    metrics = profile_columns(events, ["event_date", "category"]).withColumn("unique_id", F.lit("model.shop.events"))
    stage_slices(metrics, f"{base}/staged")
    one = spark.range(1).selectExpr(
        "'model.shop.events' AS unique_id", "'model' AS resource_type", "'events' AS name", "'db' AS database", "'raw' AS schema",
        "'2026-09-01T00:00:00+00:00' AS profiled_at",
    )
    named = relations(one, {n: n for n in one.columns})
    store.write(named, number_slices(spark.read.parquet(f"{base}/staged")))
    store.write(*_parts(store.read()))
    return store


def _parts(snapshot: Snapshot) -> tuple[DataFrame, DataFrame]:
    return snapshot.relations, snapshot.metrics


_DIRTY = profile_sql(listed(DIRTY_EVENTS, "events"), DIRTY_TYPES, ["event_date", "category"])
_STORED = (
    "SELECT * EXCLUDE (dimension_order), 'model.shop.events' AS unique_id, CAST(DENSE_RANK() OVER (ORDER BY dimension_order, "
    "coalesce(dimension_value, ''), dimension_value IS NOT NULL) - 1 AS INTEGER) AS profile_order "
    f"FROM ({_DIRTY})"
)
register("snapshot_roundtrip", lambda spark, folder: dirty_store(spark, folder).read().metrics, _STORED)


def single_relation(spark, folder) -> DataFrame:
    found = dirty_store(spark, folder).read_relation("events")
    return found.metrics.join(found.relations.select("unique_id", "name", F.size("columns").alias("declared")), "unique_id").select(
        "name", "declared", "profile_order", "column_name", "null_count")


register("single_relation_read", single_relation, f"SELECT 'events' AS name, 8 AS declared, profile_order, column_name, null_count FROM ({_STORED})")


def older_format(spark, folder, versioned: bool) -> DataFrame:
    """Results rewritten without the columns that came later, read through the upgrade."""
    store = dirty_store(spark, folder)
    old = f"{scratch(spark)}/old"
    models = spark.read.parquet(f"{store.location()}/models.parquet").drop("profile_version", "upstream_ids_json", "profiling_json")
    metrics = spark.read.parquet(f"{store.location()}/column_profiles.parquet").drop(
        "empty_string_count", "missing_count", "missing_rate", "distinct_ratio")
    if not versioned:
        metrics = metrics.join(models.select("unique_id", "model_name"), "unique_id").drop("unique_id", "schema_version")
        models = models.drop("schema_version")
    models.write.parquet(f"{old}/models.parquet")
    metrics.write.parquet(f"{old}/column_profiles.parquet")
    read = read_tables(spark, old)
    versions = read.relations.select("unique_id", "profile_version", F.size("upstream_ids").alias("upstream"))
    return read.metrics.join(versions, "unique_id")


_OLD = (
    "SELECT * REPLACE (CAST(0 AS BIGINT) AS empty_string_count, null_count AS missing_count, null_rate AS missing_rate), "
    f"1 AS profile_version, 0 AS upstream FROM ({_STORED})"
)
register("upgrade_on_read", lambda spark, folder: older_format(spark, folder, True), _OLD)
register("legacy_read", lambda spark, folder: older_format(spark, folder, False), _OLD)


# -- many relations: every customer is one, with a slice of metrics -------------------------------------

_CUSTOMER_METRICS = {
    "unique_id": CUSTOMER_RELATIONS["unique_id"], "profile_order": "0", "dimension_name": "CAST(NULL AS STRING)",
    "dimension_value": "CAST(NULL AS STRING)", "record_count": "CAST(c_nationkey AS BIGINT)", "column_order": "0",
    "column_name": "'balance'", "column_type": "'FLOAT64'", "column_description": "''", "null_count": "CAST(0 AS BIGINT)",
    "null_rate": "CAST(0 AS DOUBLE)", "empty_string_count": "CAST(0 AS BIGINT)", "missing_count": "CAST(0 AS BIGINT)",
    "missing_rate": "CAST(0 AS DOUBLE)", "distinct_count": "CAST(NULL AS BIGINT)", "distinct_ratio": "CAST(NULL AS DOUBLE)",
    "min_value": "CAST(c_acctbal AS STRING)", "max_value": "CAST(c_acctbal AS STRING)", "true_count": "CAST(NULL AS BIGINT)",
}


def customer_results(spark, folder) -> Snapshot:
    customers = table(spark, folder, "customer")
    measured = customers.where("c_custkey % 3 = 0").selectExpr(*[f"{e} AS {n}" for n, e in _CUSTOMER_METRICS.items()])
    return Snapshot(relations(customers, CUSTOMER_RELATIONS), measured)


def carried(spark, folder) -> DataFrame:
    """A new import of the customers with some changed and some gone, and what is kept for each."""
    stored = customer_results(spark, folder)
    key = F.substring_index("unique_id", ".", -1).cast("bigint")
    changed = F.when(key % 5 == 0, F.concat("relation_name", F.lit("_v2"))).otherwise(F.col("relation_name"))
    limit = F.col("profiling").withField("max_bytes_billed", F.when(key % 2 == 0, F.lit(10)).cast("bigint"))
    imported = stored.relations.where(key % 7 != 0).withColumns({
        "relation_name": changed, "description": F.lit("changed"),
        "profiling": F.when(key % 9 == 0, limit.withField("where", F.lit("x > 1"))).otherwise(limit),
        "profiled_at": F.lit(None).cast("string"), "profile_version": F.lit(None).cast("int"),
    })
    kept = catalog.carry_over(imported, stored)
    rows = kept.metrics.groupBy("unique_id").agg(F.count(F.lit(1)).alias("metric_rows"))
    return kept.relations.join(rows, "unique_id", "left").select("unique_id", "description", "profiled_at", "profile_version", "metric_rows")


_KEPT = "c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 9 <> 0"
register(
    "carry_over", carried,
    f"SELECT {CUSTOMER_RELATIONS['unique_id']} AS unique_id, 'changed' AS description, "
    f"CASE WHEN {_KEPT} THEN '2026-09-01T00:00:00+00:00' END AS profiled_at, CASE WHEN {_KEPT} THEN 4 END AS profile_version, "
    f"CASE WHEN {_KEPT} THEN CAST(1 AS BIGINT) END AS metric_rows FROM customer WHERE c_custkey % 7 <> 0",
)


def merged(spark, folder) -> DataFrame:
    """Half of the customers profiled again."""
    stored = customer_results(spark, folder)
    key = F.substring_index("unique_id", ".", -1).cast("bigint")
    fresh = stored.metrics.where(key % 2 == 0).withColumn("null_count", F.lit(7).cast("bigint"))
    after = catalog.merge_results(stored, fresh, fresh.select("unique_id"), "2026-12-01T00:00:00+00:00")
    return after.relations.join(after.metrics, "unique_id", "left").select("unique_id", "profiled_at", "profile_version", "null_count")


register(
    "result_merge", merged,
    f"SELECT {CUSTOMER_RELATIONS['unique_id']} AS unique_id, CASE WHEN c_custkey % 3 <> 0 THEN NULL WHEN c_custkey % 2 = 0 "
    "THEN '2026-12-01T00:00:00+00:00' ELSE '2026-09-01T00:00:00+00:00' END AS profiled_at, "
    "CASE WHEN c_custkey % 3 = 0 THEN 4 END AS profile_version, CASE WHEN c_custkey % 3 <> 0 THEN NULL "
    "WHEN c_custkey % 2 = 0 THEN CAST(7 AS BIGINT) ELSE 0 END AS null_count FROM customer",
)


def stored_relations(spark, folder) -> DataFrame:
    """Relations written, and read back without the metric table."""
    store = SnapshotStore(spark, f"{scratch(spark)}/store")
    results = customer_results(spark, folder)
    store.write(results.relations, results.metrics)
    return store.read_relations().select(
        "unique_id", "name", "database", "schema", "relation_name", F.array_join("tags", "|").alias("tags"),
        F.try_element_at("columns", F.lit(1))["name"].alias("first_column"),
        "profiled_at", F.col("profiling.max_dimension_values").alias("max_dimension_values"),
    )


register(
    "stored_relations", stored_relations,
    "SELECT unique_id, name, \"database\", \"schema\", concat_ws('.', \"database\", \"schema\", name) AS relation_name, "
    "'daily|' || \"schema\" AS tags, CASE WHEN profiled_at IS NOT NULL THEN 'balance' END AS first_column, profiled_at, "
    "CAST(10000 AS BIGINT) AS max_dimension_values FROM (SELECT "
    + ", ".join(f'{e} AS "{n}"' for n, e in CUSTOMER_RELATIONS.items()) + " FROM customer)",
)


# -- nested JSON: every order is a relation with a profile -----------------------------------------------

_ORDER_JSON = (
    """concat('{"name":"order_', o_orderkey, '","database":"db","schema_name":"', o_orderstatus, """
    """'","materialization":"table","tags":["', o_orderpriority, '"],"profiling":{"enabled":true,"max_bytes_billed":"2 KB"},"""
    """"profiles":[{"dimension_name":null,"dimension_value":null,"record_count":', o_custkey + 1, ',"columns":["""
    """{"name":"price","data_type":"float","null_count":1,"null_rate":0.5,"min_value":', o_totalprice, ',"max_value":"x"},"""
    """{"name":"status","data_type":"STRING","null_count":0,"null_rate":0,"missing_count":1,"missing_rate":1,"distinct_count":1}]}]}')"""
)


def nested_json(spark, folder) -> DataFrame:
    lines = table(spark, folder, "orders").selectExpr(f"{_ORDER_JSON} AS text")
    # inline() parses each text once, however many of its fields are used.
    nested = lines.select(F.inline(F.array(F.from_json("text", CATALOG_ROW, {"mode": "FAILFAST"}))))
    read = from_nested(files.staged(nested))
    named = read.relations.select("unique_id", F.col("profiling.max_bytes_billed").alias("limit_bytes"))
    return read.metrics.join(named, "unique_id").select(
        "unique_id", "limit_bytes", "record_count", "column_order", "column_name", "column_type", "null_count", "missing_count",
        "missing_rate", "distinct_ratio", "max_value")


_ORDER_ID = "'model.db.' || o_orderstatus || '.order_' || CAST(o_orderkey AS VARCHAR) AS unique_id, CAST(2000 AS BIGINT) AS limit_bytes"
register(
    "json_catalog_rows", nested_json,
    f"SELECT {_ORDER_ID}, o_custkey + 1 AS record_count, 0 AS column_order, 'price' AS column_name, 'FLOAT64' AS column_type, "
    "CAST(1 AS BIGINT) AS null_count, CAST(1 AS BIGINT) AS missing_count, CAST(0.5 AS DOUBLE) AS missing_rate, CAST(NULL AS DOUBLE) AS distinct_ratio, 'x' AS max_value FROM orders "
    f"UNION ALL SELECT {_ORDER_ID}, o_custkey + 1, 1, 'status', 'STRING', 0, 1, 1.0, CAST(1 AS DOUBLE) / (o_custkey + 1), NULL FROM orders",
)

# -- run history: every event is a task of its user's run ------------------------------------------------

RUN_RESULTS = [
    "concat('run_', CAST(user_id AS VARCHAR(20))) AS run_id", "event_type AS unique_id", "event_type AS name",
    "CAST(event_id AS INT) AS task_number",
    "CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'skipped' ELSE 'succeeded' END AS status",
    "CASE WHEN user_id % 2 = 0 AND event_id % 4 = 0 THEN NULL ELSE event_id * 100 END AS bytes_processed",
    "user_id % 3 = 0 AS published",
]
register(
    "run_summary",
    lambda spark, folder: run_summary(table(spark, folder, "events").selectExpr(*RUN_RESULTS)),
    "SELECT run_id, COUNT(DISTINCT CASE WHEN status = 'succeeded' THEN unique_id END) AS relations, "
    "COUNT(*) FILTER (WHERE status = 'succeeded') AS succeeded, COUNT(*) FILTER (WHERE status = 'skipped') AS skipped, "
    "COUNT(*) FILTER (WHERE status = 'failed') AS failed, "
    "CAST(SUM(bytes_processed) FILTER (WHERE status = 'succeeded') AS BIGINT) AS bytes_processed, "
    "COUNT(bytes_processed) FILTER (WHERE status = 'succeeded') < COUNT(*) FILTER (WHERE status = 'succeeded') AS partially_reported "
    f"FROM ({listed(RUN_RESULTS, 'events')}) GROUP BY run_id",
)
register(
    "profiled_names",
    lambda spark, folder: profiled_names(table(spark, folder, "events").selectExpr(*RUN_RESULTS)),
    f"SELECT run_id, name, MIN(task_number) AS first_task FROM ({listed(RUN_RESULTS, 'events')}) WHERE published GROUP BY run_id, name",
)
