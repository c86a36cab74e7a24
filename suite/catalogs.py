"""Queries over relation metadata: artifact import, lineage, search, tasks and their cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colmetry.functions.configuration import byte_size, profiling_struct, result_signature
from colmetry.functions.json_text import normal_columns
from colmetry.operators import catalog
from colmetry.plans.tasks import estimated, relation_costs, tasks
from colmetry.schema import COLUMNS_TYPE
from colmetry.sources import artifacts
from suite.inputs import CUSTOMER_RELATIONS, ORDER_RELATIONS, table
from suite.stored import relations

QUERIES, SQL = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def as_relations(expressions: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS \"{n}\"' for n, e in expressions.items())} FROM {source}"


# -- artifacts: every part is a project with a manifest, two in three have a catalog ----------------------

_MANIFEST_JSON = """concat(
  '{"metadata":{"project_name":"shop","generated_at":"2026-09-02T00:00:00Z"},"nodes":{',
  '"model.shop.m', p_partkey, '":{"unique_id":"model.shop.m', p_partkey, '","resource_type":"model","package_name":"shop",',
  '"name":"m', p_partkey, '","alias":"', p_brand, '","database":"db","schema":', if(p_size % 2 = 0, 'null', '"mart"'), ',"description":"made",',
  '"columns":{"declared_only":{"data_type":"numeric","description":"d1"},"both":{"data_type":"string","description":"d2"},"untyped":{}},',
  '"depends_on":{"nodes":["source.shop.s', p_partkey, '","macro.shop.x","model.shop.up","source.shop.s', p_partkey, '"]},',
  '"config":{"materialized":"view","tags":["t', p_size, '"],"meta":{"profiling":{"enabled":', if(p_size % 3 = 0, 'true', 'false'),
  ',"dimensions":["both"],"max_bytes_billed":', if(p_size % 4 = 0, '"1.5 KiB"', cast(p_size as string)), ',"where":"  x > ', p_size, ' "}}}},',
  '"model.other.m":{"unique_id":"model.other.m","resource_type":"model","package_name":"other","name":"foreign","columns":{}},',
  '"test.shop.t1":{"unique_id":"test.shop.t1","resource_type":"test","package_name":"other","name":"t_one",',
  '"test_metadata":{"name":"unique","namespace":"utils"},"depends_on":{"nodes":["model.shop.m', p_partkey, '"]}},',
  '"test.shop.t2":{"unique_id":"test.shop.t2","resource_type":"test","package_name":"shop","name":"plain_test",',
  '"depends_on":{"nodes":["model.shop.m', p_partkey, '","source.shop.s', p_partkey, '"]}}},',
  '"sources":{"source.shop.s', p_partkey, '":{"unique_id":"source.shop.s', p_partkey, '","resource_type":"source","package_name":"shop",',
  '"name":"', p_type, '","identifier":"raw_', p_partkey, '","database":"lake","schema":"in","tags":["src"],"columns":{}}}}')"""
_CATALOG_JSON = """concat(
  '{"metadata":{"generated_at":"', if(p_partkey % 2 = 0, '2026-09-01T23:59:59Z', '2026-09-02T00:00:00+00:00'), '"},"nodes":{"model.shop.m', p_partkey,
  '":{"columns":{"both":{"type":"integer","index":2},"listed_only":{"type":"Date","index":1}}}},"sources":{}}')"""


def project_files(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Manifests and catalogs as the readers return them, from JSON text made of the parts."""
    parts = table(spark, folder, "part")
    strict = {"mode": "FAILFAST"}
    key = F.expr("concat('/projects/', p_partkey)").alias("project")
    # inline() parses each text once, however many of its fields are used.
    manifests = parts.select(key, F.inline(F.array(F.from_json(F.expr(_MANIFEST_JSON), artifacts.MANIFEST, strict))))
    catalogs = parts.where("p_partkey % 3 <> 0").select(
        key, F.inline(F.array(F.from_json(F.expr(_CATALOG_JSON), artifacts.CATALOG, strict))))
    return manifests, catalogs


def imported(spark, folder) -> DataFrame:
    found = artifacts.relations(*project_files(spark, folder))
    return found.select(
        "project", "unique_id", "resource_type", "name", "database", "schema", "relation_name", "description", "materialization",
        F.array_join("tags", ",").alias("tags"), F.array_join("tests", ",").alias("tests"),
        F.array_join("upstream_ids", ",").alias("upstream_ids"),
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["data_type"], c["description"])), ",").alias("columns"),
        F.col("profiling.enabled").alias("enabled"), F.array_join("profiling.dimensions", ",").alias("dimensions"),
        F.col("profiling.max_bytes_billed").alias("max_bytes_billed"), F.col("profiling.where").alias("where_text"),
    )


_CAST_KEY = "CAST(p_partkey AS VARCHAR)"
register(
    "artifact_relations", imported,
    f"SELECT '/projects/' || {_CAST_KEY} AS project, 'model.shop.m' || {_CAST_KEY} AS unique_id, 'model' AS resource_type, "
    f"'m' || {_CAST_KEY} AS name, 'db' AS \"database\", CASE WHEN p_size % 2 = 0 THEN '' ELSE 'mart' END AS \"schema\", "
    "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '`db.mart.' || p_brand || '`' END AS relation_name, 'made' AS description, "
    "'view' AS materialization, 't' || CAST(p_size AS VARCHAR) AS tags, 'utils.unique,plain_test' AS tests, "
    f"'source.shop.s' || {_CAST_KEY} || ',model.shop.up' AS upstream_ids, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'declared_only:NUMERIC:d1,both:STRING:d2,untyped:UNKNOWN:' "
    "ELSE 'listed_only:DATE:,both:INT64:d2,declared_only:NUMERIC:d1,untyped:UNKNOWN:' END AS \"columns\", "
    "p_size % 3 = 0 AS enabled, 'both' AS dimensions, "
    "CASE WHEN p_size % 4 = 0 THEN CAST(1536 AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS max_bytes_billed, "
    "'x > ' || CAST(p_size AS VARCHAR) AS where_text FROM part UNION ALL "
    f"SELECT '/projects/' || {_CAST_KEY}, 'source.shop.s' || {_CAST_KEY}, 'source', p_type, 'lake', 'in', "
    f"'`lake.in.raw_' || {_CAST_KEY} || '`', '', 'source', 'src', 'plain_test', '', '', false, '', NULL, NULL FROM part",
)
register(
    "artifact_projects",
    lambda spark, folder: artifacts.projects(*project_files(spark, folder)).select("project", "project_name", "catalog_stale"),
    f"SELECT '/projects/' || {_CAST_KEY} AS project, 'shop' AS project_name, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS catalog_stale FROM part",
)
register(
    "artifact_tests",
    lambda spark, folder: artifacts.tests(project_files(spark, folder)[0]).select("project", "unique_id", F.size("tests").alias("tests")),
    f"SELECT '/projects/' || {_CAST_KEY} AS project, 'model.shop.m' || {_CAST_KEY} AS unique_id, 2 AS tests FROM part UNION ALL "
    f"SELECT '/projects/' || {_CAST_KEY}, 'source.shop.s' || {_CAST_KEY}, 1 FROM part",
)

# -- settings ----------------------------------------------------------------------------------------------

_SIZES = (
    "CASE l_linenumber % 7 WHEN 0 THEN concat(CAST(l_orderkey AS VARCHAR(20)), ' kb') "
    "WHEN 1 THEN concat(CAST(l_partkey AS VARCHAR(20)), '.5MiB') WHEN 2 THEN CAST(l_suppkey AS VARCHAR(20)) "
    "WHEN 3 THEN concat(CAST(l_linenumber AS VARCHAR(20)), '.0001 GB ') WHEN 4 THEN concat('.', CAST(l_partkey AS VARCHAR(20)), ' KB') "
    "WHEN 5 THEN concat(CAST(l_suppkey AS VARCHAR(20)), ' iB') ELSE concat('-', CAST(l_suppkey AS VARCHAR(20)), ' B') END"
)
register(
    "byte_sizes",
    lambda spark, folder: table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_SIZES} AS size_text")
    .withColumn("bytes", byte_size(F.col("size_text"))),
    f"SELECT l_orderkey, l_linenumber, {_SIZES} AS size_text, CASE l_linenumber % 7 "
    "WHEN 0 THEN NULLIF(l_orderkey * 1000, 0) WHEN 1 THEN l_partkey * 1048576 + 524288 WHEN 2 THEN NULLIF(l_suppkey, 0) "
    "WHEN 3 THEN CAST(l_linenumber AS BIGINT) * 1000000000 + 100000 "
    "WHEN 4 THEN CASE WHEN (l_partkey * 1000) % CAST(pow(10, length(CAST(l_partkey AS VARCHAR))) AS BIGINT) = 0 "
    "THEN NULLIF((l_partkey * 1000) // CAST(pow(10, length(CAST(l_partkey AS VARCHAR))) AS BIGINT), 0) END END AS bytes FROM lineitem",
)


def order_relations(spark, folder) -> DataFrame:
    """Orders as relations with columns, lineage and settings that differ from order to order."""
    orders = table(spark, folder, "orders")
    columns = (
        "array(named_struct('name', 'order_day', 'data_type', 'date', 'description', ''), "
        "named_struct('name', 'payload', 'data_type', 'JSON', 'description', ''), "
        "named_struct('name', 'status', 'data_type', if(o_orderkey % 2 = 0, 'string', 'ARRAY<STRING>'), 'description', ''))"
    )
    dimensions = "CASE o_orderstatus WHEN 'F' THEN array('order_day') WHEN 'O' THEN array('order_day', 'order_day') ELSE array() END"
    limit = "CASE WHEN o_custkey % 3 = 0 THEN concat(CAST(o_custkey + 1 AS STRING), ' KB') END"
    upstream = (
        "CASE WHEN o_orderkey % 5 = 0 THEN array(concat('source.shop.customer.', o_custkey), concat('model.gone.', o_orderkey)) "
        "ELSE array(concat('source.shop.customer.', o_custkey)) END"
    )
    named = orders.selectExpr(
        *[f"{e} AS {n}" for n, e in ORDER_RELATIONS.items()], f"{columns} AS columns", f"{upstream} AS upstream_ids",
        f"named_struct('enabled', o_orderkey % 4 <> 1, 'dimensions', {dimensions}, 'max_dimension_values', CAST(NULL AS BIGINT), "
        f"'max_bytes_billed', {limit}, 'treat_empty_string_as_null', CAST(NULL AS BOOLEAN), 'where', CAST(NULL AS STRING)) AS raw_profiling",
    )
    return named.withColumns({
        "relation_name": F.col("name"), "description": F.lit(""), "materialization": F.lit("table"),
        "tags": F.array().cast("array<string>"), "tests": F.array().cast("array<string>"),
        "columns": normal_columns(F.col("columns").cast(COLUMNS_TYPE)),
        "profiling": profiling_struct(F.col("raw_profiling").cast(artifacts.PROFILING)),
        "profile_version": F.lit(4),
    }).drop("raw_profiling")


def everything(spark, folder) -> DataFrame:
    return order_relations(spark, folder).unionByName(relations(table(spark, folder, "customer"), CUSTOMER_RELATIONS))


# -- lineage -----------------------------------------------------------------------------------------------

register(
    "lineage_upstream",
    lambda spark, folder: catalog.upstream(everything(spark, folder)),
    f"WITH r AS ({as_relations(CUSTOMER_RELATIONS, 'customer')}), e AS (SELECT {ORDER_RELATIONS['unique_id']} AS unique_id, "
    "'source.shop.customer.' || CAST(o_custkey AS VARCHAR) AS upstream_id FROM orders UNION ALL "
    f"SELECT {ORDER_RELATIONS['unique_id']}, 'model.gone.' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 = 0) "
    "SELECT e.unique_id, upstream_id, coalesce(r.resource_type, 'Unavailable') AS kind, "
    "coalesce(r.name, split_part(upstream_id, '.', -1)) AS upstream_name, r.\"database\" AS upstream_database, "
    "r.\"schema\" AS upstream_schema FROM e LEFT JOIN r ON r.unique_id = e.upstream_id",
)
register(
    "lineage_downstream",
    lambda spark, folder: catalog.downstream(everything(spark, folder)),
    "SELECT 'source.shop.customer.' || CAST(c_custkey AS VARCHAR) AS unique_id, "
    f"{ORDER_RELATIONS['unique_id']} AS downstream_id, {ORDER_RELATIONS['name']} AS downstream_name, 'model' AS kind "
    "FROM orders JOIN customer ON o_custkey = c_custkey",
)

# -- catalog -----------------------------------------------------------------------------------------------

register(
    "catalog_counts",
    lambda spark, folder: catalog.counts(everything(spark, folder)),
    "SELECT \"database\", \"schema\", COUNT(*) AS relations, COUNT(profiled_at) AS profiled FROM ("
    f"{as_relations(ORDER_RELATIONS, 'orders')} UNION ALL {as_relations(CUSTOMER_RELATIONS, 'customer')}) GROUP BY ALL",
)
register(
    "catalog_search",
    lambda spark, folder: catalog.search(everything(spark, folder), "  BUILD ", profiled_only=True).select("unique_id", "name"),
    f"SELECT unique_id, name FROM ({as_relations(CUSTOMER_RELATIONS, 'customer')}) WHERE profiled_at IS NOT NULL AND "
    "lower(\"schema\") LIKE '%build%'",
)
register(
    "catalog_totals",
    lambda spark, folder: catalog.totals(everything(spark, folder), "nation_1"),
    "SELECT COUNT(*) AS relations, COUNT(profiled_at) AS profiled, COUNT(*) FILTER (WHERE \"database\" LIKE '%nation_1%') AS shown "
    f"FROM ({as_relations(ORDER_RELATIONS, 'orders')} UNION ALL {as_relations(CUSTOMER_RELATIONS, 'customer')})",
)

# -- tasks -------------------------------------------------------------------------------------------------

_TASKS = (
    f"SELECT {ORDER_RELATIONS['unique_id']} AS unique_id, {ORDER_RELATIONS['name']} AS name, task_order, "
    "CASE WHEN task_order > 0 THEN 'order_day' END AS dimension, "
    "CASE WHEN o_custkey % 3 = 0 THEN (o_custkey + 1) * 1000 END AS max_bytes_billed, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'payload' ELSE 'payload,status' END AS skipped_columns FROM orders, "
    "(VALUES (0), (1), (2)) AS t(task_order) "
    "WHERE task_order <= CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AND o_orderkey % 4 <> 1"
)


def expanded(spark, folder) -> DataFrame:
    return tasks(order_relations(spark, folder).where("profiling.enabled"))


register(
    "task_expansion",
    lambda spark, folder: expanded(spark, folder).select(
        "unique_id", "name", "task_order", "dimension", "max_bytes_billed",
        F.array_join("skipped_columns", ",").alias("skipped_columns")),
    _TASKS,
)


def costs(spark, folder) -> DataFrame:
    """Cost of each order's tasks; a relation's scan reads as much as its lines are many."""
    sizes = table(spark, folder, "lineitem").groupBy(
        F.expr("concat('model.shop.order.', l_orderkey)").alias("unique_id")
    ).agg((F.count(F.lit(1)) * 20000).alias("scan_bytes"))
    return relation_costs(estimated(expanded(spark, folder), sizes))


register(
    "relation_cost", costs,
    f"WITH t AS ({_TASKS}), s AS (SELECT 'model.shop.order.' || CAST(l_orderkey AS VARCHAR) AS unique_id, COUNT(*) * 20000 AS scan_bytes "
    "FROM lineitem GROUP BY l_orderkey), c AS (SELECT unique_id, CAST(SUM(CASE WHEN max_bytes_billed IS NOT NULL THEN scan_bytes END) AS BIGINT) "
    "AS estimated_bytes, MAX(max_bytes_billed) AS max_bytes_billed FROM t LEFT JOIN s USING (unique_id) GROUP BY unique_id) "
    "SELECT *, max_bytes_billed IS NULL OR coalesce(estimated_bytes <= max_bytes_billed, false) AS executable FROM c",
)


def signatures(spark, folder) -> DataFrame:
    """Orders whose result signature survives a change of settings: only those left alone do."""
    before = order_relations(spark, folder)
    key = F.expr("CAST(substring_index(unique_id, '.', -1) AS BIGINT)")
    profiling = F.col("profiling").withField("enabled", ~F.col("profiling.enabled")).withField("max_bytes_billed", F.lit(5).cast("bigint"))
    touched = F.when(key % 3 == 0, profiling.withField("treat_empty_string_as_null", F.lit(True))).otherwise(profiling)
    renamed = F.when(key % 7 == 0, F.transform("columns", lambda c: c.withField("description", F.lit("new")))).otherwise(F.col("columns"))
    after = before.withColumns({"profiling": touched, "columns": renamed, "description": F.lit("other"), "tags": F.array(F.lit("x"))})
    old = before.select("unique_id", result_signature().alias("old"))
    return after.select("unique_id", result_signature().alias("new")).join(old, "unique_id").select(
        "unique_id", (F.col("old") == F.col("new")).alias("kept"))


register(
    "result_signatures", signatures,
    f"SELECT {ORDER_RELATIONS['unique_id']} AS unique_id, o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AS kept FROM orders",
)
