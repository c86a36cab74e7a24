"""Relations with their profiles from a JSON array (the hierarchical form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colmetry.functions.configuration import profiling_struct
from colmetry.functions.json_text import normal_columns
from colmetry.operators.aggregate import rate
from colmetry.schema import COLUMNS_TYPE, RELATION_COLUMNS, normalize_type_col
from colmetry.sources.artifacts import PROFILING
from colmetry.sources.files import staged
from colmetry.sources.snapshots import STORED_METRIC_COLUMNS, Snapshot

_METRICS = (
    "struct<name:string,data_type:string,description:string,null_count:bigint,null_rate:double,"
    "empty_string_count:bigint,missing_count:bigint,missing_rate:double,distinct_count:bigint,"
    "distinct_ratio:double,min_value:string,max_value:string,true_count:bigint>"
)
CATALOG_ROW = (
    "unique_id string, resource_type string, name string, database string, schema string, "
    "schema_name string, relation_name string, description string, materialization string, "
    "tags array<string>, tests array<string>, upstream_ids array<string>, "
    f"columns {COLUMNS_TYPE}, profiling {PROFILING}, profiled_at string, profile_version int, "
    "profiles array<struct<dimension_name:string,dimension_value:string,record_count:bigint,"
    f"columns:array<{_METRICS}>>>"
)


def read_json_catalog(spark: SparkSession, path: str) -> Snapshot:
    """Read one or many files, each a JSON array of relations with nested profiles. They are parsed once, into the scratch folder."""
    return from_nested(staged(spark.read.schema(CATALOG_ROW).json(path, multiLine=True, mode="FAILFAST")))


def from_nested(nested: DataFrame) -> Snapshot:
    """Relations and long metric rows from rows of ``CATALOG_ROW``; left-out metrics get their defaults."""
    schema = F.coalesce("schema_name", "schema")
    no_strings = F.array().cast("array<string>")
    kind = F.coalesce("resource_type", F.lit("model"))
    named = nested.withColumns({
        "schema": schema,
        "resource_type": kind,
        "unique_id": F.coalesce(F.nullif("unique_id", F.lit("")), F.concat_ws(".", kind, "database", schema, "name")),
    })
    relations = named.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in ("relation_name", "description")},
        **{c: F.coalesce(c, no_strings) for c in ("tags", "tests", "upstream_ids")},
        "columns": normal_columns(F.coalesce("columns", F.array().cast(COLUMNS_TYPE))),
        "profiling": profiling_struct(F.col("profiling")),
    }).select(*RELATION_COLUMNS)
    slices = named.select("unique_id", F.posexplode("profiles").alias("profile_order", "slice"))
    rows = slices.select(
        "unique_id", "profile_order", "slice.dimension_name", "slice.dimension_value", "slice.record_count",
        F.posexplode("slice.columns").alias("column_order", "column"),
    )
    column = F.col("column")
    metrics = rows.select(
        "unique_id", "profile_order", "dimension_name", "dimension_value", "record_count", "column_order",
        column["name"].alias("column_name"),
        normalize_type_col(column["data_type"]).alias("column_type"),
        F.coalesce(column["description"], F.lit("")).alias("column_description"),
        column["null_count"].alias("null_count"),
        column["null_rate"].alias("null_rate"),
        F.coalesce(column["empty_string_count"], F.lit(0)).alias("empty_string_count"),
        F.coalesce(column["missing_count"], column["null_count"]).alias("missing_count"),
        F.coalesce(column["missing_rate"], column["null_rate"]).alias("missing_rate"),
        column["distinct_count"].alias("distinct_count"),
        F.coalesce(column["distinct_ratio"], rate(column["distinct_count"], F.col("record_count"))).alias("distinct_ratio"),
        column["min_value"].alias("min_value"),
        column["max_value"].alias("max_value"),
        column["true_count"].alias("true_count"),
    )
    return Snapshot(relations, metrics.select(*[c for c in STORED_METRIC_COLUMNS if c != "schema_version"]))
