"""Relations between their working form (arrays, structs) and their stored form (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colmetry.functions.configuration import let, profiling_struct
from colmetry.schema import COLUMNS_TYPE, SCHEMA_VERSION, normalize_type_col

# Limits and flags may be stored as text or as JSON numbers; a string field reads both.
_PROFILING_TEXT = (
    "struct<enabled:boolean,dimensions:array<string>,max_dimension_values:bigint,"
    "max_bytes_billed:string,treat_empty_string_as_null:boolean,where:string>"
)
_STRICT = {"mode": "FAILFAST"}


def encode_relations(relations: DataFrame) -> DataFrame:
    """Relations as rows of the stored ``models`` table."""
    keep_nulls = {"ignoreNullFields": "false"}
    return relations.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "unique_id", "resource_type",
        F.col("name").alias("model_name"),
        F.col("database").alias("database_name"),
        F.col("schema").alias("schema_name"),
        "relation_name", "description", "materialization",
        F.to_json("tags").alias("tags_json"),
        F.to_json("tests").alias("tests_json"),
        F.to_json("columns").alias("columns_json"),
        F.to_json("profiling", keep_nulls).alias("profiling_json"),
        F.col("profiled_at").cast("string").alias("profiled_at"),
        F.col("profile_version").cast("int").alias("profile_version"),
        F.to_json("upstream_ids").alias("upstream_ids_json"),
    )


def decode_relations(models: DataFrame) -> DataFrame:
    """Rows of the stored ``models`` table as relations."""
    def strings(name: str) -> Column:
        return F.coalesce(F.from_json(name, "array<string>", _STRICT), F.array().cast("array<string>"))

    columns = F.coalesce(F.from_json("columns_json", COLUMNS_TYPE, _STRICT), F.array().cast(COLUMNS_TYPE))
    return models.select(
        "unique_id", "resource_type",
        F.col("model_name").alias("name"),
        F.col("database_name").alias("database"),
        F.col("schema_name").alias("schema"),
        "relation_name", "description", "materialization",
        strings("tags_json").alias("tags"),
        strings("tests_json").alias("tests"),
        strings("upstream_ids_json").alias("upstream_ids"),
        normal_columns(columns).alias("columns"),
        let(F.from_json("profiling_json", _PROFILING_TEXT, _STRICT), profiling_struct).alias("profiling"),
        "profiled_at", "profile_version",
    )


def normal_columns(columns: Column) -> Column:
    """Declared columns with normalised types and no NULL descriptions."""
    return F.transform(columns, lambda c: F.struct(
        c["name"].alias("name"),
        normalize_type_col(F.coalesce(c["data_type"], F.lit("UNKNOWN"))).alias("data_type"),
        F.coalesce(c["description"], F.lit("")).alias("description"),
    ))
