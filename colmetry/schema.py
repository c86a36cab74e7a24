"""Column types, stored schemas and the columns a profile covers.

The type labels are the warehouse names used in declared metadata (INT64, FLOAT64, ...); Spark types
are mapped onto them, so a profile reads the same whichever side declared the column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colmetry.errors import ProfileError

COMPUTATION_VERSION = 4
SCHEMA_VERSION = 1

# Type labels, aliases and families of the stored format.
TYPE_ALIASES = {"INTEGER": "INT64", "FLOAT": "FLOAT64", "BOOLEAN": "BOOL"}
NUMERIC_TYPES = ("INT64", "FLOAT64", "NUMERIC", "BIGNUMERIC")
TEMPORAL_TYPES = ("DATE", "DATETIME", "TIMESTAMP")
RANGE_TYPES = NUMERIC_TYPES + TEMPORAL_TYPES
DIMENSION_TYPES = TEMPORAL_TYPES + ("STRING",)
SUPPORTED_TYPES = ("STRING", "BOOL") + RANGE_TYPES

TYPE_FAMILIES = {
    "all": SUPPORTED_TYPES,
    "string": ("STRING",),
    "numeric": NUMERIC_TYPES,
    "boolean": ("BOOL",),
    "date": TEMPORAL_TYPES,
}

COLUMNS_TYPE = "array<struct<name:string,data_type:string,description:string>>"
PROFILING_TYPE = (
    "struct<enabled:boolean,dimensions:array<string>,max_dimension_values:bigint,"
    "max_bytes_billed:bigint,treat_empty_string_as_null:boolean,where:string>"
)

# One row per relation, lists as arrays (the stored form keeps them as JSON text).
RELATION_COLUMNS = (
    "unique_id", "resource_type", "name", "database", "schema", "relation_name", "description",
    "materialization", "tags", "tests", "upstream_ids", "columns", "profiling", "profiled_at",
    "profile_version",
)

STORED_MODELS = (
    "schema_version INT, unique_id STRING, resource_type STRING, model_name STRING, "
    "database_name STRING, schema_name STRING, relation_name STRING, description STRING, "
    "materialization STRING, tags_json STRING, tests_json STRING, columns_json STRING, "
    "profiling_json STRING, profiled_at STRING, profile_version INT, upstream_ids_json STRING"
)

STORED_METRICS = (
    "schema_version INT, unique_id STRING, profile_order INT, dimension_name STRING, "
    "dimension_value STRING, record_count BIGINT, column_order INT, column_name STRING, "
    "column_type STRING, column_description STRING, null_count BIGINT, null_rate DOUBLE, "
    "empty_string_count BIGINT, missing_count BIGINT, missing_rate DOUBLE, distinct_count BIGINT, "
    "distinct_ratio DOUBLE, min_value STRING, max_value STRING, true_count BIGINT"
)


@dataclass(frozen=True)
class ProfiledColumn:
    """One supported column: its place among the supported columns, label and description."""

    order: int
    name: str
    data_type: str
    description: str
    spark_type: T.DataType

    @property
    def value(self) -> Column:
        """The column in a Spark type that holds all its values under the label."""
        target = "string" if self.text_decimal else exact_type(self.spark_type, self.data_type)
        return column_ref(self.name).cast(target) if target else column_ref(self.name)

    @property
    def collation(self) -> str | None:
        """The collation by which strings are equal, None where that is by their bytes."""
        own = getattr(self.spark_type, "collation", None) if self.data_type == "STRING" else None
        return None if own == "UTF8_BINARY" else own

    @property
    def text_decimal(self) -> bool:
        """A decimal too wide for DecimalType, kept as text and ordered by an order key."""
        return self.data_type == "BIGNUMERIC" and isinstance(self.spark_type, T.StringType)


def exact_type(actual: T.DataType, label: str) -> str | None:
    """Spark type to read a column of type ``actual`` in under a declared label without losing anything.

    '' leaves the column as it is: decimals keep their digits whatever the label. None means that some value could change or fail.
    """
    own = type_label(actual)
    decimal = isinstance(actual, T.DecimalType)
    if own == label:
        # Every integral type is INT64 and every float is FLOAT64.
        return {"INT64": "bigint", "FLOAT64": "double"}.get(label, "")
    if label in ("NUMERIC", "BIGNUMERIC"):
        if decimal or (label == "BIGNUMERIC" and own == "STRING"):
            return ""
        return "decimal(20,0)" if own == "INT64" else None
    if label == "INT64" and decimal:
        return "bigint" if actual.scale == 0 and actual.precision <= 18 else None
    if label == "FLOAT64" and isinstance(actual, (T.ByteType, T.ShortType, T.IntegerType)):
        return "double"
    if label == "DATETIME" and own == "DATE":
        return "timestamp_ntz"
    return "string" if label == "STRING" and own is not None else None


def column_ref(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_type(name: str) -> str:
    upper = name.upper()
    return TYPE_ALIASES.get(upper, upper)


def normalize_type_col(name: Column) -> Column:
    """`normalize_type` for a column of declared type names."""
    upper = F.upper(name)
    result = upper
    for alias, label in TYPE_ALIASES.items():
        result = F.when(upper == alias, F.lit(label)).otherwise(result)
    return result


def type_label(data_type: T.DataType) -> str | None:
    """Label of a Spark type, or None when it has no metrics (arrays, structs, binary, ...)."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT64"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "FLOAT64"
    if isinstance(data_type, T.DecimalType):
        narrow = data_type.scale <= 9 and data_type.precision - data_type.scale <= 29
        return "NUMERIC" if narrow else "BIGNUMERIC"
    if isinstance(data_type, T.BooleanType):
        return "BOOL"
    if isinstance(data_type, T.DateType):
        return "DATE"
    if isinstance(data_type, T.TimestampNTZType):
        return "DATETIME"
    if isinstance(data_type, T.TimestampType):
        return "TIMESTAMP"
    return None


def resolve_columns(
    df: DataFrame, declared: Iterable[tuple[str, str, str]] | None = None
) -> tuple[list[ProfiledColumn], list[str]]:
    """Supported columns in order, and the names skipped for their type.

    ``declared`` is (name, type, description) in display order, as imported metadata has it; without
    it the DataFrame's own schema is used. Declared names are found as Spark finds them, without regard to case unless
    ``spark.sql.caseSensitive`` is set, and are reported as declared.
    """
    by_name = {field.name: field.dataType for field in df.schema.fields}
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    folded = {} if sensitive else {name.lower(): kind for name, kind in by_name.items()}
    if declared is None:
        wanted = [(name, type_label(kind) or "UNKNOWN", "") for name, kind in by_name.items()]
    else:
        wanted = [(name, normalize_type(kind), text or "") for name, kind, text in declared]
    profiled: list[ProfiledColumn] = []
    skipped: list[str] = []
    for name, label, description in wanted:
        if label not in SUPPORTED_TYPES:
            skipped.append(name)
            continue
        actual = by_name.get(name, folded.get(name.lower()))
        if actual is None:
            raise ProfileError(f"the table has no column {name!r}, which is declared as {label}")
        if exact_type(actual, label) is None:
            raise ProfileError(f"column {name!r} is declared as {label} but holds {actual.simpleString()}, which does not always fit")
        profiled.append(ProfiledColumn(len(profiled), name, label, description, actual))
    if not profiled:
        raise ProfileError(f"no supported columns found among the {len(wanted)} of the table")
    return profiled, skipped


def resolve_dimension(df: DataFrame, columns: Sequence[ProfiledColumn], name: str) -> ProfiledColumn:
    """The column a dimension names, found as Spark finds columns; it must be temporal or a string."""
    found = [c for c in columns if c.name == name]
    if not found and df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        found = [c for c in columns if c.name.lower() == name.lower()]
    if not found:
        raise ProfileError(f"dimension {name!r} not found among the supported columns")
    if found[0].data_type not in DIMENSION_TYPES:
        raise ProfileError(f"dimension must be DATE, DATETIME, TIMESTAMP or STRING, but {name!r} is {found[0].data_type}")
    return found[0]
