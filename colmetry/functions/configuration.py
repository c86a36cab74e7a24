"""The profiling settings of a relation: defaults, checks, byte sizes and the result signature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from colmetry.schema import COMPUTATION_VERSION, PROFILING_TYPE

DEFAULT_MAX_DIMENSION_VALUES = 10_000

# Byte-size units.
BYTE_UNITS = {
    "B": 1,
    "KB": 1000, "MB": 1000**2, "GB": 1000**3, "TB": 1000**4, "PB": 1000**5, "EB": 1000**6,
    "KIB": 1024, "MIB": 1024**2, "GIB": 1024**3, "TIB": 1024**4, "PIB": 1024**5, "EIB": 1024**6,
}


def byte_size(text: Column) -> Column:
    """Bytes named by digits or by an amount and a unit such as ``10 GB`` or ``1.5 KiB``.

    Decimal units are powers of 1000 and binary ones of 1024, in any case. NULL when the text is no
    size, or not a positive whole number of bytes.
    """
    sized = r"^(\d*)(?:\.(\d*?)0*)?\s*([A-Za-z]+)$"
    units = F.create_map(*[F.lit(item) for name, size in BYTE_UNITS.items() for item in (name, size)])

    def parts(trimmed: Column) -> Column:
        whole, fraction, unit = (F.regexp_extract(trimmed, sized, i) for i in (1, 2, 3))
        return F.struct(F.concat(whole, fraction).alias("digits"), F.length(fraction).alias("places"), F.upper(unit).alias("unit"))

    def whole_bytes(amount: Column) -> Column:
        return F.when(amount["product"] % amount["scale"] == 0, F.try_divide(amount["product"], amount["scale"]).try_cast("bigint"))

    def named(found: Column) -> Column:
        # amount = digits / scale, kept as two whole numbers so that the product is exact.
        unit = F.try_element_at(units, found["unit"]).cast("decimal(19,0)")
        return let(F.struct(
            F.try_multiply(found["digits"].try_cast("decimal(19,0)"), unit).alias("product"),
            F.rpad(F.lit("1"), found["places"] + 1, "0").try_cast("decimal(19,0)").alias("scale"),
        ), whole_bytes)

    def parsed(trimmed: Column) -> Column:
        return F.when(trimmed.rlike(r"^\d+$"), trimmed.try_cast("bigint")).otherwise(let(parts(trimmed), named))

    return let(let(F.trim(text), parsed), lambda size: F.when(size > 0, size))


def profiling_struct(raw: Column) -> Column:
    """Settings with their defaults filled in; a wrong setting raises when the row is read."""
    limit, where = raw["max_bytes_billed"], raw["where"]
    values = F.coalesce(raw["max_dimension_values"], F.lit(DEFAULT_MAX_DIMENSION_VALUES).cast("bigint"))
    return F.struct(
        F.coalesce(raw["enabled"], F.lit(False)).alias("enabled"),
        F.coalesce(raw["dimensions"], F.array().cast("array<string>")).alias("dimensions"),
        F.when(values > 0, values).otherwise(
            _refuse("max_dimension_values is zero or negative").cast("bigint")
        ).alias("max_dimension_values"),
        F.coalesce(byte_size(limit), F.when(limit.isNotNull(), _refuse(
            "max_bytes_billed is no size: give bytes, or a number and a unit as in 10 GB or 8 GiB"
        ).cast("bigint"))).alias("max_bytes_billed"),
        F.coalesce(raw["treat_empty_string_as_null"], F.lit(False)).alias("treat_empty_string_as_null"),
        F.coalesce(F.nullif(F.regexp_replace(where, r"^\s+|\s+$", ""), F.lit("")), F.when(where.isNotNull(), _refuse(
            "where is blank: give a SQL condition without the word WHERE"
        ).cast("string"))).alias("where"),
    )


def default_profiling() -> Column:
    return profiling_struct(F.lit(None).cast(PROFILING_TYPE.replace("max_bytes_billed:bigint", "max_bytes_billed:string")))


def result_signature() -> Column:
    """Identifies the inputs that decide a relation's stored metrics.

    Two relations with equal signatures have interchangeable results. Switching profiling on or off
    and its scan limit are left out; column descriptions are in, as they are stored with the metrics.
    """
    profiling = F.col("profiling")
    settings = F.struct(*[
        profiling[name].alias(name)
        for name in ("dimensions", "max_dimension_values", "treat_empty_string_as_null", "where")
    ])
    inputs = F.struct(
        "unique_id", "resource_type", "name", "database", "schema", "relation_name", "materialization",
        "columns", settings.alias("profiling"),
    )
    text = F.to_json(inputs, {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws(":", F.lit(COMPUTATION_VERSION), text), 256)


def _refuse(message: str) -> Column:
    return F.raise_error(F.lit(message))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
