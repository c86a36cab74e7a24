"""Metric values as text, and back.

Results of different types share one ``min_value``/``max_value`` column, so they are kept as text.
All of these run on result rows only (one per slice and column), never on the profiled rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def float_text(value: Column) -> Column:
    """A double as shortest round-trip text: plain from 1e-4 up to 1e16, otherwise ``d.ddde+XX``."""
    java = value.cast("string")
    size = F.abs(value)
    # decimal(38,21) holds every plain-range double exactly: 16 integer and 21 fraction digits.
    plain = F.rtrim(F.when((size >= 1e-4) & (size < 1e16), value).cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    digits = F.lpad(F.abs(exponent).cast("string"), 2, "0")
    digits = F.when(F.abs(exponent) >= 100, F.abs(exponent).cast("string")).otherwise(digits)
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(value == 0, java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, sign, digits))
    )


def decimal_text(text: Column) -> Column:
    """Decimal text without padding zeros: ``10.5``, not ``10.500000000``."""
    trimmed = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(F.contains(text, F.lit(".")), trimmed).otherwise(text)


def timestamp_text(value: Column) -> Column:
    """An instant as UTC text with its offset, whatever the session time zone is."""
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(value), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.concat(utc.cast("string"), F.lit("+00"))


def value_text(value: Column, data_type: str) -> Column:
    """Text of a metric or dimension value of the given type label."""
    if data_type == "FLOAT64":
        return float_text(value)
    if data_type in ("NUMERIC", "BIGNUMERIC"):
        return decimal_text(value.cast("string"))
    if data_type == "TIMESTAMP":
        return timestamp_text(value)
    return value.cast("string")


def decimal_order_key(text: Column) -> Column:
    """A string key that sorts decimal text of any length by value (binary order).

    Sign flag, length of the integer part, integer digits, fraction digits. Negative numbers have
    their digits complemented and end in a character above every digit, which reverses their order.
    Minus zero equals zero. Text that is not a plain decimal has no key.
    """
    unsigned = F.ltrim(text, F.lit("+-"))
    whole = F.ltrim(F.substring_index(unsigned, ".", 1), F.lit("0"))
    whole = F.when(whole == "", F.lit("0")).otherwise(whole)
    fraction = F.when(
        F.contains(unsigned, F.lit(".")), F.rtrim(F.substring_index(unsigned, ".", -1), F.lit("0"))
    ).otherwise(F.lit(""))
    body = F.concat(F.lpad(F.length(whole).cast("string"), 6, "0"), whole, fraction)
    zero = F.lit("0000010")
    return F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), (
        F.when(body == zero, F.lit("10000010"))
        .when(text.startswith("-"), F.concat(F.lit("0"), F.translate(body, *_COMPLEMENT), F.lit("~")))
        .otherwise(F.concat(F.lit("1"), body))
    ))


_COMPLEMENT = ("0123456789", "9876543210")


def decimal_from_key(key: Column) -> Column:
    """The decimal text an order key stands for, without padding zeros or a plus sign."""
    negative = key.startswith("0")
    body = F.when(negative, F.translate(F.rtrim(key, F.lit("~")), *_COMPLEMENT)).otherwise(key)
    size = F.substring(body, 2, 6).cast("int")
    whole = F.substr(body, F.lit(8), size)
    fraction = F.substr(body, size + 8)
    number = F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    return F.when(negative, F.concat(F.lit("-"), number)).otherwise(number)


def decode_int(text: Column, data_type: Column) -> Column:
    """INT64 metric text as a bigint; NULL for other types."""
    return F.when(data_type == "INT64", text.try_cast("bigint"))


def decode_double(text: Column, data_type: Column) -> Column:
    """FLOAT64 metric text as a double; NULL for other types."""
    named = (
        F.when(text == "nan", F.lit(float("nan")))
        .when(text == "inf", F.lit(float("inf")))
        .when(text == "-inf", F.lit(float("-inf")))
        .otherwise(text.try_cast("double"))
    )
    return F.when(data_type == "FLOAT64", named)


def distinct_key(value: Column) -> Column:
    """A short stand-in for a string when counting distinct strings, for callers that ask for it.

    Every string but the empty one becomes its length and the SHA-256 of its whole text, whatever its length, so a column of
    long documents shuffles about 70 bytes a row. Equality is that of the bytes.
    """
    digest = F.concat(F.octet_length(value).cast("string"), F.lit(":"), F.sha2(value, 256))
    return F.when(value == "", value).otherwise(digest)
