import hashlib
import random
from decimal import Decimal

from pyspark.sql import functions as F

from colmetry.functions.configuration import byte_size
from colmetry.functions.text import decimal_order_key, decimal_text, distinct_key, float_text, timestamp_text


def test_float_text_is_shortest_round_trip(spark):
    rng = random.Random(7)
    values = [1e10, 1e-5, 1e16, 1e15, 0.0, -0.0, 1e-4, 9.999e-5, 1.5e300, -1e-300, 1234567.0, 9007199254740993.0,
              float("inf"), float("-inf"), float("nan"), None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 25) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text(F.col("v")).alias("t")).collect()
    # Some JVMs print one digit more than the shortest form, so the value itself is compared.
    assert all(r.t is None if r.v is None else float(r.t) == r.v or r.t == "nan" for r in rows)
    assert [r.t for r in rows[:15]] == [str(v) for v in values[:15]]


def test_decimal_order_key_sorts_by_value(spark):
    rng = random.Random(3)
    texts = ["0", "-0.0", "+0.00", "-0.51", "-0.5", "007.10", "0.00000000000000000000000000000000000001"]
    for _ in range(400):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 39)))
        fraction = "".join(rng.choice("0123456789") for _ in range(rng.randint(0, 38)))
        texts.append(rng.choice(["", "-", "+"]) + digits + ("." + fraction if fraction else ""))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decimal_order_key(F.col("t")).alias("k")).collect()
    by_key = sorted(rows, key=lambda r: r.k)
    values = [Decimal(r.t) for r in by_key]
    assert values == sorted(values)
    keys = {}
    for r in rows:
        keys.setdefault(Decimal(r.t), set()).add(r.k)
    assert all(len(k) == 1 for k in keys.values())


def test_text_that_is_no_decimal_has_no_key(spark):
    frame = spark.createDataFrame([("1e5",), ("",), ("abc",), (None,)], "t string")
    assert [r.k for r in frame.select(decimal_order_key(F.col("t")).alias("k")).collect()] == [None] * 4


def test_decimal_text_drops_padding_only(spark):
    frame = spark.createDataFrame([("10.500000000",), ("100",), ("100.00",), ("-0.000000001",)], "t string")
    assert [r.d for r in frame.select(decimal_text(F.col("t")).alias("d")).collect()] == ["10.5", "100", "100", "-0.000000001"]


def test_timestamp_text_does_not_depend_on_the_session_zone(spark):
    frame = spark.sql("SELECT timestamp_micros(1757388896123456) AS t")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert frame.select(timestamp_text(F.col("t"))).first()[0] == "2025-09-09 03:34:56.123456+00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_distinct_key_separates_long_strings_by_their_whole_text(spark):
    texts = ["a" * 64, "a" * 65, "a" * 5000 + "x", "a" * 5000 + "y", "", "é" * 33]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(distinct_key(F.col("t")).alias("k"))
    keys = [r.k for r in frame.collect()]
    assert len(set(keys)) == len(texts)
    # Length in bytes and digest, for every string but the empty one.
    assert keys[4] == "" and keys[0] == f"64:{hashlib.sha256(texts[0].encode()).hexdigest()}" and keys[5].startswith("66:")
    assert max(map(len, keys)) < 80


def test_byte_sizes(spark):
    cases = {
        "1024": 1024, " 10 GB ": 10 * 1000**3, "8 GiB": 8 * 1024**3, "1.5kib": 1536, ".5 KB": 500, "2.50 MB": 2500000, "3 b": 3,
        "1 EiB": 1024**6, "0": None, "0 GB": None, "1.0001 B": None, "1.00000001 B": None, "5 iB": None, "5 XB": None,
        "-1 KB": None, "KB": None, "1e3 KB": None, "": None,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string").select("t", byte_size(F.col("t")).alias("n"))
    assert {r.t: r.n for r in frame.collect()} == cases
