"""Run every query against its SQL at a chosen scale: python tests/check_all.py FOLDER [NAME ...]."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, queries, sql = connect(folder), entry.queries(), entry.oracle_sql()
    wrong = 0
    for name in names or sorted(queries):
        started = time.time()
        frame = queries[name](spark, folder)
        rows = frame.count()
        seconds = time.time() - started
        found = difference(frame, connection, sql[name]) if name in sql else "no SQL"
        wrong += found is not None
        print(f"{name:32s} rows {rows:8d}  {seconds:6.2f}s  {'same' if found is None else found[:600]}", flush=True)
    return wrong


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
