"""Small files and folders on whatever file system Spark itself uses (local, HDFS, object store)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _resolve(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _resolve(spark, path)
    return fs.exists(target)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; none if it does not exist."""
    fs, target = _resolve(spark, path)
    if not fs.exists(target):
        return []
    return [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches a glob pattern."""
    fs, target = _resolve(spark, pattern)
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _resolve(spark, path)
    return fs.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _resolve(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside ``path`` and rename it over the old one."""
    fs, target = _resolve(spark, path)
    jvm = spark._jvm
    staged = jvm.org.apache.hadoop.fs.Path(path + ".next")
    stream = fs.create(staged, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(staged, target, options)


def scratch_root(spark: SparkSession, fallback: str) -> str:
    """The shared folder named for intermediate tables, by setting or by ``setCheckpointDir``, else ``fallback``."""
    named = spark._jsc.sc().getCheckpointDir()
    return (spark.conf.get("spark.checkpoint.dir", None) or (named.get() if named.isDefined() else None) or fallback).rstrip("/")


def temporary_folder(spark: SparkSession, path: str) -> str:
    """Make a folder that goes when the session's JVM ends."""
    fs, target = _resolve(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def staged(df: DataFrame) -> DataFrame:
    """The rows, written below the shared scratch folder and read again; the files go when the session's JVM ends.

    Later plans start from the files, so rows are computed once and lost executors do not undo them.
    """
    spark = df.sparkSession
    root = scratch_root(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    path = temporary_folder(spark, f"{root}/staged-{uuid.uuid4().hex}") + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scanned_bytes(df: DataFrame) -> int | None:
    """Bytes of the files a DataFrame reads, after partition pruning; None if any source is no file scan.

    The sizes are those of the files each scan selects, as listed; optimizer statistics are not used and no job runs. Rows that
    Spark holds as literals are no bytes read. Reading only some columns or row groups is not accounted for, so the figure errs high.
    """
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        leaf = leaves.next()
        kind = leaf.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            total += leaf.selectedPartitions().totalFileSize()
        elif kind not in ("LocalTableScanExec", "EmptyRelationExec"):
            return None
    return total
