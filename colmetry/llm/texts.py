"""What several operators share: words, folds, the shared scratch folder and staged tables."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colmetry.sources.files import scratch_root, temporary_folder

# Space, tab, line feed, vertical tab, form feed, carriage return: what separates words, in Spark and for bytes.split().
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def plain(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order."""
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def scratch(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares (spark.checkpoint.dir, or what setCheckpointDir named), removed when the session's
    JVM ends. Where neither is set it is below the warehouse folder, which must then be shared too."""
    fallback = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    root = scratch_root(spark, fallback)
    if root == fallback and not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"spark.checkpoint.dir is not set; intermediate tables go to {fallback}, which all executors must share", stacklevel=2)
    return temporary_folder(spark, f"{root}/llm-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(*parts: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: later plans start here, and lost executors do not undo it.

    Several frames of one schema become one table, each written by a job of its own, so that no task carries the plans of all.
    """
    spark = parts[0].sparkSession
    root = scratch(spark)
    for k, part in enumerate(parts):
        part.select(parts[0].columns).write.parquet(f"{root}/{k}")
    return spark.read.schema(parts[0].schema).parquet(*(f"{root}/{k}" for k in range(len(parts))))


def delete_staged(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
        if folder.getName().startswith("llm-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
