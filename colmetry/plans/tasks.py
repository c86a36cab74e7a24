"""What a run will do: one task per relation and slice set, with its cost against the scan limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colmetry.errors import AmbiguousError, ProfileError
from colmetry.schema import SUPPORTED_TYPES


def enabled_relations(relations: DataFrame, selector: str | None = None) -> DataFrame:
    """Relations with profiling on; ``selector`` picks one by name or unique id."""
    enabled = relations.where("profiling.enabled")
    if selector:
        enabled = enabled.where((F.col("name") == selector) | (F.col("unique_id") == selector))
    found = enabled.select("unique_id").limit(2).count()
    if selector and found > 1:
        raise AmbiguousError(f"several enabled relations are called {selector!r}; pick one by its unique_id")
    if selector and not found:
        raise ProfileError(f"{selector!r} did not match any relation that has profiling on")
    if not found:
        raise ProfileError("no relations to run: profiling is off for all of them")
    return enabled


def tasks(relations: DataFrame) -> DataFrame:
    """Overall and then every dimension of each relation, with the columns left out.

    ``task_order`` is 0 for Overall; a dimension listed twice is two tasks.
    """
    unsupported = F.filter("columns", lambda c: ~c["data_type"].isin(*SUPPORTED_TYPES))
    dimensions = F.concat(F.array(F.lit(None).cast("string")), F.col("profiling.dimensions"))
    return relations.select(
        "unique_id", "name", "relation_name",
        F.col("profiling.max_bytes_billed").alias("max_bytes_billed"),
        F.transform(unsupported, lambda c: c["name"]).alias("skipped_columns"),
        F.posexplode(dimensions).alias("task_order", "dimension"),
    )


def estimated(planned: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tasks with ``estimated_bytes``: what their relation's scan reads, if it has a limit.

    ``sizes`` is (unique_id, scan_bytes). Every task counts as a scan of its own, which errs high:
    the dimensions of a relation share their scans.
    """
    limited = F.when(F.col("max_bytes_billed").isNotNull(), F.col("scan_bytes"))
    return planned.join(sizes, "unique_id", "left").withColumn("estimated_bytes", limited).drop("scan_bytes")


def relation_costs(planned: DataFrame) -> DataFrame:
    """Estimates summed per relation against its limit.

    The sum is NULL when a task has no estimate. Tasks of a relation that disagree on the limit raise.
    A relation may run without a limit, or when the sum is known and not above it.
    """
    limit = F.col("max_bytes_billed")
    uneven = (F.min(limit) != F.max(limit)) | (F.count(limit).between(1, F.count(F.lit(1)) - 1))
    cost = planned.groupBy("unique_id").agg(
        F.when(F.count("estimated_bytes") == F.count(F.lit(1)), F.sum("estimated_bytes")).alias("estimated_bytes"),
        F.max(limit).alias("max_bytes_billed"),
        F.coalesce(uneven, F.lit(False)).alias("_uneven"),
    )
    checked = F.when(
        F.col("_uneven"), F.raise_error(F.concat(F.lit("its tasks disagree on the scan limit: "), "unique_id"))
    ).otherwise(F.col("max_bytes_billed"))
    return cost.withColumn("max_bytes_billed", checked.cast("bigint")).withColumn(
        "executable",
        F.col("max_bytes_billed").isNull() | F.coalesce(F.col("estimated_bytes") <= F.col("max_bytes_billed"), F.lit(False)),
    ).drop("_uneven")


def run_summary(results: DataFrame) -> DataFrame:
    """Per run: relations and tasks by outcome, and the bytes of the tasks that reported any."""
    succeeded = F.col("status") == "succeeded"
    reported = succeeded & F.col("bytes_processed").isNotNull()
    return results.groupBy("run_id").agg(
        F.count_distinct(F.when(succeeded, F.col("unique_id"))).alias("relations"),
        F.count_if(succeeded).alias("succeeded"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.when(succeeded, F.col("bytes_processed"))).alias("bytes_processed"),
        (F.count_if(reported) < F.count_if(succeeded)).alias("partially_reported"),
    )


def profiled_names(results: DataFrame) -> DataFrame:
    """Distinct relation names of each published run in task order."""
    return results.where("published").groupBy("run_id", "name").agg(
        F.min("task_number").alias("first_task")
    ).orderBy("run_id", "first_task")
