"""Views over relations: search, counts, lineage, and keeping results across a new import."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colmetry.functions.configuration import result_signature
from colmetry.schema import COMPUTATION_VERSION
from colmetry.sources.snapshots import Snapshot


def search(relations: DataFrame, query: str = "", profiled_only: bool = False) -> DataFrame:
    """Relations whose name, schema, database or kind contains the query, case aside."""
    found = relations.where("profiled_at IS NOT NULL") if profiled_only else relations
    wanted = query.strip().lower()
    if not wanted:
        return found
    hit = F.lit(False)
    for field in ("name", "schema", "database", "resource_type"):
        hit = hit | F.contains(F.lower(field), F.lit(wanted))
    return found.where(hit)


def counts(relations: DataFrame) -> DataFrame:
    """Relations and profiled relations per database and schema."""
    return relations.groupBy("database", "schema").agg(
        F.count(F.lit(1)).alias("relations"), F.count("profiled_at").alias("profiled")
    )


def totals(relations: DataFrame, query: str = "", profiled_only: bool = False) -> DataFrame:
    """One row: all relations, the profiled ones and those a search shows."""
    shown = search(relations, query, profiled_only).select("unique_id", F.lit(1).alias("_shown"))
    return relations.select("unique_id", "profiled_at").join(shown, "unique_id", "left").agg(
        F.count(F.lit(1)).alias("relations"), F.count("profiled_at").alias("profiled"), F.count("_shown").alias("shown")
    )


def edges(relations: DataFrame) -> DataFrame:
    """One row per direct dependency."""
    return relations.select("unique_id", F.explode("upstream_ids").alias("upstream_id"))


def upstream(relations: DataFrame) -> DataFrame:
    """Direct upstream relations of every relation; ids without a relation are unavailable."""
    known = relations.select(
        F.col("unique_id").alias("upstream_id"), F.col("name").alias("upstream_name"),
        F.col("database").alias("upstream_database"), F.col("schema").alias("upstream_schema"),
        F.col("resource_type").alias("_kind"),
    )
    # A relation many others read puts many edges on one key; adaptive execution broadcasts the
    # relations when they are few and splits the crowded partition when they are not.
    joined = edges(relations).join(known, "upstream_id", "left")
    last = F.element_at(F.split("upstream_id", r"\."), -1)
    return joined.select(
        "unique_id", "upstream_id",
        F.coalesce("_kind", F.lit("Unavailable")).alias("kind"),
        F.coalesce("upstream_name", F.coalesce(F.nullif(last, F.lit("")), "upstream_id")).alias("upstream_name"),
        "upstream_database", "upstream_schema",
    )


def downstream(relations: DataFrame) -> DataFrame:
    """Direct downstream relations of every known relation."""
    users = relations.select(
        F.explode(F.array_distinct("upstream_ids")).alias("unique_id"), F.col("unique_id").alias("downstream_id"),
        F.col("name").alias("downstream_name"), F.col("resource_type").alias("kind"),
    )
    return users.join(relations.select("unique_id"), "unique_id", "left_semi").select(
        "unique_id", "downstream_id", "downstream_name", "kind"
    )


def carry_over(imported: DataFrame, stored: Snapshot) -> Snapshot:
    """Newly imported relations with the stored results that still hold.

    A result is kept when its relation is imported again with an equal result signature and the
    stored metrics are of the current computation version. Relations no longer imported are gone.
    """
    measured = stored.metrics.select("unique_id").distinct()
    old = (
        stored.relations.where(F.col("profile_version") == COMPUTATION_VERSION)
        .join(measured, "unique_id", "left_semi")
        .select("unique_id", result_signature().alias("_signature"), F.col("profiled_at").alias("_at"),
                F.col("profile_version").alias("_version"))
    )
    kept = F.col("_version").isNotNull()
    merged = imported.withColumn("_signature", result_signature()).join(old, ["unique_id", "_signature"], "left")
    relations = merged.withColumns({
        "profiled_at": F.when(kept, F.col("_at")).otherwise(F.col("profiled_at")),
        "profile_version": F.when(kept, F.col("_version")).otherwise(F.col("profile_version")),
    }).select(*imported.columns)
    valid = merged.where(kept).select("unique_id")
    return Snapshot(relations, stored.metrics.join(valid, "unique_id", "left_semi"))


def merge_results(stored: Snapshot, metrics: DataFrame, profiled: DataFrame, profiled_at: str) -> Snapshot:
    """Replace the results of the relations profiled in a run, keep all others.

    ``profiled`` holds the ``unique_id`` of each relation in the run.
    """
    ids = profiled.select("unique_id").distinct().withColumn("_new", F.lit(True))
    relations = stored.relations.join(ids, "unique_id", "left").withColumns({
        "profiled_at": F.when(F.col("_new"), F.lit(profiled_at)).otherwise(F.col("profiled_at")),
        "profile_version": F.when(F.col("_new"), F.lit(COMPUTATION_VERSION)).otherwise(F.col("profile_version")),
    }).select(*stored.relations.columns)
    kept = stored.metrics.join(ids, "unique_id", "left_anti")
    return Snapshot(relations, kept.unionByName(metrics.select(*stored.metrics.columns)))
