"""Relations, their columns, tests and lineage from dbt artifacts.

One read covers a folder of projects. Each manifest and catalog is one JSON object, so it is one row;
from there on rows are nodes, and the work spreads over projects and nodes alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colmetry.functions.configuration import profiling_struct
from colmetry.functions.json_text import normal_columns
from colmetry.schema import RELATION_COLUMNS
from colmetry.sources import files

PROFILING = (
    "struct<enabled:boolean,dimensions:array<string>,max_dimension_values:bigint,"
    "max_bytes_billed:string,treat_empty_string_as_null:boolean,where:variant>"
)
NODE = (
    "struct<unique_id:string,resource_type:string,package_name:string,name:string,alias:string,"
    "identifier:string,database:string,schema:string,description:string,"
    "columns:map<string,struct<data_type:string,description:string>>,"
    "depends_on:struct<nodes:array<string>>,tags:array<string>,"
    f"config:struct<materialized:string,tags:array<string>,meta:struct<profiling:{PROFILING}>>,"
    "test_metadata:struct<name:string,namespace:string>>"
)
MANIFEST = (
    "metadata struct<project_name:string,generated_at:string>, "
    f"nodes map<string,{NODE}>, sources map<string,{NODE}>"
)
CATALOG_NODE = "struct<columns:map<string,struct<type:string,index:int>>>"
CATALOG = f"metadata struct<generated_at:string>, nodes map<string,{CATALOG_NODE}>, sources map<string,{CATALOG_NODE}>"

_LAST = 10**9  # places of columns that one of the two lists lacks


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests below ``root``: itself a project, or a folder of projects."""
    return _read(spark, root, "manifest.json", MANIFEST)


def read_catalogs(spark: SparkSession, root: str) -> DataFrame:
    """All catalogs below ``root``; none is no error, a malformed one is."""
    pattern = _pattern(spark, root, "catalog.json")
    if not files.matches(spark, pattern):
        return spark.createDataFrame([], f"project string, {CATALOG}")
    return _read(spark, root, "catalog.json", CATALOG)


def _pattern(spark: SparkSession, root: str, name: str) -> str:
    base = str(root).rstrip("/")
    single = files.exists(spark, f"{base}/target/manifest.json")
    return f"{base}/target/{name}" if single else f"{base}/*/target/{name}"


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    read = spark.read.schema(schema).json(_pattern(spark, root, name), multiLine=True, mode="FAILFAST")
    project = F.regexp_replace(F.col("_metadata.file_path"), f"/target/{name}$", "")
    return read.select(project.alias("project"), *read.columns)


def projects(manifests: DataFrame, catalogs: DataFrame) -> DataFrame:
    """One row per project, with whether its catalog is older than its manifest.

    A stale catalog is still used, its column types may be out of date.
    """
    made = manifests.select(
        "project", F.col("metadata.project_name").alias("project_name"),
        F.col("metadata.generated_at").try_cast("timestamp").alias("manifest_at"),
    )
    listed = catalogs.select("project", F.col("metadata.generated_at").try_cast("timestamp").alias("catalog_at"))
    return made.join(listed, "project", "left").withColumn(
        "catalog_stale", F.coalesce(F.col("catalog_at") < F.col("manifest_at"), F.lit(False))
    )


def relations(manifests: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Models and sources of each project's own package, one row each, plus ``project``.

    A manifest is read once: its nodes, and the labels of its tests for every node they depend on, leave one generator as tagged rows
    and meet in one exchange.
    """
    own = (F.col("is_source") | (F.col("node.resource_type") == "model")) & (F.col("node.package_name") == F.col("project_name"))
    entries = _entries(manifests).where(own | _is_test())
    kinds = {name: entries.schema[name].dataType for name in ("node", "is_source")}
    label_rows = F.transform("node.depends_on.nodes", lambda unique_id, place: F.struct(
        unique_id.alias("unique_id"), *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()],
        F.struct("position", place.alias("dependency"), _test_label().alias("label")).alias("test")))
    node_row = F.struct(F.col("node.unique_id").alias("unique_id"), "node", "is_source", F.lit(None).cast(
        "struct<position:int,dependency:int,label:string>").alias("test"))
    tagged = entries.select("project", F.inline(F.when(_is_test(), label_rows).otherwise(F.array(node_row))))
    nodes = tagged.groupBy("project", "unique_id").agg(
        F.first("node", ignorenulls=True).alias("node"), F.bool_or("is_source").alias("is_source"),
        F.array_sort(F.collect_list("test")).alias("_tests")).where("node IS NOT NULL").withColumn("tests", F.col("_tests.label"))
    tested = nodes.join(_catalog_columns(catalogs), ["project", "is_source", "unique_id"], "left")
    node, source = F.col("node"), F.col("is_source")
    database = F.coalesce(node["database"], F.lit(""))
    schema = F.coalesce(node["schema"], F.lit(""))
    identifier = F.when(source, F.coalesce(node["identifier"], node["name"])).otherwise(
        F.coalesce(node["alias"], node["name"])
    )
    no_strings = F.array().cast("array<string>")
    dependencies = F.filter(
        F.coalesce(node["depends_on"]["nodes"], no_strings), lambda n: n.startswith("model.") | n.startswith("source.")
    )
    return tested.select(
        "project", "unique_id",
        F.when(source, F.lit("source")).otherwise(node["resource_type"]).alias("resource_type"),
        node["name"].alias("name"), database.alias("database"), schema.alias("schema"),
        F.when((database != "") & (schema != ""), F.concat(
            F.lit("`"), F.concat_ws(".", database, schema, identifier), F.lit("`")
        )).otherwise(identifier).alias("relation_name"),
        F.coalesce(node["description"], F.lit("")).alias("description"),
        F.when(source, F.lit("source")).otherwise(
            F.coalesce(node["config"]["materialized"], F.lit("source"))
        ).alias("materialization"),
        F.coalesce(node["config"]["tags"], node["tags"], no_strings).alias("tags"),
        F.coalesce("tests", no_strings).alias("tests"),
        F.array_distinct(dependencies).alias("upstream_ids"),
        normal_columns(_merged_columns(node["columns"], F.col("catalog_columns"))).alias("columns"),
        profiling_struct(_with_text_condition(node["config"]["meta"]["profiling"], node["unique_id"])).alias("profiling"),
        F.lit(None).cast("string").alias("profiled_at"),
        F.lit(None).cast("int").alias("profile_version"),
    )


def _is_test() -> Column:
    return ~F.col("is_source") & (F.col("node.resource_type") == "test")


def _test_label() -> Column:
    named = F.coalesce(F.nullif("node.test_metadata.name", F.lit("")), F.col("node.name"), F.lit("test"))
    return F.concat_ws(".", F.nullif(F.col("node.test_metadata.namespace"), F.lit("")), named)


def tests(manifests: DataFrame) -> DataFrame:
    """Labels of the tests that depend on each node, in manifest order."""
    found = _entries(manifests).where(_is_test()).select(
        "project", "position", _test_label().alias("label"), F.posexplode("node.depends_on.nodes").alias("dependency", "unique_id"),
    )
    # The labels of one node; this list is the result itself.
    return found.groupBy("project", "unique_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "dependency", "label"))).alias("_tests")
    ).select("project", "unique_id", F.col("_tests.label").alias("tests"))


def ingest_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Relations of all projects below ``root``, ordered by database, schema and name."""
    found = relations(read_manifests(spark, root), read_catalogs(spark, root))
    return found.select(*RELATION_COLUMNS).orderBy("database", "schema", "name")


def _entries(manifests: DataFrame) -> DataFrame:
    """One row per node and source. A manifest without a project name raises."""
    name = F.coalesce(
        F.nullif(F.col("metadata.project_name"), F.lit("")),
        F.raise_error(F.lit("cannot import a manifest whose metadata.project_name is missing")),
    )

    def listed(field: str, is_source: bool) -> Column:
        nodes = F.coalesce(F.map_values(field), F.array().cast(f"array<{NODE}>"))
        return F.transform(nodes, lambda node, place: F.struct(
            F.lit(is_source).alias("is_source"), place.alias("position"), node.alias("node")
        ))

    # Both kinds leave one generator, so each use of the entries parses a manifest once.
    both = F.concat(listed("nodes", False), listed("sources", True))
    return manifests.select("project", name.alias("project_name"), F.inline(both)).withColumn("unique_id", F.col("node.unique_id"))


def _catalog_columns(catalogs: DataFrame) -> DataFrame:
    def listed(field: str, is_source: bool) -> Column:
        entries = F.map_entries(F.coalesce(field, F.create_map().cast(f"map<string,{CATALOG_NODE}>")))
        return F.transform(entries, lambda entry: F.struct(
            F.lit(is_source).alias("is_source"), entry["key"].alias("unique_id"), entry["value"]["columns"].alias("catalog_columns")
        ))

    # Both kinds leave one generator, so a catalog is parsed once.
    return catalogs.select("project", F.inline(F.concat(listed("nodes", False), listed("sources", True))))


def _with_text_condition(raw: Column, unique_id: Column) -> Column:
    """Settings whose ``where`` is text; a number or a truth value is refused, as it would pass for a condition."""
    where = raw["where"]
    kind = F.schema_of_variant(where)
    return raw.withField("where", F.when(kind == "STRING", F.try_variant_get(where, "$", "string")).when(
        where.isNotNull() & (kind != "VOID"),
        F.raise_error(F.concat(F.lit("where of "), unique_id, F.lit(" has to be the text of a condition"))).cast("string")))


def _merged_columns(declared: Column, listed: Column) -> Column:
    """Declared and cataloged columns of one node: catalog order first, then manifest order.

    The type is the catalog's, else the declared one, else UNKNOWN. Both maps belong to one node, so
    merging them inside the row needs no further shuffle.
    """
    declared = F.coalesce(declared, F.create_map().cast("map<string,struct<data_type:string,description:string>>"))
    listed = F.coalesce(listed, F.create_map().cast("map<string,struct<type:string,index:int>>"))
    places = F.map_keys(declared)

    def place(name: Column) -> Column:
        found = F.array_position(places, name)
        return F.when(found > 0, found).otherwise(F.lit(_LAST))

    rows = F.transform(F.array_union(F.map_keys(listed), places), lambda name: F.struct(
        F.coalesce(F.try_element_at(listed, name)["index"], F.lit(_LAST)).alias("index"),
        place(name).alias("place"),
        name.alias("name"),
        F.coalesce(
            F.nullif(F.try_element_at(listed, name)["type"], F.lit("")),
            F.nullif(F.try_element_at(declared, name)["data_type"], F.lit("")),
            F.lit("UNKNOWN"),
        ).alias("data_type"),
        F.coalesce(F.try_element_at(declared, name)["description"], F.lit("")).alias("description"),
    ))
    return F.array_sort(rows)
