"""Merkle manifest of a table: a tree per source over its rows, a tree over the sources, and every row's proof by pointer jumping.

A leaf is the digest of a row's columns. The leaves of a source, in order of id, are joined in runs of ``FANOUT`` to the digest of their
run, and so on up to one node, the source's; the sources' nodes, in order of source, form a tree of the same kind above them.

* Places of leaves come from a range partitioning and the number of rows in the partitions before, so no source is sorted in one task.
* ``STEP`` levels come from one aggregate of at most ``FANOUT ** STEP`` nodes each. Each node gets a pointer to its parent, with a segment
  of one step: the digests to its left and right.
* Proofs: each node holds a pointer to an ancestor and the segment of siblings up to it. Joining the pointers with themselves, node's
  ancestor to ancestor's pointer, doubles the distance and concatenates the segments, until every leaf points to the root. The number
  of joins is the logarithm of the height. Nodes that no later join asks for are left out.
* High ancestors are asked for by many leaves. A node is repeated once per ``SHARE`` leaves below it and each asking row picks one of
  the copies, so no join key has more than about ``SHARE`` rows, whatever share of the table a source holds.

Digests travel as bytes and enter further digests as hexadecimal text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmetry.llm.texts import delete_staged, stage

FANOUT, STEP, SHARE = 3, 4, 729
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# Level of nodes above the sources' own trees; no source's tree is as high.
ABOVE = 1000
STEPS = "array<struct<left:binary,right:binary>>"


def digest(*values: Column) -> Column:
    """SHA-256 of concatenated texts, as bytes."""
    return F.unhex(F.sha2(F.concat(*values), 256))


def as_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def encoded(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself; ``-`` if null. No two values look the same behind one another."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(*(encoded(columns[name]) for name in COLUMNS))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place within ``tree`` by ``order``, and ``n``, how many their tree has; staged."""
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    sorted_ = stage(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    # One row per partition and per tree that begins in it: what stands before each.
    parts = sorted_.groupBy(tree, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(tree)
    parts = parts.select(
        tree, "_part", (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows") - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"))
    placed = stage(sorted_.join(parts, [tree, "_part"]).withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"))
    delete_staged(sorted_)
    return placed


def _grow(nodes: DataFrame, base: int) -> tuple[list[tuple[DataFrame, int]], DataFrame, int]:
    """Levels above ``nodes`` (tree, idx, n, size, key, digest, row): staged tables of groups with the level they start from, the top node
    of every tree, and the greatest height.

    ``key`` (tree, level, idx) names a node, ``size`` are the leaves below it, ``row`` is what a leaf carries, null for others. A group
    is what stands below one node ``STEP`` levels up, at most ``FANOUT ** STEP`` nodes; ``levels`` holds its nodes level by level.
    """
    groups, tops, level, height = [], nodes.where("n = 1"), base, 0
    nothing = F.lit(None).cast(nodes.schema["row"].dataType).alias("row")
    while True:
        child = F.struct("idx", "digest", "size", "key", "row")
        grouped = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / FANOUT ** STEP).alias("idx")).agg(
            F.array_sort(F.collect_list(child)).alias("children"), F.max("n").alias("n"))
        grouped = grouped.withColumn("level0", F.transform("children", lambda c: F.struct(c.digest.alias("digest"), c.size.alias("size"))))
        for k in range(STEP):
            grouped = grouped.withColumn(f"level{k + 1}", _joined(F.col(f"level{k}"), F.ceil(F.col("n") / FANOUT ** k) > 1))
        table = stage(grouped.select(
            "tree", "idx", "n", F.transform("children", lambda c: F.struct(c.key.alias("key"), c.row.alias("row"))).alias("children"),
            F.array(*(f"level{k}" for k in range(STEP + 1))).alias("levels")))
        largest = table.agg(F.max("n")).first()[0]
        if largest is None:
            delete_staged(table)
            return groups, tops, height
        groups.append((table, level))
        # A tree ends where one node is left, else it goes on with the node that stands for each group.
        done = F.size(F.filter("levels", lambda nodes: F.size(nodes) > 0)) - 1
        last = F.element_at("levels", done + 1)[0]
        ended = F.col("n") <= FANOUT ** STEP
        following = table.select(
            "tree", "idx", F.ceil(F.col("n") / FANOUT ** STEP).alias("n"), last.size.alias("size"),
            F.struct("tree", (F.lit(level) + done).alias("level"), "idx").alias("key"), last.digest.alias("digest"), nothing, ended.alias("ended"))
        tops = tops.unionByName(following.where("ended").drop("ended"))
        nodes = following.where("not ended").drop("ended")
        level, height = level + STEP, height + next(k for k in range(1, STEP + 1) if largest <= FANOUT ** k or k == STEP)


def _joined(nodes: Column, more: Column) -> Column:
    """The level above ``nodes``, none unless their tree has ``more`` nodes than one on this level."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")), lambda k: F.slice(nodes, k * FANOUT + 1, F.lit(FANOUT)))
    above = F.transform(runs, lambda run: F.struct(
        digest(F.array_join(F.transform(run, lambda c: as_text(c.digest)), "")).alias("digest"),
        F.aggregate(run, F.lit(0).cast("long"), lambda acc, c: acc + c.size).alias("size")))
    return F.when(more & (F.size(nodes) > 0), above).otherwise(F.slice(above, 1, 0))


def _pointers(groups: DataFrame, level: int) -> DataFrame:
    """From every node of the groups to its parent, with the digests beside it."""
    def of(k: int) -> Column:
        own, above, width = F.col("levels")[k], F.col("levels")[k + 1], FANOUT ** (STEP - k)

        def beside(from_: Column, size: Column) -> Column:
            return F.aggregate(F.slice(own, from_, size), F.lit(b""), lambda acc, c: F.concat(acc, c.digest))

        def pointer(i: Column) -> Column:
            run, at = F.floor(i / FANOUT).cast("int"), i % FANOUT
            here = F.struct("tree", F.lit(level + k).alias("level"), (F.col("idx") * width + i).alias("idx"))
            return F.struct(
                (F.col("children")[i].key if k == 0 else here).alias("key"), own[i].size.alias("size"),
                F.struct("tree", F.lit(level + k + 1).alias("level"), (F.col("idx") * (width // FANOUT) + run).alias("idx")).alias("up"),
                above[run].size.alias("up_size"),
                F.array(F.struct(beside(run * FANOUT + 1, at).alias("left"), beside(i + 2, F.lit(FANOUT - 1) - at).alias("right"))).alias("steps"),
                (F.col("children")[i].row if k == 0 else F.lit(None).cast(groups.schema["children"].dataType.elementType["row"].dataType)).alias("row"))

        return F.when(F.size(above) > 0, F.transform(F.sequence(F.lit(0), F.size(own) - 1), pointer)).otherwise(F.array())

    return groups.select(F.inline(F.concat(*(of(k) for k in range(STEP)))))


def _copies(size: Column) -> Column:
    return F.ceil(size / F.lit(SHARE))


def ask(rows: DataFrame, key: Column, size: Column, nodes: DataFrame) -> DataFrame:
    """``rows`` left-joined with the node (columns key, size and others) that ``key`` names; ``size`` are the leaves below that node."""
    spread = nodes.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("size")) - 1))).drop("size")
    spread = spread.withColumnRenamed("key", "_key")
    asked = rows.withColumns({"_asked": key, "_pick": F.pmod(F.xxhash64("key"), _copies(size))})
    return asked.join(spread, (F.col("_asked") == F.col("_key")) & (F.col("_pick") == F.col("_copy")), "left").drop(
        "_asked", "_pick", "_key", "_copy")


def _jump(pointers: DataFrame, far: int) -> DataFrame:
    """Pointers of twice the distance ``far``; inner nodes that no later jump can ask for are left out."""
    target = pointers.select("key", "size", F.col("up").alias("_up"), F.col("up_size").alias("_up_size"), F.col("steps").alias("_steps"))
    asking = pointers.where((F.col("key.level") == 0) | (F.col("key.level") >= 2 * far))
    return ask(asking, F.col("up"), F.col("up_size"), target).select(
        "key", "size", F.coalesce("_up", "up").alias("up"), F.coalesce("_up_size", "up_size").alias("up_size"),
        F.concat("steps", F.coalesce("_steps", F.array().cast(STEPS))).alias("steps"), "row")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf (bytes) and its steps lead to."""
    return F.aggregate(steps, start, lambda acc, s: digest(as_text(s.left), as_text(acc), as_text(s.right)))


def manifest(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``documents``: doc_id, source, leaf, subroot, root (bytes), ``steps`` (left and right siblings from the leaf
    up), and ``changed``, the leaf of the row with the text ``tampered`` (the leaf itself where none is given).

    Defined cases: nulls are ``-`` in a leaf; a null id or source comes first; rows with one id are in order of their leaves, so
    repeated rows have proofs of their own; a source with one row is its own node, one row alone is the root, with no steps; an empty
    table gives no rows; other columns are ignored. Whole texts count, of any length.
    """
    own = {name: F.col(f"`{name}`") for name in COLUMNS}
    rows = documents.select(
        own["source"].cast("string").alias("source"), encoded(own["source"]).alias("tree"), own["doc_id"].alias("doc_id"),
        leaf_of(own).alias("leaf"), leaf_of(own if tampered is None else own | {"text": tampered}).alias("changed"))
    # The encoded source, which is never null or empty, names a source's tree; the tree above them has an empty name.
    leaves = numbered(rows, "tree", ["doc_id", "leaf"])
    one, level = F.lit(1).cast("long"), F.lit(0).alias("level")
    groups, tops, height = _grow(leaves.select(
        "tree", "idx", "n", one.alias("size"), F.struct("tree", level, "idx").alias("key"), F.col("leaf").alias("digest"),
        F.struct("source", "doc_id", "leaf", "changed", "n").alias("row")), 0)
    names = leaves.where("idx = 0").select("tree", "source")
    sources = numbered(tops.join(names, "tree").select(F.lit("").alias("tree"), "source", "size", "key", "digest", "row"), "tree", ["source"])
    above, top, more = _grow(sources.drop("source"), ABOVE)
    root = F.lit(next((bytes(r["digest"]) for r in top.select("digest").collect()), None)).cast("binary")

    alone = sources.where("size = 1 and n = 1").select(
        "key", "size", F.col("key").alias("up"), F.col("size").alias("up_size"), F.array().cast(STEPS).alias("steps"), "row")
    pointers, far = stage(alone, *(_pointers(t, k) for t, k in groups + above)), 1
    for table, _ in groups + above:
        delete_staged(table)
    while far < height + more:
        jumped = stage(_jump(pointers, far))
        delete_staged(pointers)
        pointers, far = jumped, 2 * far
    subroots = sources.select(F.col("key.tree").alias("key"), "size", F.col("digest").alias("subroot"))
    found = ask(pointers.where("row is not null"), F.col("key.tree"), F.col("row.n"), subroots)
    return found.select("row.doc_id", "row.source", "row.leaf", "subroot", root.alias("root"), "steps", "row.changed")
