"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmetry.llm.texts import delete_staged, stage

PARTS = 64


def connected(edges: DataFrame) -> DataFrame:
    """Columns ``node``, ``root`` for every node of ``edges`` (columns a, b of one orderable type, null-free): the root is the least
    node reachable. Every step is a minimum by node and an equi-join, so no neighbourhood is gathered, and every round is staged.
    A node's neighbours are dealt to ``PARTS`` parts and its minimum goes to each part that has any, so the centre of a large star is
    not one join key. Repeated edges and loops are allowed; an empty table gives no rows."""
    current = stage(_down(edges))
    while True:
        following = stage(_small_star(_large_star(current)))
        same = _digest(following) == _digest(current)
        delete_staged(current)
        current = following
        if same:
            break
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Edges from the greater node u to the lesser node v."""
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with ``part``, and the least v of every u, once for each part that u has edges in."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))
    return dealt, least.select("u", "m", F.explode("parts").alias("part"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least node around it."""
    both, least = _least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return _down(both.where("v > u").join(least, ["u", "part"]).select(F.col("v").alias("a"), F.least("u", "m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, are linked to the least of them."""
    dealt, least = _least(edges)
    moved = dealt.join(least, ["u", "part"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _down(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
