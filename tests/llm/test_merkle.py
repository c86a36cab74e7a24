"""The Merkle manifest against a plain Python tree, with nulls, empty and long texts, repeated rows, lone sources and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from colmetry.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, leaf string, tree string, row string, idx long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    parts = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def tree(nodes):
    """Root of nodes, and for each the digests to its left and right by level."""
    at, steps, own = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(own) > 1:
        runs = [own[k:k + 3] for k in range(0, len(own), 3)]
        for k, p in enumerate(at):
            steps[k].append((runs[p // 3][:p % 3], runs[p // 3][p % 3 + 1:]))
            at[k] = p // 3
        own = [h(*r) for r in runs]
    return own[0], steps


def expected(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = [(r["doc_id"], leaf(r, r["text"]), leaf(r, r["text"] and r["text"].replace("x", ""))) for r in rows if r["source"] == source]
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        trees.append((own, *tree([t[1] for t in own])))
    root, above = tree([t[1] for t in trees])
    out = []
    for (own, sub, steps), upper in zip(trees, above):
        for (doc_id, kept, changed), lower in zip(own, steps):
            node, proof = changed, ""
            for left, right in lower + upper:
                node, proof = h(*left, node, *right), proof + "".join(left + right)
            out.append((doc_id, kept, sub, root, h(proof), node))
    return sorted(out, key=repr)


def found(frame):
    beside = F.transform("steps", lambda s: F.concat(merkle.as_text(s.left), merkle.as_text(s.right)))
    shown = merkle.manifest(frame, F.replace("text", F.lit("x"), F.lit(""))).select(
        "doc_id", *(merkle.as_text(F.col(c)) for c in ("leaf", "subroot", "root")), F.sha2(F.array_join(beside, ""), 256),
        merkle.as_text(merkle.folded(F.col("changed"), F.col("steps"))))
    return sorted((tuple(r) for r in shown.collect()), key=repr)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 10, 60])
def test_proofs_are_those_of_a_plain_tree(spark, count):
    texts = [None, "", "axb", "ünï ça\n", "x" * 50_000, "12:3", "-"]
    rows = [(i, texts[i % 7], ["en", None][i % 2], [None, "", "a", "é", "Z", "a"][i % 6], i % 3 or None, "c", "t", "r", 7) for i in range(count)]
    rows += [rows[0]] * (count > 3) + [(None, "n", None, "a", 1, "", "", "", 0)] * 2 * (count > 9) + [(3, "other", "en", "é", 5, "", "", "", 0)] * (count > 9)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame) == expected([r.asDict() for r in frame.collect()])


def test_one_row_is_the_root_and_an_empty_table_has_no_rows(spark):
    one = spark.createDataFrame([(5, "t", None, None, None, "", "", "", 0)], SCHEMA)
    row = merkle.manifest(one).first()
    assert row["steps"] == [] and row["leaf"] == row["root"] == row["subroot"] == row["changed"]
    assert merkle.manifest(one.limit(0)).count() == 0


def test_a_large_source_is_asked_for_in_parts(spark):
    # More leaves than a copy of an ancestor serves, so that several copies are asked.
    frame = spark.range(2500).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"),
        F.col("id").cast("string").alias("text"))
    assert found(frame) == expected([r.asDict() for r in frame.collect()])
