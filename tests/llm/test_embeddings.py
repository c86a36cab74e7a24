"""Embedding near-duplicates against all pairs, with nulls, zeros, copies, ties, empty tables and other columns."""

import math

import numpy as np
import pytest

from colmetry.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, size string, h long, first string"


def brute(rows, limit=embeddings.LIMIT):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near, root = [[] for _ in rows], list(range(n))
    units = [np.array(r[1], float) / np.abs(np.array(r[1], float)).max() if r[2] is not None and usable(r[1]) else None for r in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    for i in range(n):
        for j in range(i + 1, n):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                if units[i] @ units[j] >= limit:
                    near[i].append(j)
                    near[j].append(i)
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        root[i] = min(ids, default=None)
    return sorted(((r[0], len(near[k]), root[k], r[0] is not None and r[0] == root[k]) for k, r in enumerate(rows)), key=repr)


def found(frame, **more):
    return sorted((tuple(r) for r in embeddings.near_duplicates(frame, **more).collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, "f") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [embeddings.BLOCK, 16])
def test_links_and_components_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    rows = []
    for k in range(260):
        # Chains and balls around the limit: noise of several sizes, one centre holding a third.
        centre = centres[0 if k % 3 == 0 else k % 40]
        rows.append((1000 - k, (centre + rng.standard_normal(24) * rng.choice([0.02, 0.2, 0.33])).astype("f4").tolist(), k % 2))
    rows += [(2000 + k, rows[3][1], rows[3][2]) for k in range(30)]
    assert found(made(spark, rows), block=block) == brute(rows)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (1, one, 0), (2, one, None), (None, one, 0), (3, [2.0, 4.0, 6.0], 0), (4, None, 0), (5, [], 0), (6, [0.0, -0.0, 0.0], 0),
            (7, [1.0, None, 3.0], 0), (8, [float("nan"), 1.0, 1.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [1.0, 2.0], 0), (11, [0.0, 1.0, -0.0], 1),
            (12, [-0.0, 1.0, 0.0], 1), (13, [3e38, 3e38, 3e38], 2), (14, [1e-40, 1e-40, 1e-40], 2), (None, [5.0, 0.0, 0.0], 7), (None, [5.0, 0.0, 0.0], 7),
            (-(2 ** 60) - 1, [0.0, 0.0, 1.0], 8), (-(2 ** 60), [0.0, 0.0, 1.0], 8)]
    frame = made(spark, rows)
    assert found(frame) == brute(rows)
    assert found(frame.limit(0)) == []
    assert found(frame.where("label is null")) == [(2, 0, 2, True)]


def test_tables_grow_with_the_label():
    for rows in (1, 10 ** 4, 10 ** 8):
        bits, tables = embeddings.layout(rows)
        assert rows / 2 ** bits <= embeddings.BUCKET
        p = 1 - math.acos(embeddings.LIMIT) / math.pi
        assert (1 - p ** bits) ** tables < 2 * embeddings.MISSED
