"""Expected shares against their targets, contradicting targets, small tables, clashing columns."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colmetry.llm import mixing

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_expected_shares_meet_feasible_targets(spark):
    cells, goals = mixing.plan(spark.read.parquet(DOCUMENTS))
    rows = mixing.shares(cells, goals).collect()
    assert {r["kind"] for r in rows} == set(mixing.KINDS)
    for r in rows:
        assert r["expected"] == pytest.approx(r["feasible"], rel=1e-4)
    total, expected = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert expected / total == pytest.approx(mixing.BUDGET, rel=1e-4)
    # Only what is drawn whole may stay below what was asked for.
    for kind in mixing.KINDS:
        for r in goals[kind].collect():
            assert r["goal"] == pytest.approx(r["tokens"]) or r["goal"] / total / mixing.BUDGET >= r["asked"] * (1 - 1e-6)


def test_goals_are_the_plain_filling_up(spark):
    held, share = {"a": 10.0, "b": 100.0, "c": 1000.0, "d": 5.0}, {"a": 3.0, "b": 3.0, "c": 3.0, "d": 0.0}
    cells = spark.createDataFrame([(k, k, k, int(v)) for k, v in held.items()], "source string, lang string, topic string, tokens long")
    shares = spark.createDataFrame(list(share.items()), "source string, share double")
    got = {r["source"]: r["goal"] for r in mixing.feasible(cells, "source", shares, 0.5).collect()}
    wanted, left, goals = 0.5 * sum(held.values()), set(held), {}
    while True:
        rest = wanted - sum(goals.values())
        fair = {k: rest * share[k] / sum(share[j] for j in left) for k in left}
        full = {k for k in left if fair[k] >= held[k]}
        if not full:
            goals.update(fair)
            break
        goals.update({k: held[k] for k in full})
        left -= full
    assert got == {k: pytest.approx(v, rel=1e-4) for k, v in goals.items()}


def brute(cells, goals, rounds=4000):
    """Raking by bisection of every category's factor."""
    p = {k: 0.5 for k in cells}
    factor = {(kind, c): 1.0 for kind in range(3) for c in {k[kind] for k in cells}}

    def probability(k):
        return min(1.0, 0.5 * factor[0, k[0]] * factor[1, k[1]] * factor[2, k[2]])

    for _ in range(rounds):
        far = 0
        for kind, c in factor:
            own = [k for k in cells if k[kind] == c]
            met = sum(cells[k] * probability(k) for k in own)
            far = max(far, abs(met - goals[kind][c]) / goals[kind][c])
            low, high = 0.0, 1e9
            for _ in range(200):
                factor[kind, c] = (low + high) / 2
                low, high = (factor[kind, c], high) if sum(cells[k] * probability(k) for k in own) < goals[kind][c] else (low, factor[kind, c])
        if far < 1e-9:
            break
    p = {k: probability(k) for k in cells}
    return p


def test_calibration_is_bounded_raking(spark):
    rng = np.random.default_rng(4)
    cells = {(f"s{i}", f"l{j}", f"t{k}"): int(rng.integers(1, 400)) for i in range(4) for j in range(3) for k in range(2)}
    want = {k: min(1.0, 0.4 * (0.3, 1.0, 2.5, 4.0)[int(k[0][1])] * (1.0, 0.6, 2.0)[int(k[1][1])] * (0.9, 1.3)[int(k[2][1])]) for k in cells}
    goals = [{c: sum(cells[k] * want[k] for k in cells if k[kind] == c) for c in {k[kind] for k in cells}} for kind in range(3)]
    raked = spark.createDataFrame([(*k, n, 1.0) for k, n in cells.items()], "source string, lang string, topic string, tokens long, weight double")
    tables = {name: spark.createDataFrame(list(goals[kind].items()), f"{name} string, goal double") for kind, name in enumerate(mixing.KINDS)}
    expected = brute(cells, goals)
    got = {tuple(r[k] for k in mixing.KINDS): r["probability"] for r in mixing.calibrate(raked, tables).collect()}
    for k in cells:
        assert got[k] == pytest.approx(expected[k], abs=1e-4)
    # The same rounds on a table, stopped early.
    start = sum(goals[0].values()) / sum(cells.values())
    frame = pd.DataFrame([(*k, n, start, *(goals[kind][k[kind]] for kind in range(3))) for k, n in cells.items()],
                         columns=[*mixing.KINDS, "tokens", "weight", *(f"{k}_goal" for k in mixing.KINDS)])
    few = dict(zip(cells, mixing._calibrate_arrays(frame, 3)[0]))
    with pytest.warns(UserWarning, match="off by"):
        table = mixing.calibrate(raked, tables, 3, 0).collect()
    for r in table:
        assert r["probability"] == pytest.approx(few[tuple(r[k] for k in mixing.KINDS)])


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 12, 30, 45, 60])
def test_small_tables(spark, count):
    docs = spark.read.parquet(DOCUMENTS).orderBy("doc_id").limit(count)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = mixing.mix(docs).collect()
    assert len(rows) == count and all(0 <= r["_probability"] <= 1 and r["_weight"] >= 0 for r in rows)


def test_contradicting_targets_warn_and_columns_may_clash(spark):
    # Topic and language say the same, their targets do not.
    rows = [(i, "licence " * 9 if i % 10 == 0 else "plain words here", "xx" if i % 10 == 0 else "en", "s", i, i, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _source long, _Weight long, row long")
    mixed = mixing.mix(docs)
    assert mixed.count() == 200 and set(mixed.columns) == {"doc_id", "text", "lang", "source", "row", "_source", "_lang", "_topic", "_weight",
                                                           "_probability", "_kept"}
    assert mixing.sample(docs).columns == docs.columns
    none = docs.withColumn("text", F.lit(" "))
    assert {r["_probability"] for r in mixing.mix(none).collect()} == {mixing.BUDGET}
    given = mixing.mix(docs, topic=F.when(F.col("doc_id") < 50, F.lit("early")))
    assert {r["_topic"] for r in given.select("_topic").distinct().collect()} == {"early", mixing.NONE}
