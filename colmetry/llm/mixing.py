"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Documents fall into cells (source, language, topic). The weight of a cell is a product of a source, a language and a topic factor;
rounds of raking set one kind of factor after the other until the weighted tokens meet the target shares of sources, languages and
topics within ``TOLERANCE``; where targets contradict each other, a warning tells by how much they are missed after ``ROUNDS``.

Documents are drawn at most once, so a weight is no probability yet. ``calibrate`` rakes again with the bound in the loop: a cell's
probability is its weight times three more factors, cut at 1, and the factors are set until the *expected* tokens of every source,
language and topic are its target share of ``budget`` of all tokens. A category that holds fewer tokens than that is drawn whole, and the
others of its kind share what it cannot give in proportion to their targets; ``shares`` tells asked, feasible and expected shares.

Every source, language and topic has its own target and factor, however many there are: targets and factors are columns of the table of
cells, and a round is a few aggregates over it. Up to ``ON_DRIVER`` cells, the same rounds are run on arrays.

Defined cases: nulls in source, language and topic are a category of their own; null text has no tokens; a corpus without tokens has
weight 1 and probability ``budget``, and so has a document without tokens; a target of 0 gives weight and probability 0; rows with one
id share one draw; an empty table gives no rows; other columns are ignored, and come back as they are from ``sample``.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmetry.llm.texts import delete_staged, plain, stage, words

ROUNDS, TOLERANCE, ON_DRIVER = 1000, 1e-6, 100_000
BUDGET, POWER = 0.5, 0.5
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A plain rule: legal notices, contacts and links, tables, else prose."""
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("licen")) | F.contains(low, F.lit("rights reserved")), "legal")
        .when(F.contains(text, F.lit("@")) | F.contains(low, F.lit("http")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table").otherwise("prose")
    )


def _keys(documents: DataFrame, topic: Column | None) -> DataFrame:
    """Cell of every row, the row itself as one column, so that no name can clash."""
    return documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.size(words(plain("text"))).cast("long").alias("tokens"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(topic if topic is not None else topic_of(plain("text")), F.lit(NONE)).alias("topic"))


def _flattened(cells: DataFrame, key: str, power: float) -> DataFrame:
    """Targets of all categories (columns ``key``, share): token shares to a power, up to a constant factor."""
    return cells.groupBy(key).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))


def _rake_arrays(cells: pd.DataFrame, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of cells, and by how much a target was missed before the last round."""
    codes = {key: pd.factorize(cells[key])[0] for key in ("source", "lang", "topic")}
    goals, tokens = {}, cells["tokens"].to_numpy(np.float64)
    for key, code in codes.items():
        share = np.zeros(code.max() + 1)
        share[code] = cells[f"{key}_share"]
        goals[key] = share / (share.sum() or 1.0)
    factors, moved = {key: np.ones(len(goals[key])) for key in ("lang", "topic")}, np.inf

    def weights() -> np.ndarray:
        rest = factors["lang"][codes["lang"]] * factors["topic"][codes["topic"]]
        met = np.bincount(codes["source"], tokens * rest)
        return (goals["source"] / np.where(met > 0, met, 1))[codes["source"]] * rest

    for _ in range(rounds):
        moved = 0.0
        for key, factor in factors.items():
            met = np.bincount(codes[key], tokens * weights())
            step = np.where(met > 0, goals[key] / np.where(met > 0, met, 1), 1)
            factor *= step
            factor /= factor.max() or 1.0
            moved = max(moved, float(np.abs(step - 1).max()))
        if moved < TOLERANCE:
            break
    return weights(), moved


def _rake_table(cells: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    """The same over a table of any size."""
    def weighted(cells: DataFrame) -> DataFrame:
        rest = F.col("lang_factor") * F.col("topic_factor")
        met = cells.groupBy("source").agg(F.sum(F.col("tokens") * rest).alias("met"))
        return cells.join(met, "source").withColumn(
            "weight", F.coalesce(F.col("source_share") / F.nullif("met", F.lit(0.0)), F.lit(0.0)) * rest).drop("met")

    wholes = {}
    for key in ("source", "lang", "topic"):
        wholes[key] = cells.select(key, f"{key}_share").distinct().agg(F.sum(f"{key}_share")).first()[0] or 1.0
        cells = cells.withColumn(f"{key}_share", F.col(f"{key}_share") / F.lit(wholes[key]))
    cells, moved = cells.withColumns({"lang_factor": F.lit(1.0), "topic_factor": F.lit(1.0)}), float("inf")
    for done in range(rounds):
        moved = 0.0
        for key in ("lang", "topic"):
            met = F.sum(F.col("tokens") * F.col("weight"))
            steps = stage(weighted(cells).groupBy(key).agg(F.when(met > 0, F.first(f"{key}_share") / met).otherwise(1.0).alias("step"),
                                                           F.first(f"{key}_factor").alias("was")))
            far, top = steps.agg(F.max(F.abs(F.col("step") - 1)), F.max(F.col("step") * F.col("was"))).first()
            moved, old = max(moved, far), cells
            cells = stage(cells.join(steps.select(key, "step"), key).withColumn(
                f"{key}_factor", F.col(f"{key}_factor") * F.col("step") / F.lit(top or 1.0)).drop("step"))
            delete_staged(steps)
            if done or key == "topic":
                delete_staged(old)
        if moved < TOLERANCE:
            break
    return weighted(cells), moved


def rake(cells: DataFrame, lang_targets: DataFrame, topic_targets: DataFrame, source_power: float = POWER,
         source_targets: DataFrame | None = None, rounds: int = ROUNDS, on_driver: int = ON_DRIVER) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: shares of weighted tokens meet the targets.

    Targets have the columns source, lang or topic, and share, up to a constant factor; those of what no cell has don't count, and
    categories without a target get nothing. Without ``source_targets`` these are token shares to ``source_power``.
    """
    cells = cells.where("tokens > 0")
    targets = {"source": source_targets if source_targets is not None else _flattened(cells, "source", source_power),
               "lang": lang_targets, "topic": topic_targets}
    for key, shares in targets.items():
        cells = cells.join(shares.select(key, F.col("share").cast("double").alias(f"{key}_share")), key, "left").fillna(0.0, [f"{key}_share"])
    cells = stage(cells.select("source", "lang", "topic", "tokens", "source_share", "lang_share", "topic_share"))
    own = ["source", "lang", "topic", "tokens", "weight"]
    count, *least = cells.agg(F.count("*"), *(F.max(f"{key}_share") for key in targets)).first()
    if not count or not all(least):
        return cells.withColumn("weight", F.lit(1.0)).select(own)
    if count <= on_driver:
        held = cells.orderBy("source", "lang", "topic").toPandas()
        held["weight"], moved = _rake_arrays(held, rounds)
        raked = cells.sparkSession.createDataFrame(held[own], cells.withColumn("weight", F.lit(1.0)).select(own).schema)
    else:
        raked, moved = _rake_table(cells, rounds)
    if moved >= TOLERANCE:
        warnings.warn(f"mixing: after {rounds} rounds a target is still missed by {moved:.2g} of it", stacklevel=2)
    return raked.select(own)


KINDS = ("source", "lang", "topic")


def scale_for(cells: DataFrame, budget: float) -> float:
    """The scale at which expected tokens are ``budget`` of all: the range is cut into 64 steps four times, one aggregate each."""
    positive = F.when(F.col("weight") > 0, F.col("weight"))
    total, least, most = cells.agg(F.sum("tokens"), F.min(positive), F.max(positive)).first()
    if not total or least is None:
        return budget
    low, high = budget / most * 1e-3, 1 / least
    for _ in range(4):
        steps = [low * (high / low) ** (k / 63) for k in range(64)]
        met = cells.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.lit(s))) for s in steps)).first()
        k = next((k for k, m in enumerate(met) if m >= budget * total), 63)
        low, high = steps[max(0, k - 1)], steps[k]
    return high


def feasible(cells: DataFrame, kind: str, shares: DataFrame, budget: float) -> DataFrame:
    """(kind, tokens, asked, goal): tokens wanted of each category, its share of ``budget`` of all tokens, but never more than it has.

    What a category cannot give is shared by the others in proportion; with too few categories wanted, the goals are all they have."""
    held = cells.groupBy(kind).agg(F.sum("tokens").alias("tokens"))
    wanted = stage(held.join(shares.select(kind, F.col("share").cast("double").alias("share")), kind, "left").fillna(0.0, ["share"]).withColumn(
        "weight", F.col("share") / F.col("tokens")))
    whole = wanted.agg(F.sum("share")).first()[0] or 1.0
    scale = scale_for(wanted, budget)
    return wanted.select(kind, "tokens", (F.col("share") / F.lit(whole)).alias("asked"),
                         (F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.lit(scale))).alias("goal"))


def _calibrate_arrays(cells: pd.DataFrame, rounds: int) -> tuple[np.ndarray, float]:
    """Probabilities of cells, and by how much a goal is missed after the last round."""
    codes = {kind: pd.factorize(cells[kind])[0] for kind in KINDS}
    tokens, open_ = cells["tokens"].to_numpy(np.float64), cells["weight"].to_numpy(np.float64).copy()
    goals = {}
    for kind, code in codes.items():
        goals[kind] = np.zeros(code.max() + 1)
        goals[kind][code] = cells[f"{kind}_goal"]
    missed = np.inf
    for _ in range(rounds):
        for kind, code in codes.items():
            full, size = open_ >= 1, len(goals[kind])
            whole, rest = np.bincount(code, tokens * full, size), np.bincount(code, np.where(full, 0, tokens * open_), size)
            open_ *= _step(goals[kind], whole, rest)[code]
        expected = tokens * np.minimum(1, open_)
        missed = max(float((np.abs(np.bincount(code, expected, len(goals[kind])) - goals[kind]) / np.maximum(goals[kind], 1)).max())
                     for kind, code in codes.items())
        if missed < TOLERANCE:
            break
    return np.minimum(1, open_), missed


def _step(goal: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Factor for the open cells of categories of which ``whole`` tokens are drawn surely and ``rest`` are expected of the others."""
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where((goal > whole) & (rest > 0), (goal - whole) / rest, np.where(whole + rest > 0, goal / (whole + rest), 1.0))
    return np.clip(step, 0, 1e6)


def _calibrate_table(cells: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    """The same over a table of any size."""
    missed, cells = float("inf"), cells.withColumn("open", F.col("weight"))
    tokens, sure = F.col("tokens"), F.col("open") >= 1
    for done in range(rounds):
        for kind in KINDS:
            met = cells.groupBy(kind).agg(
                F.sum(F.when(sure, tokens).otherwise(0)).alias("whole"), F.sum(F.when(sure, 0).otherwise(tokens * F.col("open"))).alias("rest"))
            goal, old = F.col(f"{kind}_goal"), cells
            step = F.when((goal > F.col("whole")) & (F.col("rest") > 0), (goal - F.col("whole")) / F.nullif("rest", F.lit(0.0))).when(
                F.col("whole") + F.col("rest") > 0, goal / F.nullif(F.col("whole") + F.col("rest"), F.lit(0.0))).otherwise(1.0)
            cells = stage(cells.join(met, kind).withColumn("open", F.col("open") * F.least(step, F.lit(1e6))).drop("whole", "rest"))
            if done or kind != KINDS[0]:
                delete_staged(old)
        expected, missed = F.sum(tokens * F.least(F.lit(1.0), F.col("open"))), 0.0
        for kind in KINDS:
            goal = F.first(f"{kind}_goal")
            far = cells.groupBy(kind).agg((F.abs(expected - goal) / F.greatest(goal, F.lit(1.0))).alias("far")).agg(F.max("far")).first()[0]
            missed = max(missed, far or 0.0)
        if missed < TOLERANCE:
            break
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("open"))).drop("open"), missed


def calibrate(raked: DataFrame, goals: dict[str, DataFrame], rounds: int = ROUNDS, on_driver: int = ON_DRIVER) -> DataFrame:
    """``raked`` cells (source, lang, topic, tokens, weight) with ``probability``: the expected tokens of every category are its ``goal``
    (tables of ``feasible`` by kind). A warning tells by how much goals are missed that contradict each other."""
    cells = raked
    for kind, table in goals.items():
        cells = cells.join(table.select(kind, F.col("goal").alias(f"{kind}_goal")), kind)
    # Weights of any scale: to begin with, they expect what the goals add up to.
    total, wanted = cells.agg(F.sum(F.col("tokens") * F.col("weight")), F.sum("tokens")).first()
    own = [*raked.columns, "probability"]
    if not total:
        return raked.withColumn("probability", F.lit(0.0))
    first = goals[KINDS[0]].agg(F.sum("goal")).first()[0]
    cells = stage(cells.withColumn("weight", F.col("weight") * F.lit(first / total)))
    if cells.count() <= on_driver:
        held = cells.orderBy(*KINDS).toPandas()
        held["probability"], missed = _calibrate_arrays(held, rounds)
        found = cells.sparkSession.createDataFrame(held[own], cells.withColumn("probability", F.lit(1.0)).select(own).schema)
    else:
        found, missed = _calibrate_table(cells, rounds)
    if missed >= TOLERANCE:
        warnings.warn(f"mixing: expected tokens of a category are off by {missed:.2g} of its feasible target", stacklevel=2)
    return found.select(own)


def shares(drawn: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """(kind, category, asked, feasible, expected) shares of the expected tokens, from calibrated cells."""
    found = None
    for kind, table in goals.items():
        expected = drawn.groupBy(kind).agg(F.sum(F.col("tokens") * F.col("probability")).alias("expected"))
        whole = [frame.agg(F.sum(c)).first()[0] or 1.0 for frame, c in ((table, "goal"), (expected, "expected"))]
        part = table.join(expected, kind).select(
            F.lit(kind).alias("kind"), F.col(kind).alias("category"), "asked", (F.col("goal") / F.lit(whole[0])).alias("feasible"),
            (F.col("expected") / F.lit(whole[1])).alias("expected"))
        found = part if found is None else found.unionByName(part)
    return found


def plan(documents: DataFrame, budget: float = BUDGET, power: float = POWER, topic: Column | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Calibrated cells (source, lang, topic, tokens, weight, probability) and the goals by kind; targets are token shares to ``power``,
    which lifts small sources, languages and topics. ``topic`` names a document's topic (a plain rule by default)."""
    cells = stage(_keys(documents, topic).groupBy(*KINDS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    raked = stage(rake(cells, _flattened(cells, "lang", power), _flattened(cells, "topic", power), power))
    goals = {kind: feasible(cells, kind, _flattened(cells, kind, power), budget) for kind in KINDS}
    return stage(calibrate(raked, goals)), goals


def _drawn(documents: DataFrame, budget: float, power: float, seed: int, topic: Column | None) -> DataFrame:
    cells, _ = plan(documents, budget, power, topic)
    total, expected = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    known = cells.select(*KINDS, "probability")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row.doc_id").cast("string")), 11).cast("double") / F.lit(float(1 << 53))
    joined = _keys(documents, topic).join(known, list(KINDS), "left").withColumns({
        "weight": F.coalesce(F.col("probability") * F.lit(total / expected if expected else 1.0), F.lit(1.0)),
        "probability": F.when(F.col("tokens") > 0, F.col("probability")).otherwise(F.lit(budget))})
    return joined.withColumn("kept", draw < F.col("probability"))


def mix(documents: DataFrame, budget: float = BUDGET, power: float = POWER, seed: int = 11, topic: Column | None = None) -> DataFrame:
    """All columns of ``documents`` with ``_source``, ``_lang``, ``_topic``, ``_weight`` (the document's probability, 1 on average over
    tokens), ``_probability`` and ``_kept``; a column of ``documents`` of such a name gives way."""
    made = {f"_{name}": F.col(name) for name in (*KINDS, "weight", "probability", "kept")}
    kept = [F.col(f"row.`{c}`") for c in documents.columns if c.lower() not in made]
    return _drawn(documents, budget, power, seed, topic).select(*kept, *(c.alias(name) for name, c in made.items()))


def sample(documents: DataFrame, budget: float = BUDGET, power: float = POWER, seed: int = 11, topic: Column | None = None) -> DataFrame:
    """The documents drawn, columns as in ``documents``."""
    return _drawn(documents, budget, power, seed, topic).where("kept").select("row.*")
