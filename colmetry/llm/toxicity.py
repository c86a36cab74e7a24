"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts each have a byte n-gram model of their words, fitted on at most ``PER_CLASS`` labelled documents per class (a
documented bound). Orders up to ``SHARED`` are counted over both classes, so rare expressions fall back to the same counts and tell
nothing. For every stretch of ``STRETCHES`` words the two log-likelihoods are compared per byte; a document is described by its greatest
stretch of each length and by its whole text, and a logistic curve over these, fitted on labelled documents that the models have not
seen (same bound), gives the score.

Defined cases: null text is empty, and texts without a word score what the curve says of no evidence; equal rows score alike; labels of
one document on several rows count as the greatest, null labels not at all; without labels of both classes every score is 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmetry.llm.char_ngrams import ByteModel, Memo, class_words, draw, drawn_texts, labels_of, split_parts
from colmetry.llm.texts import fold, plain, stage

FOLDS, HELD_OUT = 3, 1
PER_CLASS, ORDER, SHARED, LEAST = 3000, 6, 2, 2
STRETCHES = (1, 3, 10, 40)
TOXIC_FROM = 0.7


def features(ratio: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Greatest per-byte log-likelihood ratio over stretches of words, its second greatest by single word, and that of the whole."""
    if not len(ratio):
        return np.zeros(len(STRETCHES) + 3)
    total, length = np.concatenate(([0], np.cumsum(ratio))), np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for n in STRETCHES:
        n = min(n, len(ratio))
        out.append(((total[n:] - total[:-n]) / (length[n:] - length[:-n])).max())
    single = ratio / sizes
    top = np.partition(single, -2)[-2] if len(single) > 1 else 0.0
    return np.array([*out, top, total[-1] / length[-1], np.log1p((single > 0.5).sum())])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised columns: means, spreads, weights (the last one the constant)."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, spread, w


def score_documents(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                    folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per row of ``documents``: id, held_out, score (0 to 1), predicted (1 from ``TOXIC_FROM``), and the per-byte
    log-likelihood ratio of the whole text and of its most toxic word."""
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id), folds) == held_out).alias("held_out"), plain(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    # Ids and labels only: no text is shuffled.
    known = stage(rows.where(~F.col("held_out")).select("doc_id").distinct().join(marks, "doc_id").withColumn(
        "curve", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0))
    counted, judged = known.where(~F.col("curve")), known.where("curve")
    texts, classes = rows.select("doc_id", "text"), labels_of(counted)
    names, counts = class_words(texts, counted, classes, PER_CLASS)
    model = spark.sparkContext.broadcast(ByteModel(names, counts, ORDER, SHARED, LEAST) if classes == [0, 1] else None)

    def describe(batch: pd.Series, memo: Memo) -> np.ndarray:
        out = []
        for _, split in split_parts(batch, lambda t: t.lower().encode("utf-8").split()):
            for at in memo.look_up(split):
                pair = memo.rows[at]
                out.append(features(pair[:, 1] - pair[:, 0], memo.sizes[at]))
        return np.array(out).reshape(len(out), len(STRETCHES) + 3)

    curve = None
    if model.value and labels_of(judged) == [0, 1]:
        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            memo = Memo(model.value)
            for batch in batches:
                yield pd.DataFrame({"label": batch["k"], "x": list(describe(batch["text"], memo))})

        seen = drawn_texts(texts, draw(judged, [0, 1], PER_CLASS, 7)).select("k", "text").mapInPandas(
            measure, "label int, x array<double>").toPandas()
        if seen["label"].nunique() == 2:
            curve = logistic(np.stack(seen["x"]), seen["label"].to_numpy(np.float64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(model.value) if curve else None
        for batch in batches:
            x = describe(batch["text"], memo) if memo else np.zeros((len(batch), len(STRETCHES) + 3))
            score = np.zeros(len(batch))
            if curve:
                mean, spread, w = curve
                score = 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / spread, np.ones(len(x))]) @ w, -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score,
                                "predicted": (score >= TOXIC_FROM).astype(np.int32), "whole_ratio": x[:, -2], "word_ratio": x[:, 0]})

    ids = documents.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(
        run, f"doc_id {ids}, held_out boolean, score double, predicted int, whole_ratio double, word_ratio double"
    ).withColumnRenamed("doc_id", doc_id)
