"""Language of a text as a mixture: expectation-maximisation over word likelihoods, the set of languages by penalised likelihood.

Each language has a Kneser-Ney byte n-gram model of its words, fitted on at most ``PER_LANGUAGE`` labelled documents (a documented
bound). The words of a document are drawn from its languages with unknown shares; EM estimates the shares from the words' n-gram
likelihoods, first over all languages, then over the growing sets of the largest ones. The set with the least
``-2 log likelihood + (size - 1) log(words)`` wins. The prediction is its largest language, the score that language's share.

Defined cases: null text, empty text and text without a letter are ``und`` with score 0; equal rows get equal answers; rows without a
language are only predicted; without any learnable row everything is ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmetry.llm.char_ngrams import ByteModel, Memo, class_words, labels_of, split_parts
from colmetry.llm.texts import fold, plain

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE, ORDER = 1500, 5
ROUNDS = 12
_LETTER = regex.compile(r"\p{L}")


def shares(likelihood: list[np.ndarray], sizes: np.ndarray, active: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for documents side by side. ``likelihood`` has an array over words for each language, ``sizes`` are the documents' words,
    ``active`` is [documents, languages]. Returns shares and log-likelihoods (up to a constant by document)."""
    starts = np.cumsum(sizes) - sizes
    pi = np.where(active, prior, 0).astype(np.float32)
    pi /= pi.sum(axis=1, keepdims=True)
    base = pi
    for done in range(ROUNDS + 1):
        joint = [p * np.repeat(pi[:, k], sizes) for k, p in enumerate(likelihood)]
        total = np.maximum(sum(joint), 1e-30)
        if done == ROUNDS:
            return pi, np.add.reduceat(np.log(total), starts, dtype=np.float64)
        weight = 1 / total
        # One word's worth of the prior steadies very short texts.
        pi = (np.stack([np.add.reduceat(j * weight, starts) for j in joint], axis=1) + base) / (sizes[:, None] + 1)


def mixture(likelihood: np.ndarray, sizes: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Shares [documents, languages] of the language set that penalised likelihood selects; every document has a word."""
    languages = likelihood.shape[1]
    columns = [np.ascontiguousarray(likelihood[:, k]) for k in range(languages)]
    every = np.ones((len(sizes), languages), bool)
    pi, most = shares(columns, sizes, every, prior)
    rank = np.argsort(np.argsort(-pi, axis=1), axis=1)
    best = (rank == 0).astype(np.float32)
    logs = np.log(np.maximum(columns, 1e-30))
    alone = np.stack([np.add.reduceat(c, np.cumsum(sizes) - sizes, dtype=np.float64) for c in logs], axis=1)
    cost = -2 * alone[np.arange(len(sizes)), rank.argmin(axis=1)]
    # No set fits better than all languages together, so most documents of one language are settled here.
    open_ = np.flatnonzero(-2 * most + np.log(sizes + 1) < cost)
    if len(open_):
        keep = np.zeros(len(sizes), bool)
        keep[open_] = True
        words = np.repeat(keep, sizes)
        columns = [c[words] for c in columns]
        for size in range(2, languages + 1):
            own, fit = shares(columns, sizes[open_], rank[open_] < size, prior)
            now = -2 * fit + (size - 1) * np.log(sizes[open_] + 1)
            better = now < cost[open_]
            best[open_[better]], cost[open_[better]] = own[better], now[better]
    return best


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS,
             held_out: int = HELD_OUT) -> DataFrame:
    """One row per row of ``documents``: id, held_out, lang_pred, score, ``shares`` (map of language to share, selected set only)."""
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id), folds) == held_out).alias("held_out"),
                            plain(text).alias("text"), F.col(lang).cast("string").alias("label"))
    learned = rows.where(~F.col("held_out")).select("doc_id", "text", "label")
    labels = labels_of(learned)
    names, counts = class_words(learned, learned, labels, PER_LANGUAGE)
    model = spark.sparkContext.broadcast(ByteModel(names, counts, ORDER, 0) if len(names) else None)
    prior = np.full(max(1, len(labels)), 1 / max(1, len(labels)), np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(model.value) if model.value else None
        for batch in batches:
            for first, split in split_parts(batch["text"], lambda t: t.lower().encode("utf-8").split() if memo and _LETTER.search(t) else []):
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                yield answer(batch.iloc[first:first + len(split)], split, sizes, memo)

    def answer(batch: pd.DataFrame, split: list, sizes: np.ndarray, memo: Memo | None) -> pd.DataFrame:
        predicted, score, found = ["und"] * len(batch), np.zeros(len(batch)), [{} for _ in split]
        full = np.flatnonzero(sizes)
        if len(full):
            at = np.concatenate(memo.look_up([split[i] for i in full]))
            logs = memo.rows[at]
            likelihood = np.exp(logs - logs.max(axis=1, keepdims=True))
            for i, own in zip(full, mixture(likelihood, sizes[full], prior)):
                k = int(own.argmax())
                predicted[i], score[i] = labels[k], min(1.0, float(own[k]))
                found[i] = {labels[j]: float(v) for j, v in enumerate(own) if v > 0}
        return pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "held_out": batch["held_out"].to_numpy(), "lang_pred": predicted,
                             "score": score, "shares": found})

    ids = documents.schema[doc_id].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInPandas(
        run, f"doc_id {ids}, held_out boolean, lang_pred string, score double, shares map<string,double>").withColumnRenamed("doc_id", doc_id)
