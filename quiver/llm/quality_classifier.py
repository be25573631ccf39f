"""Quality scores learned from preference pairs (Bradley and Terry, 1952)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import text_of, word_array, word_count

#: At most so many labelled rows train the model, those with the smallest hash of doc_id.
TRAIN_ROWS = 8000
#: Opponents that every training row meets.
OPPONENTS = 16
RIDGE = 1e-3


def _share(text: Column, kept: str) -> Column:
    """Characters of a class as a share of all characters."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")) / F.greatest(F.length(text), F.lit(1))


def features(text: Column) -> dict[str, Column]:
    """Numbers that the score is a weighted sum of; all are 0 for an empty text."""
    words = F.greatest(word_count(text), F.lit(1))
    lines = F.split(text, "\n")
    log_share = lambda c: F.log1p(50 * c)
    return {
        "symbols": log_share(_share(text, "#*$%&<>")),
        "pipes": log_share(_share(text, "|")),
        "capitals": log_share(_share(text, r"\p{Lu}")),
        "shouts": log_share(_share(text, "!?")),
        "digits": log_share(_share(text, "0-9")),
        "stops": log_share(_share(text, ".,;:")),
        "repeated_words": 1 - F.greatest(F.size(F.array_distinct(word_array(text))), F.lit(1)) / words,
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "word_length": F.log1p(F.length(text) / words) * (F.length(text) > 0).cast("int"),
        "words": F.log1p(word_count(text)),
    }


NAMES = ["symbols", "pipes", "capitals", "shouts", "digits", "stops", "repeated_words", "repeated_lines", "word_length", "words"]


@dataclass
class PairwiseModel:
    """Weights on standardised features; a document of score ``cut`` wins half of its comparisons with the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, columns: list[Column]) -> Column:
        total = F.lit(-float(self.cut))
        for column, m, s, w in zip(columns, self.mean, self.scale, self.weights, strict=True):
            total = total + (column - F.lit(float(m))) * F.lit(float(w / s))
        return 1 / (1 + F.exp(-total))


def fit_pairs(x: np.ndarray, label: np.ndarray) -> PairwiseModel | None:
    """Fit by logistic loss on feature differences of (better, worse) pairs, then cut at the score quantile that errs least.

    None unless both labels occur. Newton steps on a ridge-penalised loss: the optimum is unique, reruns agree.
    """
    good, bad = x[label == 1], x[label == 0]
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(7)
    i = np.concatenate([np.repeat(np.arange(len(good)), OPPONENTS), rng.integers(0, len(good), len(bad) * OPPONENTS)])
    j = np.concatenate([rng.integers(0, len(bad), len(good) * OPPONENTS), np.repeat(np.arange(len(bad)), OPPONENTS)])
    d = (good[i] - bad[j]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w)), d.T @ (1 - p) / len(d) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = (x - mean) / scale @ w
    order = np.argsort(s, kind="stable")
    s, y = s[order], label[order]
    # errors if the lowest k scores are rejected
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([[(y == 0).sum()], (y == 0).sum() - np.cumsum(y == 0)])
    best = np.flatnonzero(errors == errors.min())
    edge = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    width = np.concatenate([[0], s[1:] - s[:-1], [0]])
    return PairwiseModel(mean, scale, w, float(edge[best[np.argmax(width[best])]]))


def _is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> PairwiseModel | None:
    """Learn from labelled documents outside the held-out third; at most TRAIN_ROWS rows reach the driver."""
    known = (
        labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~_is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    )
    named = features(text_of())
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", *(c.cast("double").alias(n) for n, c in named.items())).orderBy(F.xxhash64("doc_id"), "doc_id", *NAMES).limit(2 * TRAIN_ROWS).collect()
    x = np.array([[r[n] for n in NAMES] for r in rows], float).reshape(-1, len(NAMES))
    return fit_pairs(x, np.array([r["label"] for r in rows], int))


def score_quality(docs: DataFrame, labels: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Score every document from its whole text with a model learned from pairs of labelled documents.

    Labels of documents with crc32(doc_id) mod 3 = 1 are never read. Null or empty text: all features are 0 and the
    score follows from that. Null doc_id: scored, not held out. Repeated rows: the same score. Labels that contradict
    each other count as bad. No usable label, or only
    one class: score 0.5. Empty table: no rows. ``extra`` columns of the documents are passed on. Returns doc_id,
    held_out, score, predicted.
    """
    model = train(docs, labels)
    score = F.lit(0.5) if model is None else model.score([c.cast("double") for c in features(text_of()).values()])
    return docs.select(F.col("doc_id"), _is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), *(F.col(c).alias(f"_{c}") for c in extra or [])).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
