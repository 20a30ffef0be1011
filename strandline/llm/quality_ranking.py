"""Quality classifier learnt from preference pairs (Bradley-Terry).

Pairs of a good and a poor document say that the first is preferred. The probability of that is the logistic function
of the difference of their scores; with scores linear in document statistics, the loss is a logistic regression on
feature differences. A document's score is then cut at the quantile of training scores that separates the labels best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fold, ids_and_bytes, keep_rows, map_texts
from strandline.llm.labelled import MAX_LABELLED, training_sample
from strandline.llm.textstats import FEATURES, statistics

PAIRS = 200_000
RIDGE = 1e-3
THRESHOLD = 0.3
#: Rows of the regression that are laid out at a time.
ROWS = 1 << 14


@dataclass(frozen=True)
class Ranking:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    steepness: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, and THRESHOLD at the cut."""
        z = self.steepness * (design(x, self.centre, self.scale) @ self.weights - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics and their distances from the usual value: too much and too little can both be poor."""
    z = np.clip((x - centre) / scale, -8, 8)
    return np.hstack([z, np.abs(z)])


@dataclass(frozen=True)
class _Differences:
    """Rows of ``z`` less other rows of it, made where they are asked for: the driver never holds all of them."""

    z: np.ndarray
    plus: np.ndarray
    minus: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.plus), self.z.shape[1]

    def __getitem__(self, rows: slice) -> np.ndarray:
        return self.z[self.plus[rows]] - self.z[self.minus[rows]]


def _logistic(d: np.ndarray | _Differences, y: np.ndarray, steps: int = 30) -> np.ndarray:
    n, k = d.shape
    w = np.zeros(k)
    for _ in range(steps):
        gradient, curvature = np.zeros(k), np.zeros((k, k))
        for at in range(0, n, ROWS):
            some = d[at : at + ROWS]
            p = 1 / (1 + np.exp(-np.clip(some @ w, -500, 500)))
            gradient += some.T @ (p - y[at : at + ROWS])
            curvature += (some * (p * (1 - p))[:, None]).T @ some
        step = np.linalg.solve(curvature / n + RIDGE * np.eye(k), gradient / n + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Fit on features and 0/1 labels; without both labels every score is the share of label 1, or THRESHOLD if none is given."""
    k = x.shape[1]
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        share = min(max(float(y.mean()) if len(y) else THRESHOLD, 0.01), 0.99)
        cut = np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(share / (1 - share))
        return Ranking(np.zeros(k), np.ones(k), np.zeros(2 * k), cut, 1.0)
    centre = np.median(x[good], axis=0)
    scale = np.maximum(x[good].std(axis=0), 1e-3)
    z = design(x, centre, scale)
    draw = np.random.default_rng(seed)
    difference = _Differences(z, draw.choice(good, pairs), draw.choice(poor, pairs))
    weights = _logistic(difference, np.ones(pairs))
    value = z @ weights
    cuts = np.unique(np.quantile(value, np.linspace(0.005, 0.995, 199)))
    right = [((value >= c) == (y == 1)).mean() for c in cuts]
    cut = float(cuts[int(np.argmax(right))])
    steepness = float(np.clip(_logistic((value - cut)[:, None], (y == 1).astype(float))[0], 1e-3, 50))
    return Ranking(centre, scale, weights, cut, steepness)


def _scores(texts: list, ranking: Ranking) -> np.ndarray:
    return ranking.score(np.array([statistics(t)[1] for t in texts], dtype=float).reshape(len(texts), len(FEATURES)))


def score_documents(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """One row per document: doc_id, score, predicted. Null and empty texts are scored like any other (all statistics 0)."""

    def compute(texts: list) -> list:
        score = _scores(texts, ranking)
        return [score, (score >= THRESHOLD).astype(np.int32)]

    return map_texts(ids_and_bytes(docs), "score double, predicted int", compute)


def classify_quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels are learnt from at most ``limit`` rows outside fold 0 of crc32(doc_id) mod 5. Repeated rows are scored alike,
    ties in score share a prediction, an empty table gives no rows, further columns are ignored.
    """
    ranking = fit(*training_sample(docs, labels, limit=limit))
    scored = score_documents(docs, ranking)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns, in one pass."""
    return keep_rows(docs, lambda texts: _scores([None if t is None else t.encode() for t in texts], ranking) >= THRESHOLD)
