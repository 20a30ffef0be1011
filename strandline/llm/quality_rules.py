"""Quality rules: base limits on repeated and missing text, then boosted trees over document statistics.

The trees are grown on binned statistics with logistic loss. A statistic with a monotonic constraint may only be split
so that the value falls (or rises) along it, and the bounds are handed down to both sides. All trees lie in flat numpy
arrays, and a whole batch of documents walks through all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from strandline.llm.common import ids_and_bytes, map_texts
from strandline.llm.labelled import MAX_LABELLED, training_sample
from strandline.llm.textstats import FEATURES, statistics

TREES = 60
DEPTH = 4
RATE = 0.15
BINS = 64
LEAST_ROWS = 20
SHRINK = 1.0
KEEP_AT = 0.3
#: A document never gets better by more of these.
FALLING = ("symbols_per_word", "shouts_per_word", "repeat_share", "dup_line_share")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, rule_score double, kept boolean"


@dataclass(frozen=True)
class Forest:
    """Trees side by side, ``2 ** (DEPTH + 1) - 1`` slots each: slot i has its children at 2i+1 and 2i+2; a leaf stays put."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(self.feature.shape[0])
        at = np.zeros((len(x), len(trees)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, at]] > self.limit[trees, at]
            at = np.where(self.leaf[trees, at], at, 2 * at + 1 + right)
        return 1 / (1 + np.exp(-(self.base + self.value[trees, at].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, falling: tuple = FALLING) -> Forest:
    """Without both labels no tree is grown and every document gets the share of label 1 (1 where nothing is labelled)."""
    slots = 2 ** (DEPTH + 1) - 1
    share = min(max(float(y.mean()) if len(y) else 1.0, 0.001), 0.999)
    base = float(np.log(share / (1 - share)))
    trees = TREES if len(np.unique(y)) == 2 else 1
    feature, limit, leaf, value = (np.zeros((trees, slots), dtype=t) for t in (np.int64, float, bool, float))
    leaf[:] = True
    forest = Forest(feature, limit, leaf, value, base)
    if len(np.unique(y)) < 2:
        return forest
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(k)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(k)], axis=1)
    sign = np.array([-1 if name in falling else 0 for name in FEATURES[:k]])
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        members = {0: (np.arange(len(y)), -np.inf, np.inf)}
        for slot in range(slots):
            if slot not in members:
                continue
            rows, low, high = members.pop(slot)
            best = _best_split(binned[rows], g[rows], h[rows], edges, sign, low, high) if 2 * slot + 2 < slots else None
            if best is None:
                value[t, slot] = RATE * float(np.clip(-g[rows].sum() / (h[rows].sum() + SHRINK), low, high))
                raw[rows] += value[t, slot]
                continue
            f, cut, left_value, right_value = best
            feature[t, slot], limit[t, slot], leaf[t, slot] = f, edges[f][cut], False
            goes_right = binned[rows, f] > cut
            middle = (left_value + right_value) / 2
            below, above = ((low, middle), (middle, high)) if sign[f] > 0 else ((middle, high), (low, middle)) if sign[f] < 0 else ((low, high), (low, high))
            members[2 * slot + 1] = (rows[~goes_right], *below)
            members[2 * slot + 2] = (rows[goes_right], *above)
    return forest


def _best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list, sign: np.ndarray, low: float, high: float) -> tuple | None:
    """(feature, bin, value left, value right) of the largest gain that keeps the constraints, or None."""
    best, most = None, 1e-6
    whole_g, whole_h = g.sum(), h.sum()
    parent = whole_g**2 / (whole_h + SHRINK)
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        n = len(edge) + 1
        left_g, left_h, left_n = (np.cumsum(np.bincount(binned[:, f], weights=w, minlength=n))[:-1] for w in (g, h, np.ones(len(g))))
        left, right = (np.clip(-a / (b + SHRINK), low, high) for a, b in ((left_g, left_h), (whole_g - left_g, whole_h - left_h)))
        gain = left_g**2 / (left_h + SHRINK) + (whole_g - left_g) ** 2 / (whole_h - left_h + SHRINK) - parent
        allowed = (left_n >= LEAST_ROWS) & (len(g) - left_n >= LEAST_ROWS) & (sign[f] * (right - left) >= 0)
        gain = np.where(allowed, gain, -1)
        cut = int(np.argmax(gain))
        if gain[cut] > most:
            most, best = gain[cut], (f, cut, float(left[cut]), float(right[cut]))
    return best


def apply_rules(docs: DataFrame, forest: Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, rule_score, kept.

    Null texts count as empty; fewer than MIN_WORDS words fail the base rules, so empty texts are not kept.
    """

    def compute(texts: list) -> list:
        both = [statistics(t) for t in texts]
        counts = [np.array([c[name] for c, _ in both], dtype=np.int64) for name in COUNTS]
        of = dict(zip(COUNTS, counts, strict=True))
        failed = (of["n_words"] < MIN_WORDS) | (100 * of["n_repeat_words"] > MAX_REPEAT_PERCENT * of["n_words"])
        score = forest.score(np.array([v for _, v in both], dtype=float).reshape(len(texts), len(FEATURES)))
        return [*counts, failed, score, ~failed & (score >= keep_at)]

    return map_texts(ids_and_bytes(docs), SCHEMA, compute)


def quality_rules(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Grow the trees on at most ``limit`` labelled documents and apply all rules to every document.

    Repeated rows get equal results, an empty table gives no rows, further columns are ignored.
    """
    return apply_rules(docs, fit_forest(*training_sample(docs, labels, limit=limit)))
