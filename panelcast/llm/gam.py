"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting goes round the features in turn; each step fits a
shallow tree on the bins of one feature to the current gradient and adds it to that feature's lookup
table. Then the pairs of features whose joint table explains most of what is left are boosted in the
same way on a coarser grid. A score is the sigmoid of one table entry per feature and pair, so
scoring is a handful of vectorised lookups and additions.

The model is fitted on at most `max_rows` labelled rows, those with the smallest hashes of their id
(documented bound: 50,000); everything is scored. Features are the measurements of the rule ledger over whole texts.

Defined results: null and empty texts have features like any other (all zero but none missing) and get a
score; rows with a null label are not learnt from; repeated rows count as often as they occur; without
labelled rows, or with labels of one kind only, the score is the smoothed share of label 1; extra columns are
ignored; an empty table stays empty.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.common import smallest_hashes
from panelcast.llm.quality_rules import rule_ledger

FEATURES = ["log_words", "word_length", "symbols", "exclaims", "capitals", "marks", "repeats", "dup_lines", "line_words"]
BINS, PAIR_BINS, PAIRS = 64, 16, 6
ROUNDS, RATE, LEAVES, LEAST_HESSIAN = 120, 0.15, 4, 2.0
MAX_ROWS = 50_000


class Model(NamedTuple):
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)] if self.pairs else []
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.empty(0)


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The values of a tree with a few leaves on an ordered axis of bins, by greedy splits of greatest gain."""
    ends, g, h = [(0, len(gradient))], np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(hessian)]
    value = lambda a, b: (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(ends) < leaves:
        best = None
        for a, b in ends:
            m = np.arange(a + 1, b)
            m = m[(h[m] - h[a] >= LEAST_HESSIAN) & (h[b] - h[m] >= LEAST_HESSIAN)] if len(m) else m
            if len(m):
                gains = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(np.argmax(gains))
                if gains[k] > 1e-9 and (best is None or gains[k] > best[0]):
                    best = (gains[k], a, int(m[k]), b)
        if best is None:
            break
        _, a, m, b = best
        ends.remove((a, b))
        ends += [(a, m), (m, b)]
    out = np.empty(len(gradient))
    for a, b in ends:
        out[a:b] = value(a, b)
    return out


def quarter_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a grid into four rectangles by one cut of each axis; its values and gain."""
    g, h = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (gradient, hessian))
    low, cross = slice(1, -1), (slice(1, -1), slice(1, -1))
    parts = []
    for t in (g, h):
        corner, left, top, whole = t[cross], t[low, -1:], t[-1:, low], t[-1, -1]
        parts.append(np.stack([corner, left - corner, top - corner, whole - left - top + corner]))
    gains = np.where((parts[1] >= LEAST_HESSIAN).all(0), (parts[0] ** 2 / (parts[1] + 1.0)).sum(0), -1.0)
    out = np.zeros_like(gradient)
    if not gains.size or gains.max() <= 0:
        return out, 0.0
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    v = parts[0][:, i, j] / (parts[1][:, i, j] + 1.0)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gains[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + 1.0))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), [cuts(c, BINS) for c in x.T], [], [], [cuts(c, PAIR_BINS) for c in x.T], [])
    model.tables.extend(np.zeros(len(e) + 1) for e in model.edges)
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    logit = np.full(len(y), model.intercept)

    def moments(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return np.bincount(places, y - p, n), np.bincount(places, p * (1 - p), n)

    for _ in range(ROUNDS):
        for table, places in zip(model.tables, bins):
            step = RATE * shallow_tree(*moments(places, len(table)))
            table += step
            logit += step[places]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    shape = lambda a, b: (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
    flat = lambda a, b: coarse[a] * shape(a, b)[1] + coarse[b]
    grid = lambda a, b: [m.reshape(shape(a, b)) for m in moments(flat(a, b), int(np.prod(shape(a, b))))]
    gains = sorted(((quarter_tree(*grid(a, b))[1], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs.extend((a, b) for gain, a, b in gains[:PAIRS] if gain > 0)
    model.pair_tables.extend(np.zeros(shape(a, b)) for a, b in model.pairs)
    for _ in range(ROUNDS // 4):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            step = RATE * quarter_tree(*grid(a, b))[0]
            table += step
            logit += step.ravel()[flat(a, b)]
    return model


def features(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id and the features, none of them null."""
    n, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    made: dict[str, Column] = {
        "log_words": F.log1p("n_words"), "word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n,
        "exclaims": F.col("n_exclaims") / n, "capitals": F.col("n_capitals") / chars, "marks": F.col("n_marks") / chars,
        "repeats": F.col("n_repeat_words") / n, "dup_lines": F.col("n_dup_lines") / lines, "line_words": F.log1p(F.col("n_words") / lines),
    }
    return rule_ledger(docs, text, id).select(id, *[made[f].cast("double").alias(f) for f in FEATURES])


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """labels: id and label 0 or 1. The sample is taken before any text is read."""
    marked = labels.select(F.col(id).alias("__id"), F.col(label).cast("double").alias("__y")).filter("__y IS NOT NULL AND __id IS NOT NULL")
    sample = F.broadcast(smallest_hashes(marked, "__id", max_rows).drop("__hash"))  # ids and labels, at most max_rows
    rows = docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__t")).join(sample, "__id")
    measured = features(rows.select(F.struct("__id", "__y").alias("k"), "__t"), "__t", "k").select("k.*", *FEATURES).persist()
    try:  # an id that repeats in docs stands for many rows: the bound holds for them too
        learnt = smallest_hashes(measured, ["__id", *FEATURES], max_rows).drop("__hash").toPandas()
    finally:
        measured.unpersist()
    learnt = learnt.sort_values(["__id", "__y", *FEATURES])  # the fit does not depend on the order of tasks
    return fit(learnt[FEATURES].to_numpy(), learnt["__y"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, score."""

    @F.pandas_udf("double")
    def scores(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack([c.to_numpy() for c in columns], axis=1)))

    return features(docs, text, id).select(id, scores(*FEATURES).alias("score"))
