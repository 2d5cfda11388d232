"""Quality classifier: a sparse ensemble of rules over text statistics.

Small regression trees are boosted on the logistic loss over a bounded labelled sample; every path from a
root to a node is a conjunctive rule on the statistics. Lasso logistic regression weighs the rules and most
weights become zero. What is left is compiled into one Spark column expression, so scoring is a narrow pass
over whole texts without Python. Statistics come from the text alone: no label, language, source or id.

The sample: labelled rows outside the holdout, at most SAMPLE_ROWS, those with the smallest seeded hash of
the id; their statistics (not their texts) come to the driver. All other work covers all rows.

Cases: null and empty texts have all statistics 0 and get the score that their rules give. Without labelled
rows, or with one class only, the score is the (smoothed) share of good labels everywhere. Repeated labels of
an id count as their minimum; of rows that repeat an id one is learned from. Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import SHAPE, with_base, with_shape

#: Bound of the labelled sample that is fitted.
SAMPLE_ROWS = 20_000
SEED = 977
TREES, DEPTH, BINS, RATE, LEAST = 24, 3, 48, 0.3, 20


@dataclass(frozen=True)
class Rule:
    """All (statistic, above, cut): value > cut if above, else value <= cut."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return reduce(np.logical_and, ((x[:, names.index(f)] > cut) == above for f, above, cut in self.terms))

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(f) > cut) if above else (F.col(f) <= cut) for f, above, cut in self.terms))


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * rule.holds(x, names)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(binned: np.ndarray, cuts: list[np.ndarray], names: list[str], gradient: np.ndarray, hessian: np.ndarray, step: np.ndarray) -> set[Rule]:
    """Grows one tree; adds its output to step and gives the rules of its nodes."""
    rules: set[Rule] = set()

    def grow(rows: np.ndarray, terms: tuple, depth: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            for f in range(binned.shape[1]):
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                n = np.cumsum(np.bincount(binned[rows, f], minlength=size))[:-1]
                left_g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], size))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, f], hessian[rows], size))[:-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            step[rows] = -g / (h + 1) * RATE
            return
        f, k = best[1]
        cut = float(cuts[f][k])
        right = binned[rows, f] > k
        for above, part in ((False, rows[~right]), (True, rows[right])):
            path = (*terms, (names[f], above, cut))
            rules.add(Rule(tuple(sorted(set(path)))))
            grow(part, path, depth + 1)

    grow(np.arange(len(binned)), (), 0)
    return rules


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 2e-3) -> RuleModel:
    """Rules from boosted trees, weighed by lasso logistic regression (accelerated proximal gradient)."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return RuleModel(bias, ())
    cuts = []
    for f in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        upper = np.unique(x[:, f])
        at = np.searchsorted(upper, edges, "right")
        cuts.append(np.unique((edges[at < len(upper)] + upper[at[at < len(upper)]]) / 2))  # between neighbours, so no value lies on a cut
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    z, rules = np.full(len(y), bias), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        rules |= _tree(binned, cuts, names, p - y, p * (1 - p), step)
        z += step
    ordered = sorted(rules, key=lambda r: r.terms)
    held = np.stack([r.holds(x, names) for r in ordered], axis=1).astype(np.float64)
    _, first = np.unique(held, axis=1, return_index=True)  # equal columns are one rule
    ordered, held = [ordered[k] for k in sorted(first)], held[:, sorted(first)]
    spread = np.maximum(held.std(axis=0), 1e-9)
    a = (held - held.mean(axis=0)) / spread
    rate = 4 / max(1e-9, np.linalg.eigvalsh(a.T @ a / len(y))[-1])
    w = old = np.zeros(a.shape[1])
    b, t = bias, 1.0
    for _ in range(400):
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w + (t - 1) / nxt * (w - old)
        p = 1 / (1 + np.exp(-(a @ v + b)))
        old, t = w, nxt
        w = v - rate * (a.T @ (p - y)) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b -= 4 * float((p - y).mean())
    weights = w / spread
    return RuleModel(b - float((weights * held.mean(axis=0)).sum()), tuple((ordered[k], float(weights[k])) for k in np.flatnonzero(w)))


def held_out(id_column: Column, fold: int = 0, folds: int = 5) -> Column:
    """Whether the row's crc32 of its id as text falls in the fold; a null id is held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(True))


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    return with_shape(with_base(docs, text_col))


def fit_classifier(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fits on labelled rows outside the holdout."""
    marks = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("double").alias("_y"))
    chosen = marks.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")).join(F.broadcast(chosen), "_id")
    # an id that stands in many rows is one row of the sample, the one with the least statistics
    shape = with_features(texts, "_body").groupBy("_id").agg(F.min(F.struct("_y", *SHAPE)).alias("_s"))
    found = shape.select("_id", "_s.*").collect()
    if not found:
        return RuleModel(0.0, ())
    table = np.array(sorted(tuple(r) for r in found), np.float64)
    return fit_rules(table[:, 2:], table[:, 1], SHAPE)


def score_documents(docs: DataFrame, model: RuleModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = with_features(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), "_body")
    scored = rows.select("_id", model.column().alias("score"))
    return scored.select(F.col("_id").alias("doc_id"), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: RuleModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without those that the model rejects; columns as they were."""
    rows = with_features(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_body")), "_body")
    # a filter would be pushed below the statistics and repeat them for each rule; a generator stays where it is
    kept = F.when(model.column() >= threshold, F.array("_row")).otherwise(F.slice(F.array("_row"), 1, 0))
    return rows.select(F.explode(kept).alias("_row")).select("_row.*")
