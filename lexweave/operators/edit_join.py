"""Equi-joins that score their pairs by Levenshtein.

A frequent key's pairs are scored cell by cell, in Arrow batches that share the rows of one distance table between texts; those
of rare keys by the built-in expression. Both give the same scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.edit_distance import distances
from ..functions.similarity import levenshtein_score
from ..plans.pairing import celled, same_keys


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Sorted distinct texts and each text's place among them."""
    distinct = sorted(set(texts))
    place = {t: i for i, t in enumerate(distinct)}
    return distinct, np.array([place[t] for t in texts], dtype=np.int64)


def _classes(texts: list[str]) -> list[np.ndarray]:
    """Places of the texts of each class of lengths, so that none is padded to more than twice its length."""
    bits = np.array([len(t).bit_length() for t in texts], dtype=np.int64)
    return [np.flatnonzero(bits == k) for k in np.unique(bits)]


def scores(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein scores of all left with all right texts."""
    out = np.empty((len(left), len(right)))
    for here in _classes(left):
        one = [left[i] for i in here]
        m = np.array([len(t) for t in one])
        for there in _classes(right):
            two = [right[j] for j in there]
            n = np.array([len(t) for t in two])
            out[np.ix_(here, there)] = 1 - distances(one, two) / np.maximum(np.maximum(m[:, None], n[None, :]), 1)
    return out


def _allowed(longest: int, least: float) -> np.ndarray:
    """For pairs whose longer text has 0 to `longest` characters, the greatest distance whose score reaches `least`."""
    n = np.arange(longest + 1)
    tried = np.maximum(np.floor((1 - least) * n).astype(np.int64)[:, None] + np.arange(2, -3, -1), 0)
    return tried[n, np.argmax(1 - tried / np.maximum(n, 1)[:, None] >= least, axis=1)]


def near_pairs(left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and scores of the pairs of texts that reach `least`; distances are compared as integers."""
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    for here in _classes(left):
        one = [left[i] for i in here]
        m = np.array([len(t) for t in one])
        for there in _classes(right):
            two = [right[j] for j in there]
            n = np.array([len(t) for t in two])
            if min(m.max(), n.max()) < (least - 1e-9) * max(m.min(), n.min()):
                continue
            # no partner is longer than m / least; a distance up to this may reach it
            most = np.floor((1 - least) * np.maximum(m, np.minimum(n.max(), m / least)) + 1e-6).astype(np.int64)
            d = distances(one, two, most)
            allowed = _allowed(max(m.max(), n.max()), least).astype(d.dtype)
            same = m.min() == m.max() and n.min() == n.max()
            i, j = np.nonzero(d <= (allowed[-1] if same else allowed[np.maximum(m[:, None], n[None, :])]))
            found.append((here[i], there[j], 1 - d[i, j] / np.maximum(np.maximum(m[i], n[j]), 1)))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _rows_of(at: np.ndarray, to: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows for pairs of texts x and y, where row i has text at[i] or to[i]; and each one's pair of texts."""
    l, r = np.argsort(at, kind="stable"), np.argsort(to, kind="stable")
    m, n = np.bincount(at), np.bincount(to)
    size = m[x] * n[y]
    pair = np.repeat(np.arange(len(x)), size)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    a, b = x[pair], y[pair]
    return l[(np.cumsum(m) - m)[a] + k // n[b]], r[(np.cumsum(n) - n)[b] + k % n[b]], pair


def keyed_scores(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], a: str, b: str, *, least: float | None = None, kept: tuple[str, ...] | None = None) -> DataFrame:
    """keyed_join with the Levenshtein score of columns a (left) and b (right; null is an empty text); with `least` (above 0,
    1 at most) of the pairs that reach it only. A cell's pairs are one Arrow batch of the columns `kept` (all by default)."""
    sides = celled(left, right, keys, "_cell", "_cell")
    native = levenshtein_score(F.coalesce(f"`{a}`", F.lit("")), F.coalesce(f"`{b}`", F.lit("")))

    def joined(l: DataFrame, r: DataFrame) -> DataFrame:
        condition = same_keys(keys)
        return l.join(r, condition if least is None else condition & (native >= F.lit(least))).select(*(F.col(f"`{c}`") for c in [*own, *other]), native.alias("score"))

    own, other = ([c for c in df.columns if kept is None or c in kept] for df in (left, right))
    if not sides:
        return joined(left, right)
    l, r = sides

    def scored(one: pa.Table, two: pa.Table) -> pa.Table:
        x, at = _numbered([t or "" for t in one[a].to_pylist()])
        y, to = _numbered([t or "" for t in two[b].to_pylist()])
        if least is None:
            found = scores(x, y)[at][:, to]
            i, j = np.indices(found.shape).reshape(2, -1)
            score = found[i, j]
        else:
            *texts, score = near_pairs(x, y, least)
            i, j, pair = _rows_of(at, to, *texts)
            score = score[pair]
        columns = [one[c].take(pa.array(i)) for c in own] + [two[c].take(pa.array(j)) for c in other]
        return pa.Table.from_arrays([*columns, pa.array(score)], names=[*own, *other, "score"])

    hot = F.col("_cell") >= 0
    schema = T.StructType([*(left.schema[c] for c in own), *(right.schema[c] for c in other), T.StructField("score", T.DoubleType())])
    frequent = l.where(hot).groupBy("_cell").cogroup(r.where(hot).groupBy("_cell")).applyInArrow(scored, schema)
    return frequent.union(joined(l.where(~hot).drop("_cell"), r.where(~hot).drop("_cell")))
