"""Best-match join: for each query the best candidate that reaches a threshold.

Distinct values are scored, not rows. What a measure's score says of a pair that reaches the threshold drives the join:

- equal texts only (EXACT): an equi-join;
- a share of either side's words in common (JACCARD, WordLCS): an equi-join on each text's rarest words;
- a bound of the length ratio (Levenshtein, FUZZY): length bands, in a grid of blocks where a band is large;
- Levenshtein past SEARCH_PAIRS pairs: blocks of neighbouring texts, in which prefixes too far from all queries are left out.

Other measures meet by broadcast or in a grid. The best candidate is one aggregate: greatest score, then the earliest candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edit_distance import LEFT, distances
from ..functions.similarity import similarity, tokens
from ..functions.text import words
from ..plans.pairing import theta_join
from ..plans.scratch import written

#: Least ratio of the shorter to the longer length that a score t allows.
LENGTH_BOUNDS = {"Levenshtein": lambda t: t, "FUZZY": lambda t: t / (2 - t)}
_BAND = 1.15


def _band(length: Column) -> Column:
    """Band of a length on a logarithmic scale."""
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / math.log(_BAND)).cast("int")


#: Measures whose score is above 0 for equal texts only.
EQUAL = ("EXACT",)
#: Measures whose score t needs a share t of either side's words in common, with the words that they compare.
COMMON_WORDS = {"JACCARD": lambda c: F.array_distinct(words(c)), "WordLCS": lambda c: numbered(tokens(c))}
#: Queries and candidates of a block of a length band.
BLOCK = 512
#: Pairs from which Levenshtein searches blocks of neighbouring texts, and the texts of either side in a block.
SEARCH_PAIRS, SEARCH_BLOCK = 1 << 22, 4_096


def _banded(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs whose lengths' ratio is `least` or more. Bands that hold many queries or candidates are cut into a grid of blocks,
    each query in one of its rows and all its columns, each candidate the other way round, so that equal lengths are no hot key."""
    wide = math.ceil(-math.log(least) / math.log(_BAND)) + 1
    l = left.withColumn("_band", _band(F.length("query")))
    r = right.withColumn("_band", F.explode(F.sequence(_band(F.length("ref")) - wide, _band(F.length("ref")) + wide)))
    blocks = lambda df, name: df.groupBy("_band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    grid = F.broadcast(blocks(l, "_rows").join(blocks(r, "_columns"), "_band"))  # a row per band: the logarithm of the longest text
    number = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    l = l.join(grid, "_band").withColumn("_row", F.pmod(F.xxhash64("query"), F.col("_rows")).cast("int")).withColumn("_column", F.explode(number("_columns"))).drop("_rows", "_columns")
    r = r.join(grid, "_band").withColumn("_column", F.pmod(F.xxhash64("ref"), F.col("_columns")).cast("int")).withColumn("_row", F.explode(number("_rows"))).drop("_rows", "_columns")
    short, long = F.least(F.length("query"), F.length("ref")), F.greatest(F.length("query"), F.length("ref"))
    # few bytes, much work: the number of tasks is set, as small partitions would be joined into one
    cell, tasks = ["_band", "_row", "_column"], 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return l.repartition(tasks, *cell).join(r.repartition(tasks, *cell).hint("shuffle_hash"), cell).where(short >= F.lit(least - 1e-9) * long).drop("_band", "_row", "_column")


def _nearest(queries: list[str], refs: list[str], positions: np.ndarray, threshold: float, exclude_same: bool) -> list[tuple[str, str, int, float]]:
    """Each query's best of refs, if it reaches the threshold: greatest score, then least position, then least text."""
    queries, found = sorted(queries), []
    rank = np.empty(len(refs), dtype=np.int64)
    rank[sorted(range(len(refs)), key=lambda i: (positions[i], refs[i]))] = np.arange(len(refs))
    longer = np.array([len(r) for r in refs])
    for lo in range(0, len(queries), LEFT):
        part = queries[lo : lo + LEFT]
        size = np.array([len(q) for q in part])
        # no partner is longer than size / threshold; a distance up to this may reach the threshold
        most = np.floor((1 - threshold) * np.maximum(size, np.minimum(longer.max(), size / threshold)) + 1e-6).astype(np.int64)
        d = distances(part, refs, most)
        score = 1 - d / np.maximum(np.maximum(size[:, None], longer[None, :]), 1)
        score[d > most[:, None]] = -1.0
        if exclude_same:
            score[d == 0] = -1.0
        best = score.max(axis=1)
        first = np.where(score == best[:, None], rank[None, :], len(refs)).argmin(axis=1)
        found += [(part[i], refs[first[i]], int(positions[first[i]]), float(best[i])) for i in np.flatnonzero(best >= threshold)]
    return found


def _searched(left: DataFrame, right: DataFrame, n: int, m: int, threshold: float, exclude_same: bool) -> DataFrame:
    """query, ref, pos and score of each query's best candidate in each block. Both sides are cut into ranges of sorted texts,
    written once, so that a text's block is the same for all that read it; every range meets every range of the other side."""
    rows, columns = math.ceil(n / SEARCH_BLOCK), math.ceil(m / SEARCH_BLOCK)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    l = written(left.repartitionByRange(rows, "query").withColumn("_row", F.spark_partition_id())).withColumn("_column", every(columns))
    r = written(right.withColumn("pos", F.coalesce("pos", F.lit(-(1 << 63)))).repartitionByRange(columns, "ref").withColumn("_column", F.spark_partition_id())).withColumn("_row", every(rows))
    cell = ["_row", "_column"]
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(rows * columns, 4_096))

    def search(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = _nearest(list(one["query"]), list(two["ref"]), two["pos"].to_numpy(), threshold, exclude_same) if len(one) and len(two) else []
        return pd.DataFrame(found, columns=["query", "ref", "pos", "score"])

    return l.repartition(tasks, *cell).groupBy(*cell).cogroup(r.repartition(tasks, *cell).groupBy(*cell)).applyInPandas(search, "query string, ref string, pos long, score double")


def numbered(c: Column) -> Column:
    """Words with the number of their occurrence, so that a word that stands twice is two."""
    return F.transform(c, lambda w, i: F.concat_ws("\u0001", w, F.size(F.filter(F.slice(c, F.lit(1), i + 1), lambda v: v == w)).cast("string")))


def _sharing(left: DataFrame, right: DataFrame, words_of: Callable[[Column], Column], least: float) -> DataFrame:
    """Pairs that can have a share `least` of either side's words in common, each once.

    A text with n words that misses all of its n - ceil(least * n) + 1 rarest has too few left. So texts meet on these
    alone, in one order of words by how many texts have them, and a word that a third of all texts have brings few together."""
    def words_in(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.explode(words_of(F.col(name))).alias("_word"))

    l, r = words_in(left, "query"), words_in(right, "ref")
    known = l.select("_word").union(r.select("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))

    def rarest(df: DataFrame, name: str) -> DataFrame:
        all_ = df.join(known, "_word").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_n", "_word"))).alias("_w"))
        size = F.size("_w")
        return all_.select(name, F.explode(F.slice("_w", F.lit(1), (size - F.ceil(size * F.lit(least) - 1e-9) + 1).cast("int"))["_word"]).alias("_word"))

    pairs = rarest(l, "query").join(rarest(r, "ref"), "_word").select("query", "ref").distinct()
    return pairs.join(right, "ref").select("query", "ref", "pos")


def candidate_pairs(left: DataFrame, right: DataFrame, strategy: Any, threshold: float) -> DataFrame:
    """Pairs (query, ref, pos) that can reach the threshold: all of them, or those that the measure's bounds leave."""
    if isinstance(strategy, str) and 0 < threshold <= 1:
        if strategy in EQUAL:
            return left.join(right, F.col("query") == F.col("ref"))
        if strategy in COMMON_WORDS:
            return _sharing(left, right, COMMON_WORDS[strategy], threshold)
        if strategy in LENGTH_BOUNDS:
            return _banded(left, right, LENGTH_BOUNDS[strategy](threshold))
    return theta_join(left, right, F.lit(True))


def best_match(left: DataFrame, right: DataFrame, strategy: Any, threshold: float, *, left_col: str = "query", right_col: str = "ref", order_col: str | None = None, exclude_same: bool = False, round_scores: bool = False, **parameters: Any) -> DataFrame:
    """query, best_match, score: one row per left row whose best score reaches the threshold.

    Ties go to the earliest candidate by order_col, or else to the smallest text. Duplicate queries each give
    a row; null texts match nothing; the threshold is compared with the unrounded score.
    """
    queries = left.select(F.col(left_col).cast("string").alias("query")).where("query IS NOT NULL")
    pos = F.col(order_col) if order_col else F.lit(0)
    refs = right.select(F.col(right_col).cast("string").alias("ref"), pos.cast("long").alias("pos")).where("ref IS NOT NULL").groupBy("ref").agg(F.min("pos").alias("pos"))
    distinct = queries.distinct()
    n, m = (distinct.count(), refs.count()) if strategy == "Levenshtein" and 0 < threshold <= 1 else (0, 0)
    if n * m > SEARCH_PAIRS:
        scored = _searched(distinct, refs, n, m, float(threshold), exclude_same)
    else:
        pairs = candidate_pairs(distinct, refs, strategy, threshold)
        if exclude_same:
            pairs = pairs.where("query <> ref")
        scored = pairs.select("query", "ref", "pos", similarity(strategy, "query", "ref", threshold, **parameters)["score"].alias("score")).where(F.col("score") >= F.lit(float(threshold)))
    top = scored.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "ref")).alias("m"))
    score = -F.col("m.s") + F.lit(0.0)
    best = top.select("query", F.col("m.ref").alias("best_match"), (F.bround(score, 4) if round_scores else score).alias("score"))
    return queries.join(best, "query")


def score_band(score: Column, threshold: float) -> Column:
    """high from 0.8, medium from the threshold, else low."""
    return F.when(score >= 0.8, "high").when(score >= threshold, "medium").otherwise("low")
