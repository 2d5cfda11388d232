"""Candidate selection: sixteen modes over the candidates of a session (rows of one partition key, in order of seq)."""

from __future__ import annotations

from collections.abc import Callable
from enum import IntEnum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Names and numbers of the modes.
class Mode(IntEnum):
    """Selection modes; the upper byte is the category."""

    ORIGINAL_RESULT = 0x0000
    BestScoreMatcher = 0x0101
    AllBestScoreMatchers = 0x0102
    All97ScoreMatchers = 0x0103
    AllAboveZScoreMatchers = 0x0104
    Top3ScoreMatchers = 0x0105
    GreatestAmountMatcher = 0x0201
    AllGreatestAmountMatchers = 0x0202
    AllMoreThanTwoMatchers = 0x0203
    AllMoreThanNMatchers = 0x0204
    DeduplicateByBestScore = 0x0301
    DeduplicateByFirstMatch = 0x0302
    DeduplicateByLastMatch = 0x0303
    DeduplicateByMostPhases = 0x0304
    MostFrequentInOverZScore = 0x0401
    BestScoreInFrequentGroup = 0x0402


CATEGORIES = {0x00: "original", 0x01: "score", 0x02: "frequency", 0x03: "deduplication", 0x04: "combination"}


def category(mode: Mode) -> str:
    return CATEGORIES[mode >> 8]


def modes_of(name: str) -> list[Mode]:
    return [m for m in Mode if category(m) == name]


def select_candidates(df: DataFrame, mode: Mode | int, *, session: list[str], ac: str = "ac_text", raw: str = "raw_text", score: str = "matching_score", seq: str = "seq", phases: str = "phases", n: int = 2, z: float | None = None) -> DataFrame:
    """Rows of df that a mode keeps in each session. Scores and z are on one scale, whichever the caller uses. A df that is
    partitioned by session (plans.pairing.spread) is not shuffled again."""
    s = Window.partitionBy(*session)
    per_ac = Window.partitionBy(*session, ac)

    def first(window, *order) -> DataFrame:
        return df.withColumn("_k", F.row_number().over(window.orderBy(*order))).where("_k = 1").drop("_k")

    def counted(d: DataFrame) -> DataFrame:
        return d.withColumn("_n", F.count(F.lit(1)).over(per_ac))

    def most(d: DataFrame) -> DataFrame:
        return counted(d).withColumn("_m", F.max("_n").over(s)).where("_n = _m").drop("_n", "_m")

    def greatest(d: DataFrame) -> DataFrame:
        # the least of all over a session needs no order of its own, so the rows stay as they were sorted for the count
        own = F.struct(-F.col("_n"), ac)
        return counted(d).withColumn("_m", F.min(own).over(s)).where(own.eqNullSafe(F.col("_m"))).drop("_m", "_n")

    def best(d: DataFrame) -> DataFrame:
        return d.withColumn("_m", F.max(score).over(s)).where(F.col(score) == F.col("_m")).drop("_m")

    table: dict[Mode, Callable[[], DataFrame]] = {
        Mode.ORIGINAL_RESULT: lambda: df,
        Mode.BestScoreMatcher: lambda: first(s, F.desc(score), ac, raw, seq),
        Mode.AllBestScoreMatchers: lambda: best(df),
        Mode.All97ScoreMatchers: lambda: df.where(F.col(score) >= 97),
        Mode.AllAboveZScoreMatchers: lambda: df.where(F.col(score) >= (95 if z is None else z)),
        Mode.Top3ScoreMatchers: lambda: df.withColumn("_k", F.row_number().over(s.orderBy(F.desc(score), seq))).where("_k <= 3").drop("_k"),
        Mode.GreatestAmountMatcher: lambda: greatest(df),
        Mode.AllGreatestAmountMatchers: lambda: most(df),
        Mode.AllMoreThanTwoMatchers: lambda: counted(df).where("_n >= 2").drop("_n"),
        Mode.AllMoreThanNMatchers: lambda: counted(df).where(F.col("_n") >= n).drop("_n"),
        Mode.DeduplicateByBestScore: lambda: first(per_ac, F.desc(score), seq),
        Mode.DeduplicateByFirstMatch: lambda: first(per_ac, seq),
        Mode.DeduplicateByLastMatch: lambda: first(per_ac, F.desc(seq)),
        Mode.DeduplicateByMostPhases: lambda: first(per_ac, F.desc(F.size(phases)), seq),
        Mode.MostFrequentInOverZScore: lambda: most(df.where(F.col(score) >= (85 if z is None else z))),
        Mode.BestScoreInFrequentGroup: lambda: best(most(df)),
    }
    try:
        return table[Mode(mode)]()
    except ValueError:
        return df
