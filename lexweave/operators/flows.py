"""Clean-and-match flows: one (ac, raw) pair to 0..n candidates, as arrays built once and exploded.

Steps are named cleaners, matchers are named measures with a standard. A flow is unrolled on the driver into
the states it passes through; each state is cleaned text plus the phases so far. Columns of a step are
materialised one projection after another, so an expression never holds a chain twice.
"""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import Step, chain
from ..functions.similarity import MEASURES, similarity


class Controller(Enum):
    """When a pair's flow stops. Names and numbers."""

    AllMatch = 1  # never
    MatchBreak = 2  # after the first candidate
    ExactMatchBreak = 3  # after the first candidate of an exact measure
    FuzzyMatchBreak = 4  # after the first candidate of any other measure
    ExactMetBreak = 5  # after the first exact measure, whatever it finds
    FuzzyMetBreak = 6  # after the first other measure, whatever it finds


Matcher = tuple[str, float] | tuple[str, float, dict[str, Any]]


def _label(kind: str, step: Any) -> str:
    name = step if isinstance(step, str) else step[0] if isinstance(step, tuple) else step.__name__
    return f"[{kind}]{name}" if kind else name


class _Unrolled:
    """The states of a flow: adds cleaned columns to the frame and collects one test per matcher."""

    def __init__(self, df: DataFrame, ac: str, raw: str):
        self.df = df.withColumns({"_ac0": F.col(ac), "_raw0": F.col(raw)})
        self.ac, self.raw, self.n = "_ac0", "_raw0", 0
        self.phases: list[str] = []
        self.tests: list = []
        self.exact: list[bool] = []  # whether each test is by an exact measure

    def clean(self, side: str, step: Step, prefix: bool = True) -> None:
        self.n += 1
        name = f"_{side}{self.n}"
        self.df = self.df.withColumn(name, chain([step], getattr(self, side)))
        setattr(self, side, name)
        self.phases.append(_label({"ac": "acm", "raw": "tcm"}[side] if prefix else "", step))

    def match(self, matcher: Matcher, *, prefix: bool = True, keep_score: bool = True) -> None:
        name, standard, *more = matcher
        self.phases.append(_label("mm" if prefix else "", name))
        self.exact.append(name in MEASURES and MEASURES[name].exact)
        r = similarity(name, self.ac, self.raw, standard, **(more[0] if more else {}))
        self.tests.append(F.struct(F.lit(len(self.tests)).alias("seq"), r["success"].alias("success"), (r["score"] if keep_score else F.lit(0.0)).alias("matching_score"), F.col(self.ac).alias("pac"), F.col(self.raw).alias("praw"), F.array(*map(F.lit, self.phases)).alias("phases")))

    def candidates(self, ac: str, raw: str, controller: Controller) -> DataFrame:
        if not self.tests:
            return self.df.where(F.lit(False)).select(F.col(ac).alias("ac_text"), F.col(raw).alias("raw_text"), F.lit(0).alias("seq"), F.lit(0.0).alias("matching_score"), F.lit("").alias("pac"), F.lit("").alias("praw"), F.array(F.lit("")).alias("phases"))
        tests, wanted = self.tests, "Exact" in controller.name
        if controller in (Controller.ExactMetBreak, Controller.FuzzyMetBreak) and wanted in self.exact:
            tests = tests[: self.exact.index(wanted) + 1]
        passed = F.filter(F.array(*tests), lambda t: t["success"])
        if controller in (Controller.MatchBreak, Controller.ExactMatchBreak, Controller.FuzzyMatchBreak):
            ends = [k for k, x in enumerate(self.exact) if controller == Controller.MatchBreak or x == wanted]
            last = F.array_min(F.transform(F.filter(passed, lambda t: t["seq"].isin(ends)), lambda t: t["seq"]))
            passed = F.filter(passed, lambda t: last.isNull() | (t["seq"] <= last))
        return self.df.select(F.col(ac).alias("ac_text"), F.col(raw).alias("raw_text"), F.explode(passed).alias("_c")).select("ac_text", "raw_text", "_c.seq", "_c.matching_score", "_c.pac", "_c.praw", "_c.phases")


def run_flow(df: DataFrame, flow: int, *, ac: str = "ac", raw: str = "raw", raw_steps: Iterable[Step] = (), ac_steps: Iterable[Step] = (), matchers: Iterable[Matcher] = (), operations: Iterable[tuple[str, Any]] = (), controller: Controller = Controller.AllMatch, break_first: bool = False, keep_score: bool = True) -> DataFrame:
    """ac_text, raw_text, seq, matching_score, pac, praw, phases.

    1 cleans all, then matches; 2 matches after each raw step; 3 cleans ac first, then as 2; 4 runs all raw
    steps for each ac step (the raw text carries over); 5 takes operations (acm|tcm, step) and matches after each;
    6 takes operations (acm|tcm|mm, step or matcher), with plain phase names. The controller says when a pair's flow stops;
    break_first is short for MatchBreak.
    """
    u, raw_steps, ac_steps, matchers = _Unrolled(df, ac, raw), list(raw_steps), list(ac_steps), list(matchers)

    def all_matchers() -> None:
        for m in matchers:
            u.match(m)

    if flow == 1:
        for s in raw_steps:
            u.clean("raw", s)
        all_matchers()
    elif flow in (2, 3):
        for s in ac_steps if flow == 3 else ():
            u.clean("ac", s)
        for s in raw_steps:
            u.clean("raw", s)
            all_matchers()
    elif flow == 4:
        for a in ac_steps:
            u.clean("ac", a)
            for s in raw_steps:
                u.clean("raw", s)
                all_matchers()
    elif flow == 5:
        for kind, s in operations:
            u.clean({"acm": "ac", "tcm": "raw"}[kind], s)
            all_matchers()
    elif flow == 6:
        for kind, s in operations:
            if kind == "mm":
                u.match(s, prefix=False, keep_score=keep_score)
            else:
                u.clean({"acm": "ac", "tcm": "raw"}[kind], s, prefix=False)
    else:
        raise ValueError("flows are 1 to 6")
    return u.candidates(ac, raw, Controller.MatchBreak if break_first else controller)


NOTHING = "<|NOTHING-MATCHED|>"


def result_table(candidates: DataFrame, raws: DataFrame | None = None, *, raw_col: str = "raw_text") -> DataFrame:
    """raw_text and the sorted set of its ac texts; with raws, those without a candidate are listed as nothing matched."""
    found = candidates.groupBy("raw_text").agg(F.array_sort(F.collect_set("ac_text")).alias("ac_texts"))
    if raws is None:
        return found
    every = raws.select(F.col(raw_col).alias("raw_text")).distinct()
    return every.join(found, "raw_text", "left").select("raw_text", F.coalesce("ac_texts", F.array(F.lit(NOTHING))).alias("ac_texts"))


def with_serials(table: DataFrame, serials: DataFrame, *, text_col: str, serial_col: str) -> DataFrame:
    """Adds the serial of each ac text, Unknown where there is none; the order of ac_texts stays."""
    one = table.select("raw_text", F.posexplode("ac_texts").alias("p", "t"))
    known = serials.groupBy(F.col(text_col).alias("t")).agg(F.min(F.col(serial_col).cast("string")).alias("s"))
    looked = one.join(known, "t", "left").groupBy("raw_text").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("s", F.lit("Unknown")).alias("s")))).alias("x"))
    return table.join(looked, "raw_text", "left").select("raw_text", "ac_texts", F.coalesce(F.col("x.s"), F.array().cast("array<string>")).alias("serials"))


def padded(column, start: str = "|<START>|", end: str = "|<END>|"):
    """Marks a text's edges for display."""
    return F.concat(F.lit(start), column, F.lit(end))


def match_all(acs: DataFrame, raws: DataFrame, *, ac: str = "ac", raw: str = "raw", unmatched: bool = True, **steps: Any) -> DataFrame:
    """Flow 4 over all pairs, the best candidate per pair and then per raw text, as a result table."""
    from ..plans.pairing import theta_join

    pairs = theta_join(raws.select(F.col(raw).alias("raw")), acs.select(F.col(ac).alias("ac")), F.lit(True))
    found = run_flow(pairs, 4, **steps)
    place = F.row_number().over(Window.partitionBy("raw_text").orderBy(F.desc("matching_score"), "ac_text"))
    best = found.withColumn("_place", place).where("_place = 1")
    return result_table(best, raws.select(F.col(raw).alias("raw_text")) if unmatched else None)
