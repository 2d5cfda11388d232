"""Quality rules with risk-controlled cutoffs, as DataFrame expressions only.

A rule rejects a document if a statistic exceeds its cutoff. The cutoffs are chosen for each stratum
(the language) from labelled holdout documents: among documents labelled good, the share that the rules
together may reject is limited to `risk`. Sets of cutoffs are tested along one sequence, each a step stricter in
one rule, and the walk stops at the first that isn't safe (fixed sequence), so neither rules nor steps need a
correction. A set counts as safe if the exact binomial (Clopper-Pearson) upper bound of its joint false rejection
rate, at level `delta` over the number of strata (Bonferroni), is within the limit; without any false rejection
and with four strata that takes 217 good labels. The sequence comes from the documents labelled bad alone, so the
good ones that test it have no part in it: it takes the steps first by which most bad documents are caught, and ends
with the last that catches any. With probability 1 - delta, no stratum loses more than `risk` of its good
documents to the rules.

Cases: strata with too few good labels to certify anything are one stratum with a bound of its own; if they have too few
together, too, they keep all that passes the base test. Null is a stratum like others. Null and empty texts have no words and fail the base test. Labels that occur twice
count once (a document is good if all its labels say so); labels without a document don't count. An empty
table or no labels gives no cutoffs. Only counts per stratum, label and combination
of exceeded cutoffs come to the driver.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textstats import ratio, with_base, with_repeats, with_shape

#: Rule: statistic and its cutoffs from mild to strict; a document is rejected above the cutoff.
RULES = {
    "symbol_ratio": [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08],
    "bang_ratio": [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08],
    "repeat_ratio": [0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "same_ratio": [0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "upper_ratio": [0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
}
RISK, DELTA = 0.02, 0.05
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def binomial_upper(failures: int, trials: int, level: float, most: float = 1.0) -> float:
    """Exact upper bound of a rate at 1 - level: the rate at which so few failures have probability level.

    Where the rate that was seen exceeds `most`, the bound does as well, and that rate stands for it."""
    if failures >= trials:
        return 1.0
    if failures and failures / trials > most:  # the bound lies above the rate that was seen
        return failures / trials

    def tail(p: float) -> float:
        """log P(X <= failures); terms fall by a ratio from the last one down, so the sum ends where they no longer count."""
        last = math.lgamma(trials + 1) - math.lgamma(failures + 1) - math.lgamma(trials - failures + 1) + failures * math.log(p) + (trials - failures) * math.log1p(-p)
        term = total = 1.0
        for k in range(failures, 0, -1):
            term *= k * (1 - p) / ((trials - k + 1) * p)
            total += term
            if term < 1e-17 * total:
                break
        return last + math.log(total)

    low, high = failures / trials, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > math.log(level) else (low, mid)
    return high


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the base counts and the rules' statistics."""
    out = with_shape(with_repeats(with_base(docs, text_col)))
    return out.withColumn("repeat_ratio", ratio(F.col("n_repeat_words"), F.col("n_words"))).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def judged(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """_id and _good: 1 for ids that are labelled good throughout, else 0."""
    return labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") == 1).cast("int").alias("_good"))


def steps(bad: dict[tuple[int, ...], int]) -> list[str]:
    """The rule that each step makes stricter. bad: counts of documents by each rule's mildest cutoff that they exceed."""
    at, left, out = dict.fromkeys(RULES, 0), dict(bad), []
    names = list(RULES)
    while left:
        gains = []
        for r, name in enumerate(names):
            for end in range(at[name] + 1, len(RULES[name]) + 1):
                if gain := sum(n for f, n in left.items() if f[r] < end):
                    gains.append((-gain / (end - at[name]), r, end))
        if not gains:
            break
        _, r, end = min(gains)
        out += [names[r]] * (end - at[names[r]])
        at[names[r]] = end
        left = {f: n for f, n in left.items() if f[r] >= end}
    rest = sorted((k, r) for r, name in enumerate(names) for k in range(at[name], len(RULES[name])))
    return out + [names[r] for _, r in rest]


def useful(order: list[str], bad: dict[tuple[int, ...], int]) -> list[str]:
    """The sequence up to the last step that catches a document labelled bad; what lies beyond would cost good ones for nothing."""
    at, left, last = dict.fromkeys(RULES, 0), set(bad), 0
    for k, rule in enumerate(order, 1):
        at[rule] += 1
        kept = {f for f in left if all(x >= a for x, a in zip(f, at.values(), strict=True))}
        last, left = (k, kept) if len(kept) < len(left) else (last, left)
    return order[:last]


def pooled(sizes: dict[str | None, int], risk: float, delta: float) -> list[list[str | None]]:
    """The strata, of which those whose good labels can't certify anything on their own are one.

    It depends on the numbers of labels alone, not on what the rules do to them."""
    least = math.log(delta / max(1, len(sizes))) / math.log1p(-risk)
    small = sorted((name for name, n in sizes.items() if n < least), key=str)
    return [[name] for name, n in sizes.items() if n >= least] + ([small] if small else [])


def safe_cutoffs(stats: DataFrame, labels: DataFrame, *, id_col: str, stratum: str, risk: float = RISK, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """Stratum to rule to its cutoff in the strictest safe set. stats: with_statistics() of the documents."""
    mildest = [F.lit(len(cuts)) - sum((F.coalesce((F.col(rule) > cut).cast("int"), F.lit(0)) for cut in cuts), F.lit(0)) for rule, cuts in RULES.items()]
    held = stats.where("NOT base_failed").join(judged(labels), F.col(id_col) == F.col("_id"))
    counts = held.groupBy(F.col(stratum).cast("string").alias("stratum"), "_good", F.array(*mildest).alias("first")).agg(F.count(F.lit(1)).alias("n")).collect()
    bad: dict[tuple[int, ...], int] = {}
    good: dict[str | None, dict[tuple[int, ...], int]] = {}
    for row in counts:
        of = good.setdefault(row["stratum"], {}) if row["_good"] else bad
        of[tuple(row["first"])] = of.get(tuple(row["first"]), 0) + row["n"]
    order, out = useful(steps(bad), bad), {}
    pools = pooled({name: sum(seen.values()) for name, seen in good.items()}, risk, delta)
    level = delta / max(1, len(pools))
    for pool in pools:
        own, at, seen, safe = {}, dict.fromkeys(RULES, 0), Counter(), {}
        for name in pool:
            out[name] = own
            seen.update(good[name])
        total = sum(seen.values())
        for rule in order:
            at[rule] += 1
            lost = sum(n for first, n in seen.items() if any(f < k for f, k in zip(first, at.values(), strict=True)))
            if lost not in safe:
                safe[lost] = binomial_upper(lost, total, level, risk) <= risk
            if not safe[lost]:
                break
            own[rule] = RULES[rule][at[rule] - 1]
    return out


def verdict(cutoffs: dict[str | None, dict[str, float]], stratum: str):
    """Column: false where the base test or a rule of the row's stratum rejects."""
    broken = F.col("base_failed")
    for name, rules in sorted(cutoffs.items(), key=str):
        here = F.col(stratum).cast("string").eqNullSafe(F.lit(name))
        for rule, cut in rules.items():
            broken = broken | (here & (F.col(rule) > cut))
    return ~broken


def rule_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """Per document: id, base counts, base_failed, kept, and the statistics that the rules read."""
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(stratum).cast("string").alias("_stratum"))
    stats = materialize(with_statistics(rows, text_col).select(F.col(id_col), "_stratum", *BASE, "base_failed", *RULES), "rule-statistics")
    cutoffs = safe_cutoffs(stats, labels, id_col=id_col, stratum="_stratum")
    return stats.select(F.col(id_col), *BASE, "base_failed", verdict(cutoffs, "_stratum").alias("kept"), *RULES)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """docs without those that fail the base test or a rule; columns as they were.

    Cases: as in the module's text; rows that repeat are judged alike. The rows are written once with their statistics, which are
    read for the cutoffs and again for the verdict.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_body"), F.col(stratum).cast("string").alias("_stratum"))
    stats = materialize(with_statistics(rows, "_body").select("_row", "_doc", "_stratum", "base_failed", *RULES), "rule-statistics")
    cutoffs = safe_cutoffs(stats.drop("_row"), labels, id_col="_doc", stratum="_stratum")
    return stats.where(verdict(cutoffs, "_stratum")).select("_row.*")
