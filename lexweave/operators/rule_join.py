"""Rule-driven joins of two tables.

A rule is brought into disjunctive form; each alternative with an EXACT leaf is an equi-join with the rest as
its condition, alternatives with the same EXACT leaves share one, the results are united and made distinct. Pairs of
frequent keys are cut into cells; an alternative with a Levenshtein leaf scores them there, and tests the rest on those that reach
it. Where row ids are unique, each alternative leaves out what those before accept and rows bring their columns to their pairs,
so that no pair is shuffled. Without an EXACT leaf the pairs meet by broadcast or in blocks.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import MEASURES, levenshtein
from ..plans.pairing import keyed_join, theta_join
from ..plans.rule_tree import Constraint, Leaf, build_rule, conjunctions, holds, leaf_results
from .edit_join import keyed_scores

#: Alternatives up to which each leaves out the pairs of those before; bytes of a pair's columns that may go through Python.
APART_TERMS, PAIR_BYTES = 8, 256


def _prefixed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{side}{c}") for c in df.columns))


def _pick(side: str):
    return lambda name: F.col(f"`{side}{name}`")


def _is_key(node: Any, negated: bool) -> bool:
    return isinstance(node, Leaf) and node.algo == "EXACT" and not negated


def _is_keyed(terms: list[tuple] | None) -> bool:
    return terms is not None and all(any(_is_key(*x) for x in t) for t in terms)


def _by_keys(terms: list[tuple]) -> list[tuple[list[tuple[str, str]], list[tuple]]]:
    """Key columns and the alternatives that have these EXACT leaves."""
    out: dict[tuple, list] = {}
    for t in terms:
        out.setdefault(tuple(sorted({(f"_l_{n.df1}", f"_r_{n.df2}") for n, neg in t if _is_key(n, neg)})), []).append(t)
    return [(list(keys), found) for keys, found in out.items()]


def _rest(terms: list[tuple]) -> Column | None:
    """Alternatives without their EXACT leaves as one condition (None: no more)."""
    rests = [tuple(x for x in t if not _is_key(*x)) for t in terms]
    return _accepts(rests) if all(rests) else None


def _accepts(terms: list[tuple]) -> Column:
    return reduce(lambda a, b: a | b, (holds(t, _pick("_l_"), _pick("_r_")) for t in terms))


def _both(*conditions: Column | None) -> Column | None:
    return reduce(lambda a, b: b if a is None else a if b is None else a & b, conditions)


def _columns(terms: list[tuple]) -> tuple[set[str], set[str]]:
    """Left and right columns that alternatives read."""
    nodes = [n for t in terms for n, _ in t]
    return {f"_l_{n.df1}" for n in nodes}, {f"_r_{n.df2}" for n in nodes if not isinstance(n, Constraint)}


def _near(terms: tuple) -> Leaf | None:
    """The Levenshtein leaf that drives an alternative's join."""
    fits = (n for n, neg in terms if not neg and isinstance(n, Leaf) and MEASURES[n.algo].apply is levenshtein and not n.parameters)
    return next((n for n in fits if 0 < float(n.standard) <= 1), None)


def _is_near(l: DataFrame, r: DataFrame, terms: tuple) -> bool:
    n = _near(terms)
    return n is not None and dict(l.dtypes)[f"_l_{n.df1}"] == dict(r.dtypes)[f"_r_{n.df2}"] == "string"


def _alternatives(l: DataFrame, r: DataFrame, terms: list[tuple], carried: set[str], *, apart: bool = False) -> list[DataFrame]:
    """The pairs of the alternatives with keys, with the columns `carried` at least; `apart`: two rows are a pair of their first
    alternative only."""
    near = [t for t in terms if _is_near(l, r, t)]
    before: list[tuple] = []
    parts = []

    def new() -> Column | None:
        return ~F.coalesce(_accepts(before), F.lit(False)) if apart and before else None

    for t in near:
        leaf = _near(t)
        rest = tuple(x for x in t if x[0] is not leaf and not _is_key(*x))
        kept = carried.union(*_columns([rest, *(before if apart else ())]))
        keys = sorted({(f"_l_{n.df1}", f"_r_{n.df2}") for n, neg in t if _is_key(n, neg)})
        one, two = ({k[side] for k in keys} | {(f"_l_{leaf.df1}", f"_r_{leaf.df2}")[side]} | kept for side in (0, 1))
        sides = (df.select(*(F.col(f"`{c}`") for c in df.columns if c in names)) for df, names in ((l, one), (r, two)))
        found = keyed_scores(*sides, keys, f"_l_{leaf.df1}", f"_r_{leaf.df2}", least=float(leaf.standard), kept=tuple(kept))
        condition = _both(_accepts([rest]) if rest else None, new())
        parts.append(found if condition is None else found.where(condition))
        before.append(t)
    for keys, found in _by_keys([t for t in terms if t not in near]):
        # within the join, and in this order: of most pairs only the alternative's own condition is tested
        parts.append(keyed_join(l, r, keys, _both(_rest(found), new())))
        before += found
    return parts


def _is_native(terms: list[tuple]) -> bool:
    return all(not isinstance(n, Leaf) or MEASURES[n.algo].native for t in terms for n, _ in t)


def _unique(df: DataFrame, idx: str) -> bool:
    """Whether no row id is null or repeated."""
    if dict(df.dtypes)[idx].startswith(("array", "map", "struct", "variant")):
        return False
    n, ids = df.agg(F.count(F.lit(1)), F.count_distinct(F.col(f"`{idx}`"))).first()
    return n == ids


def _settled(df1: DataFrame, df2: DataFrame, terms: list[tuple], idx1: str, idx2: str) -> bool:
    """Whether the alternatives can be kept apart, so that their union has each pair of ids once."""
    return (len(terms) == 1 or len(terms) <= APART_TERMS and _is_native(terms)) and _unique(df1, idx1) and _unique(df2, idx2)


def rule_pairs(df1: DataFrame, df2: DataFrame, rule: Any, *, idx1: str = "idx", idx2: str = "idx") -> DataFrame:
    """df1_idx, df2_idx, final_result (true) of the pairs that a rule accepts."""
    tree = build_rule(rule)
    l, r = _prefixed(df1, "_l_"), _prefixed(df2, "_r_")
    left, right = _pick("_l_"), _pick("_r_")
    ids = (F.col(f"`_l_{idx1}`").alias("df1_idx"), F.col(f"`_r_{idx2}`").alias("df2_idx"))
    terms = conjunctions(tree)
    if not _is_keyed(terms):
        found = theta_join(l, r, tree.column(left, right)).select(*ids)
    else:
        apart = len(terms) > 1 and _settled(df1, df2, terms, idx1, idx2)
        found = reduce(DataFrame.union, (p.select(*ids) for p in _alternatives(l, r, terms, {f"_l_{idx1}", f"_r_{idx2}"}, apart=apart)))
        found = found.distinct() if len(terms) > 1 and not apart else found
    return found.withColumn("final_result", F.lit(True))


def rule_debug(df1: DataFrame, df2: DataFrame, rule: Any, *, idx1: str = "idx", idx2: str = "idx") -> DataFrame:
    """All pairs of two small tables with each node's result."""
    tree = build_rule(rule)
    l, r = _prefixed(df1, "_l_"), _prefixed(df2, "_r_")
    pairs = theta_join(l, r, F.lit(True))
    left, right = _pick("_l_"), _pick("_r_")
    return pairs.select(F.col(f"`_l_{idx1}`").alias("df1_idx"), F.col(f"`_r_{idx2}`").alias("df2_idx"), tree.column(left, right).alias("final_result"), leaf_results(tree, left, right).alias("debug_info"))


def constraint_pairs(df1: DataFrame, trees: dict[str, Any], *, text_col: str, idx1: str = "idx") -> DataFrame:
    """df1_idx, AcId, final_result: the constraint trees that each row's text satisfies."""
    passed = F.array(*(F.when(tree.column(F.col(text_col)), F.lit(name)) for name, tree in trees.items()))
    return df1.select(F.col(idx1).alias("df1_idx"), F.explode(F.filter(passed, lambda x: x.isNotNull())).alias("AcId")).withColumn("final_result", F.lit(True))


def attach_originals(pairs: DataFrame, df1: DataFrame, df2: DataFrame, *, idx1: str = "idx", idx2: str = "idx") -> DataFrame:
    """Left joins of both originals on their row ids; a name that both have gets the suffix _df1 or _df2."""
    taken = set(df1.columns) & set(df2.columns) | set(pairs.columns)

    def side(df: DataFrame, idx: str, n: int) -> DataFrame:
        return df.select(F.col(idx).alias(f"_key{n}"), *(F.col(f"`{c}`").alias(f"{c}_df{n}" if c in taken else c) for c in df.columns if c != idx))

    out = pairs.join(side(df1, idx1, 1), F.col("df1_idx") == F.col("_key1"), "left").drop("_key1")
    return out.join(side(df2, idx2, 2), F.col("df2_idx") == F.col("_key2"), "left").drop("_key2")


def rule_attached(df1: DataFrame, df2: DataFrame, rule: Any, *, idx1: str = "idx", idx2: str = "idx") -> DataFrame:
    """attach_originals of the rule's pairs. With a single alternative that has a key, each side's rows get the originals of
    their id before they pair, so that no pair is shuffled; the rows are the same, repeated and null ids included."""
    terms = conjunctions(build_rule(rule))
    if not _is_keyed(terms) or len(terms) > 1 or _near(terms[0]):
        return attach_originals(rule_pairs(df1, df2, rule, idx1=idx1, idx2=idx2), df1, df2, idx1=idx1, idx2=idx2)
    taken = set(df1.columns) & set(df2.columns) | {"df1_idx", "df2_idx", "final_result"}

    def side(df: DataFrame, idx: str, n: int, mark: str) -> tuple[DataFrame, list]:
        named = {c: f"{c}_df{n}" if c in taken else c for c in df.columns if c != idx}
        originals = df.select(F.col(f"`{idx}`").alias(f"_key{n}"), *(F.col(f"`{c}`").alias(f"_o{n}_{c}") for c in named))
        rows = _prefixed(df, mark)
        return rows.join(originals, F.col(f"`{mark}{idx}`") == F.col(f"_key{n}"), "left").drop(f"_key{n}"), [F.col(f"`_o{n}_{c}`").alias(new) for c, new in named.items()]

    (l, own), (r, other), ((keys, _),) = side(df1, idx1, 1, "_l_"), side(df2, idx2, 2, "_r_"), _by_keys(terms)
    return keyed_join(l, r, keys, _rest(terms)).select(F.col(f"`_l_{idx1}`").alias("df1_idx"), F.col(f"`_r_{idx2}`").alias("df2_idx"), F.lit(True).alias("final_result"), *own, *other)


def merge_accepted(pairs: DataFrame, df1: DataFrame, df2: DataFrame, *, idx1: str = "idx", idx2: str = "idx") -> DataFrame:
    """Accepted pairs with all columns of both tables, prefixed df1_ and df2_."""
    one = df1.select(F.col(idx1).alias("_key1"), *(F.col(f"`{c}`").alias(f"df1_{c}") for c in df1.columns if c != idx1))
    two = df2.select(F.col(idx2).alias("_key2"), *(F.col(f"`{c}`").alias(f"df2_{c}") for c in df2.columns if c != idx2))
    kept = pairs.where("final_result")
    return kept.join(one, F.col("df1_idx") == F.col("_key1"), "left").join(two, F.col("df2_idx") == F.col("_key2"), "left").drop("_key1", "_key2")


def _is_narrow(sides: tuple[tuple[DataFrame, set[str]], ...]) -> bool:
    """Whether the columns of a pair are plain and few bytes, as a cell's pairs are one table in Python."""
    total = 0
    for df, names in sides:
        plain = {c: t for c, t in df.dtypes if c in names}
        if not all(t in ("string", "tinyint", "smallint", "int", "bigint", "boolean", "float", "double", "date", "timestamp") or t.startswith("decimal") for t in plain.values()):
            return False
        texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in plain.items() if t == "string"]
        total += 16 * (len(plain) - len(texts)) + (df.agg(F.max(reduce(lambda a, b: a + b, texts))).first()[0] or 0 if texts else 0)
    return total <= PAIR_BYTES


def rule_join(df1: DataFrame, df2: DataFrame, rule: Any, *, idx1: str = "idx", idx2: str = "idx", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The accepted pairs with both rows' columns, or with those named of them: what goes through Python isn't pruned by Spark.
    Where ids are unique, rows bring their columns to their pairs; otherwise those are joined to the distinct pairs of ids."""
    terms = conjunctions(build_rule(rule))
    out = {"df1_idx": F.col(f"`_l_{idx1}`"), "df2_idx": F.col(f"`_r_{idx2}`"), "final_result": F.lit(True)}
    out |= {f"{new}{c}": F.col(f"`{mark}{c}`") for df, idx, mark, new in ((df1, idx1, "_l_", "df1_"), (df2, idx2, "_r_", "df2_")) for c in df.columns if c != idx}
    names = list(out) if columns is None else list(columns)
    l, r = _prefixed(df1, "_l_"), _prefixed(df2, "_r_")
    carried = {c for n in names for c in ([f"_l_{idx1}"] if n == "df1_idx" else [f"_r_{idx2}"] if n == "df2_idx" else [] if n == "final_result" else [f"_l_{n[4:]}" if n.startswith("df1_") else f"_r_{n[4:]}"])}

    def narrow() -> bool:
        read = carried.union(*_columns(terms))
        return not any(_is_near(l, r, t) for t in terms) or _is_narrow(((l, read), (r, read)))

    if not _is_keyed(terms) or not narrow() or not _settled(df1, df2, terms, idx1, idx2):
        return merge_accepted(rule_pairs(df1, df2, rule, idx1=idx1, idx2=idx2), df1, df2, idx1=idx1, idx2=idx2).select(*(F.col(f"`{n}`") for n in names))
    return reduce(DataFrame.union, (p.select(*(out[n].alias(n) for n in names)) for p in _alternatives(l, r, terms, carried, apart=len(terms) > 1)))


def without_decided(pairs: DataFrame, decided: DataFrame, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Pairs that aren't decided yet. Where both are partitioned by one of the keys, as by keyed_join's cell, none is shuffled;
    the session must allow it, and the plan is made when the result is used, so the setting stays."""
    pairs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return pairs.join(decided.select(*keys).hint("shuffle_hash"), list(keys), "left_anti")
