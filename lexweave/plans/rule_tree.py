"""Rule trees: nested lists and dicts to a boolean expression over two rows, and its equality keys.

A list is [gate, rule, ...]; a dict with `algo` is a leaf over columns df1 and df2; another dict hands its
entries down and its nested rules up. A rule set is {"Rules": ...}.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.similarity import MEASURES

# Measures that a rule may name.
ALLOWED = ("EXACT", "FUZZY", "Levenshtein", "JaroWinkler", "IN", "TwoSideInStringStrategy", "TwoSideInWith3WordsStringStrategy", "LetterLCS", "WordLCS", "JACCARD", "NewJACCARDStrategy", "PREPROCESSED_EXACT")
#: Conjunctions beyond which a rule isn't split into equi-joins.
MOST_TERMS = 64


@dataclass(frozen=True)
class Leaf:
    algo: str
    df1: str
    df2: str
    standard: Any = None
    parameters: tuple[tuple[str, Any], ...] = ()

    def column(self, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        return MEASURES[self.algo].apply(left(self.df1), right(self.df2), self.standard, **dict(self.parameters))["success"]


@dataclass(frozen=True)
class Constraint:
    """A constraint tree over a left column."""

    df1: str
    tree: Any

    def column(self, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        return self.tree.column(left(self.df1))


@dataclass(frozen=True)
class Gate:
    op: str
    children: tuple

    def column(self, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        # cheap leaves first: And and Or stop at the first that decides
        parts = [c.column(left, right) for c in sorted(self.children, key=cost)]
        joined = reduce((lambda a, b: a & b) if self.op in ("AND", "NotAND") else (lambda a, b: a | b), parts)
        return ~joined if self.op.startswith("Not") else joined


def cost(node: Any) -> int:
    if isinstance(node, Gate):
        return 1 + max(map(cost, node.children))
    return 0 if isinstance(node, Leaf) and node.algo == "EXACT" else 1 if not isinstance(node, Leaf) or MEASURES[node.algo].native else 2


def _children(rule: Any, inherited: dict[str, Any]) -> list:
    if isinstance(rule, list):
        if not rule or rule[0] not in ("AND", "OR", "NotOR", "NotAND"):
            raise ValueError(f"a rule list begins with a gate: {rule!r}")
        parts = [n for sub in rule[1:] for n in _children(sub, inherited)]
        if not parts:
            raise ValueError(f"a gate without rules: {rule!r}")
        return [Gate(rule[0], tuple(parts))]
    if not isinstance(rule, dict):
        raise ValueError(f"invalid rule: {rule!r}")
    own = inherited | rule
    if "algo" in own:
        if own["algo"] not in ALLOWED:
            raise ValueError(f"{own['algo']!r} isn't a measure for rules")
        more = own.get("strategy_parameters") or {}
        return [Leaf(own["algo"], own["df1"], own["df2"], own.get("standard"), tuple(sorted(more.items())))]
    nested = []
    for key, value in rule.items():
        if key == "PRIS_Tree":
            nested.append(Constraint(value["df1_col"], value["tree"]))
        elif isinstance(value, (list, dict)):
            nested += _children(value, own)
    return nested


def build_rule(rule: Any) -> Gate | Leaf | Constraint:
    """The tree of a rule set or of a bare rule."""
    if isinstance(rule, dict) and "Rules" not in rule and "algo" not in rule:
        raise ValueError("a rule set has Rules")
    found = _children(rule["Rules"] if isinstance(rule, dict) and "Rules" in rule else rule, {})
    if not found:
        raise ValueError("no rule found")
    return found[0] if len(found) == 1 else Gate("AND", tuple(found))


def conjunctions(node: Any, negated: bool = False) -> list[tuple] | None:
    """Disjunctive form: tuples of (leaf, negated) of which one must hold; None if there are too many."""
    if not isinstance(node, Gate):
        return [((node, negated),)]
    flip = negated != node.op.startswith("Not")
    parts = [conjunctions(c, flip) for c in node.children]
    if any(p is None for p in parts):
        return None
    if (node.op in ("AND", "NotAND")) != flip:
        size = reduce(lambda n, p: n * len(p), parts, 1)
        return [sum(x, ()) for x in product(*parts)] if size <= MOST_TERMS else None
    total = [t for p in parts for t in p]
    return total if len(total) <= MOST_TERMS else None


def holds(terms: tuple, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
    return reduce(lambda a, b: a & b, (~n.column(left, right) if neg else n.column(left, right) for n, neg in sorted(terms, key=lambda x: cost(x[0]))))


def depth(node: Any) -> int:
    return 1 + max(map(depth, node.children)) if isinstance(node, Gate) else 1


def width(node: Any) -> int:
    return sum(map(width, node.children)) if isinstance(node, Gate) else 1


def leaf_results(node: Any, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
    """Map from each node's name to its result, for a look into a decision."""
    def walk(n: Any, path: str) -> list[Column]:
        name = f"{path}/{n.op}" if isinstance(n, Gate) else f"{path}/{getattr(n, 'algo', 'PRIS_Tree')}"
        own = [F.lit(name), n.column(left, right)]
        return own + [x for k, c in enumerate(getattr(n, "children", ())) for x in walk(c, f"{name}.{k}")]

    return F.create_map(*walk(node, ""))
