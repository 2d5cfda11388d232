"""Constraint trees: boolean expressions over containment and similarity to a text, compiled to one column."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarity that simple and fuzzy texts must reach.
CLOSE = 0.95
_RANK = {"OR": 1, "AND": 2, "NOT": 3}


def _close(a: Column, b: Column) -> Column:
    """Levenshtein of the upper-cased texts over the longer original length."""
    longest = F.greatest(F.length(a), F.length(b))
    score = F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(F.upper(a), F.upper(b)) / longest)
    return score >= CLOSE


@dataclass(frozen=True)
class ConstraintNode:
    """kind: AND, OR, NOT (left only), SIMPLE (any ", "-separated segment is close), IN (contained, case-blind), FUZZY (whole text is close)."""

    kind: str
    value: str = ""
    left: ConstraintNode | None = None
    right: ConstraintNode | None = None
    node_id: int = 0
    acid: str = ""

    def column(self, text: Column) -> Column:
        """A missing child counts as false; a null text satisfies no leaf."""
        side = lambda n: n.column(text) if n else F.lit(False)
        word = F.coalesce(text, F.lit(""))
        if self.kind == "AND":
            return side(self.right) & side(self.left)
        if self.kind == "OR":
            return side(self.left) | side(self.right)
        if self.kind == "NOT":
            return ~side(self.left)
        value = F.lit(self.value)
        if self.kind == "SIMPLE":
            leaf = F.exists(F.split(word, ", ", -1), lambda s: _close(s, value))
        elif self.kind == "IN":
            leaf = F.contains(F.upper(word), F.upper(value))
        elif self.kind == "FUZZY":
            leaf = _close(word, value)
        else:
            raise ValueError(f"unknown kind {self.kind!r}")
        return leaf & text.isNotNull()

    def render(self) -> str:
        """Infix, with the parentheses that precedence needs."""
        def inner(child: ConstraintNode | None) -> str:
            if child is None:
                return "?"
            return f"({child.render()})" if _RANK.get(child.kind, 9) < _RANK[self.kind] else child.render()

        if self.kind == "NOT":
            return f"NOT {inner(self.left)}"
        if self.kind in _RANK:
            return f"{inner(self.left)} {self.kind} {inner(self.right)}"
        return self.value

    def walk(self, order: str = "pre") -> Iterator[ConstraintNode]:
        """Nodes in pre, in or post order."""
        first, second = (list(n.walk(order)) if n else [] for n in (self.left, self.right))
        yield from {"pre": [self, *first, *second], "in": [*first, self, *second], "post": [*first, *second, self]}[order]

    def depth(self) -> int:
        return 1 + max((n.depth() for n in (self.left, self.right) if n), default=0)

    def width(self) -> int:
        """Greatest number of nodes on a level."""
        level, most = [self], 0
        while level:
            most = max(most, len(level))
            level = [c for n in level for c in (n.left, n.right) if c]
        return most


def from_rows(rows: Iterable[tuple[int, int | None, int | None, str, str, str]]) -> ConstraintNode:
    """From (node_id, left_id, right_id, kind, value, acid); the root is the node that no other names."""
    table = {r[0]: r for r in rows}
    inner = {x for r in table.values() for x in (r[1], r[2]) if x is not None}
    roots = [i for i in table if i not in inner]
    if len(roots) != 1:
        raise ValueError(f"{len(roots)} roots")

    def make(i: int | None, seen: frozenset[int]) -> ConstraintNode | None:
        if i is None:
            return None
        if i in seen:
            raise ValueError("a node is its own ancestor")
        _, a, b, kind, value, acid = table[i]
        return ConstraintNode(kind, value, make(a, seen | {i}), make(b, seen | {i}), i, acid)

    return make(roots[0], frozenset())
