"""Authority maps: before/after entries by kind, from a table or literals, applied by word or by substring."""

from __future__ import annotations

from collections.abc import Iterable
from enum import IntFlag, auto

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import rejoin, words


class Kind(IntFlag):
    """Kinds of entries; kinds can be combined."""

    STOPWORD = auto()
    SYMBOL = auto()
    ENCODING = auto()
    FOREIGN = auto()
    COMPANY = auto()
    SCHOOL = auto()
    ORG = auto()
    HOSPITAL = auto()


# How tables name the kinds, and their columns.
KIND_NAMES = {
    "基本權控【停止詞】": Kind.STOPWORD,
    "基本權控【符號統一】": Kind.SYMBOL,
    "基本權控【編碼詞統一】": Kind.ENCODING,
    "基本權控【外語字母統一】": Kind.FOREIGN,
    "專案權控【專利權人 - 公司詞】": Kind.COMPANY,
    "專案權控【校名權控 - 學校詞】": Kind.SCHOOL,
    "專案權控【校名權控 - 機構詞】": Kind.ORG,
    "專案權控【校名權控 - 醫院詞】": Kind.HOSPITAL,
}
TABLE_COLUMNS = {"kind": "種類", "before": "權控前", "after": "權控後", "enabled": "啟用狀態"}
#: Entries beyond which a table is too large for a literal in the plan.
MAX_ENTRIES = 50_000


class AuthorityMap:
    """Entries by kind; of two entries for the same text the later wins, at the place of the earlier."""

    def __init__(self, rows: Iterable[tuple[Kind, str, str]] = ()):
        self._kinds: dict[Kind, dict[str, str]] = {k: {} for k in Kind}
        self._merged: dict[Kind, dict[str, str]] = {}
        for kind, before, after in rows:
            self._kinds[kind][before] = after

    @classmethod
    def from_table(cls, df: DataFrame, *, order: str | None = None, columns: dict[str, str] | None = None) -> AuthorityMap:
        """From a small table of entries with kind, before, after and enabled; `order` tells the rows' order.

        Duplicates are settled in Spark, and the number of entries is checked before they come to the driver.
        """
        named = TABLE_COLUMNS | (columns or {})
        rank = F.col(order) if order else F.monotonically_increasing_id()
        rows = df.where(F.col(named["enabled"]) == 1).select(F.col(named["kind"]).alias("k"), F.col(named["before"]).alias("b"), F.col(named["after"]).alias("a"), rank.alias("o"))
        known = rows.where(F.col("k").isin([*KIND_NAMES]) & F.col("b").isNotNull())
        entries = known.groupBy("k", "b").agg(F.min("o").alias("first"), F.max_by("a", "o").alias("a"))
        found = entries.orderBy("first").limit(MAX_ENTRIES + 1).collect()
        if len(found) > MAX_ENTRIES:
            raise ValueError(f"an authority map holds at most {MAX_ENTRIES} entries")
        return cls((KIND_NAMES[r.k], r.b, r.a or "") for r in found)

    def entries(self, mask: Kind) -> dict[str, str]:
        """Merged entries of the kinds in order; later kinds override."""
        if mask not in self._merged:
            merged: dict[str, str] = {}
            for kind in Kind:
                if kind & mask:
                    merged |= self._kinds[kind]
            self._merged[mask] = merged
        return self._merged[mask]


def apply_words(c: Column, entries: dict[str, str]) -> Column:
    """Replaces whole words. An empty map leaves the text as it is, spacing included."""
    if not entries:
        return c
    table = F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))
    return rejoin(F.transform(words(c), lambda w: F.coalesce(F.try_element_at(table, w), w)))


def apply_letters(c: Column, entries: dict[str, str]) -> Column:
    """Replaces substrings one entry after another, so a later entry sees what an earlier one has put."""
    keys, values = [k for k in entries if k], "".join(entries.values())
    if keys and all(len(k) == 1 and len(entries[k]) <= 1 for k in keys) and not set(keys) & set(values):
        full = [k for k in keys if entries[k]]
        return F.translate(c, "".join(full + [k for k in keys if not entries[k]]), "".join(entries[k] for k in full))
    for old in keys:
        c = F.replace(c, F.lit(old), F.lit(entries[old]))
    return c
