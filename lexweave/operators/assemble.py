"""Report assembly: matched and unmatched rows of two tables, their union, duplicate keys, counts, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings that match files may use for the result columns.
SYNONYMS = {
    "query": ("query", "str1", "a", "input"),
    "best_match": ("best_match", "match", "str2", "b", "result"),
    "score": ("score", "similarity", "ratio"),
}


def normalize_headings(df: DataFrame) -> DataFrame:
    """query, best_match and score from headings of any case, with spaces or synonyms; score defaults to ""."""
    plain = {c.lower().replace(" ", "_"): c for c in df.columns}
    seen = {name: name if name in df.columns else next(plain[o] for o in others if o in plain) for name, others in SYNONYMS.items() if name in df.columns or not plain.keys().isdisjoint(others)}
    missing = [n for n in ("query", "best_match") if n not in seen]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    out = df.withColumnsRenamed({c: n for n, c in seen.items()})
    return out if "score" in seen else out.withColumn("score", F.lit(""))


def unique_names(names: list[str], suffix: str) -> list[str]:
    """Repeats get the suffix, then the suffix with 2, 3 and so on."""
    out: list[str] = []
    for n in names:
        k, new = 1, n
        while new in out:
            new = f"{n}{suffix}" if k == 1 else f"{n}{suffix}{k}"
            k += 1
        out.append(new)
    return out


def _part(df: DataFrame, key: str, as_name: str, columns: list[str], suffix: str, taken: set[str] = frozenset()) -> DataFrame:
    """The key under its new name and the chosen columns, renamed where they clash."""
    picked = [key, *(c for c in columns if c != key)]
    names = unique_names([as_name, *picked[1:]], suffix)
    names = [names[0], *(f"{n}{suffix}" if n in taken else n for n in names[1:])]
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(picked, names, strict=True)))


def matched(matches: DataFrame, a: DataFrame, b: DataFrame, key_a: str, key_b: str, columns_a: list[str], columns_b: list[str]) -> DataFrame:
    """Matches with the chosen columns of both tables; repeated keys multiply rows."""
    base = matches.select("query", "best_match", "score")
    if columns_a:
        base = base.join(_part(a, key_a, "query", columns_a, "_A", {"best_match", "score"}), "query", "left")
    if columns_b:
        base = base.join(_part(b, key_b, "best_match", columns_b, "_B", set(base.columns)), "best_match", "left")
    first = ["query", "best_match", "score"]
    return base.select(F.lit("matched").alias("_scenario"), *first, *(c for c in base.columns if c not in first))


def unmatched(df: DataFrame, matches: DataFrame, key: str, side: str, columns: list[str]) -> DataFrame:
    """Rows of table A (or B) whose key no match has; null keys don't count. The other side is empty text."""
    own, other = ("query", "best_match") if side == "A" else ("best_match", "query")
    k = F.col(f"`{key}`")
    keyed = df.where(k.isNotNull()).withColumn("_key", k.cast("string"))
    rest = keyed.join(matches.where(F.col(own).isNotNull()).select(F.col(own).cast("string").alias("_key")), "_key", "left_anti")
    out = _part(rest, key, own, columns, f"_{side}")
    for c in (other, "score"):
        out = out.withColumn(c, F.lit("")) if c not in out.columns else out
    return out.select(F.lit(f"unmatched_{side}").alias("_scenario"), *out.columns)


def report(*scenarios: DataFrame) -> DataFrame:
    """Union by name; what a scenario lacks is empty text. Empty scenarios are welcome."""
    texts = [d.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in d.columns)) for d in scenarios]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), texts).na.fill("")


def scenario_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_scenario").agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """_scenario, key, n of keys that stand more than once; empty keys don't count."""
    key = F.when(F.col("_scenario").isin("matched", "unmatched_A"), F.col("query")).otherwise(F.col("best_match"))
    return rows.groupBy("_scenario", key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND key <> ''")


def duplicate_summary(rows: DataFrame, sample: int = 5) -> DataFrame:
    """Per scenario the first few repeated keys and how many more there are."""
    d = duplicate_keys(rows)
    w = F.row_number().over(Window.partitionBy("_scenario").orderBy("key"))
    return d.withColumn("_k", w).groupBy("_scenario").agg(F.array_sort(F.collect_list(F.when(F.col("_k") <= sample, F.col("key")))).alias("sample"), F.greatest(F.count(F.lit(1)) - sample, F.lit(0)).alias("more"))


def evaluated(cases: DataFrame, outcome: Column, *, expected: str = "expected") -> DataFrame:
    """Test cases with success and correct."""
    return cases.withColumn("success", F.coalesce(outcome, F.lit(False))).withColumn("correct", F.col("success") == F.col(expected))


def evaluation_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("passed"), F.coalesce(F.sum((~F.col("correct")).cast("long")), F.lit(0)).alias("failed"))
