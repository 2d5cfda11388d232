"""Statistics of a text as column expressions, without Python on the executors.

Words are runs of characters other than ASCII white space. A null text counts as empty. The statistics
go through whole texts of any length; each is computed once, in steps that later steps read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def occurrences(text: Column, sign: str) -> Column:
    """How often a one-byte sign stands in a text."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))).cast("long")


def pattern_chars(text: Column, unwanted: str) -> Column:
    """Characters left once the pattern is taken out."""
    return F.length(F.regexp_replace(text, unwanted, "")).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds _words, n_words, word_chars, n_symbols and n_dup_lines of the text column."""
    df = df.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_words", words(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.size(F.split("_text", SYMBOLS, -1)) - 1).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of 8 words that the text has twice or more, the first time included.

    A window is known by its 64-bit hash. Texts without a repeated window, the most, stop after one
    distinct count; in the others equal hashes become neighbours by sorting, so the cost is n log n.
    """
    w = F.col("_words")
    window = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    df = df.withColumn("_windows", F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    twice = F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])))
    df = df.withColumn("_found", F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    p = F.col("_found")
    covered = F.aggregate(F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def with_shape(df: DataFrame) -> DataFrame:
    """Adds the ratios that classifiers and rules read; names in SHAPE."""
    w = F.col("_words")
    df = df.withColumns({
        "_distinct": F.size(F.array_distinct("_words")),
        "_same": F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, F.greatest(i - 1, F.lit(0)))))),
        "_upper": pattern_chars(F.col("_text"), r"[^\p{Lu}]+"),
        "_digits": pattern_chars(F.col("_text"), r"[^0-9]+"),
        "_bangs": occurrences(F.col("_text"), "!"),
        "_bars": occurrences(F.col("_text"), "|"),
    })
    n, chars = F.col("n_words"), F.col("word_chars")
    return df.withColumns({
        "size_log": F.log(n + 1.0),
        "symbol_ratio": ratio(F.col("n_symbols"), n),
        "bang_ratio": ratio(F.col("_bangs"), n),
        "bar_ratio": ratio(F.col("_bars"), n),
        "upper_ratio": ratio(F.col("_upper"), chars),
        "digit_ratio": ratio(F.col("_digits"), chars),
        "mean_word": ratio(chars, n),
        "distinct_ratio": ratio(F.col("_distinct"), n),
        "same_ratio": ratio(F.col("_same"), n),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "line_words": ratio(n, F.col("n_lines")),
    })


SHAPE = ["size_log", "symbol_ratio", "bang_ratio", "bar_ratio", "upper_ratio", "digit_ratio", "mean_word", "distinct_ratio", "same_ratio", "dup_line_ratio", "line_words"]
