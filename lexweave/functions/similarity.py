"""Pair predicates and similarity scores: two columns to a struct<success boolean, score double>.

Exact, containment, Levenshtein, Jaccard and abbreviation measures are built-in expressions. Longest common
subsequences, Jaro-Winkler and partial ratios have no built-in form and are Arrow-batched UDFs with
bit-parallel or windowed kernels. Null in either side gives no match unless a measure says otherwise;
strict_nulls=True reads null as the text "None" where the measure's tradition does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .authority import AuthorityMap
from .text import PY_WS, as_column, strip, words

# ---------------------------------------------------------------- kernels


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two sequences; bits of one integer are the matrix row."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the common prefix's bonus above 0.7."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, pairs = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                pairs.append((x, j))
                break
    c = len(pairs)
    if not c:
        return 0.0
    twisted = sum(x != b[j] for (x, _), j in zip(pairs, sorted(j for _, j in pairs), strict=True)) // 2
    score = (c / len(a) + c / len(b) + (c - twisted) / c) / 3
    if score > 0.7:
        prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
        score += 0.1 * prefix * (1 - score)
    return score


def indel_ratio(a, b) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter string against windows of the longer, its shorter edge windows included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return float(not long)
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(indel_ratio(short, w) for w in windows)


def _pair_udf(kernel: Callable[[Any, Any], float], returns: str = "double"):
    @F.pandas_udf(returns)
    def scored(left: pd.Series, right: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for a, b in zip(left, right, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            key = (a, b) if isinstance(a, str) else (tuple(a), tuple(b))
            if key not in seen:
                seen[key] = kernel(*key)
            out.append(seen[key])
        return pd.Series(out, dtype="object")

    return scored


def lcs_column(a: Column, b: Column) -> Column:
    """LCS length of strings or of arrays of strings."""
    return _pair_udf(lcs_length, "int")(a, b)


# ---------------------------------------------------------------- measures
def result(success: Column, score: Column) -> Column:
    return F.struct(F.coalesce(success, F.lit(False)).alias("success"), score.cast("double").alias("score"))


def _at_least(score: Column, standard: float) -> Column:
    return result(score >= F.lit(float(standard)), score)


def _flag(hit: Column) -> Column:
    return result(hit, F.coalesce(hit, F.lit(False)).cast("double"))


def _named(c: Column, strict_nulls: bool) -> Column:
    return F.coalesce(c, F.lit("None")) if strict_nulls else c


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def exact(a: Column, b: Column, standard: float | None = None, *, null_equal: bool = True) -> Column:
    """Equality of comparable values; null equals null unless null_equal is False."""
    return _flag(a.eqNullSafe(b) if null_equal else F.coalesce(a == b, F.lit(False)))


def ratio_score(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * lcs_column(a, b) / total)


def fuzzy(a: Column, b: Column, standard: float, *, strict_nulls: bool = False) -> Column:
    return _at_least(ratio_score(_named(a, strict_nulls), _named(b, strict_nulls)), standard)


def levenshtein_score(a: Column, b: Column) -> Column:
    # without a branch, so that success and score share one evaluation; two empty texts have distance 0, so score 1
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def levenshtein(a: Column, b: Column, standard: float) -> Column:
    return _at_least(levenshtein_score(_blank(a), _blank(b)), standard)


def jaro(a: Column, b: Column, standard: float) -> Column:
    return _at_least(_pair_udf(jaro_winkler)(_blank(a), _blank(b)), standard)


def partial(a: Column, b: Column, standard: float) -> Column:
    return _at_least(_pair_udf(partial_ratio)(a, b), standard)


def contains_right(a: Column, b: Column, standard: float | None = None, *, strict_nulls: bool = False) -> Column:
    """Whether a contains b."""
    return _flag(F.contains(_named(a, strict_nulls), _named(b, strict_nulls)))


def contained(a: Column, b: Column, standard: float | None = None, *, strategy_mode: str = "any", least: int = 0) -> Column:
    """Whether one side contains the other: any, a_in_b or b_in_a; the contained side has at least `least` characters."""
    a, b = _blank(a), _blank(b)
    a_in_b = F.contains(b, a) & (F.length(a) >= least)
    b_in_a = F.contains(a, b) & (F.length(b) >= least)
    return _flag({"a_in_b": a_in_b, "b_in_a": b_in_a}.get(strategy_mode, a_in_b | b_in_a))


def contained_long(a: Column, b: Column, standard: float | None = None) -> Column:
    return contained(a, b, least=3)


def _lcs_share(a: Column, b: Column, size: Callable[[Column], Column], standard: float, missing: Column) -> Column:
    most = F.greatest(size(a), size(b))
    score = F.when(missing, -1.0).when(most == 0, 0.0).otherwise(lcs_column(a, b) / most)
    return result((score >= F.lit(float(standard))) & ~missing, score)


def letter_lcs(a: Column, b: Column, standard: float) -> Column:
    """LCS of characters over the longer length, both stripped; null gives -1."""
    return _lcs_share(strip(a), strip(b), F.length, standard, a.isNull() | b.isNull())


def lcs_similarity(a: Column, b: Column, standard: float) -> Column:
    """LCS of characters over the longer length, edges as they are."""
    return _lcs_share(a, b, F.length, standard, a.isNull() | b.isNull())


def tokens(c: Column) -> Column:
    return F.filter(F.split(strip(c), f"[;,，、{PY_WS}]+"), lambda w: w != "")


def word_lcs(a: Column, b: Column, standard: float) -> Column:
    return _lcs_share(tokens(a), tokens(b), F.size, standard, a.isNull() | b.isNull())


def _shared(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y))


def jaccard_score(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(_shared(x, y) / union)


def jaccard(a: Column, b: Column, standard: float, *, strict_nulls: bool = False) -> Column:
    return _at_least(jaccard_score(words(_named(a, strict_nulls)), words(_named(b, strict_nulls))), standard)


class MissingParameters(ValueError):
    """A measure lacks a parameter that it needs."""


def segment_jaccard(a: Column, b: Column, standard: float, *, split_segment: str | None = None, strategy_mode: str | None = None, scoring_method: str = "union_base", extra_debug_print: bool = False) -> Column:
    """Sets of segments between a literal separator, by amount or by score over the union or one side."""
    if not split_segment or not strategy_mode:
        raise MissingParameters("split_segment and strategy_mode are needed")
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    if strategy_mode not in ("amount_mode", "score_mode"):
        return result(F.lit(False), F.lit(-1.0))
    x, y = (F.array_distinct(F.split(c, "\\Q" + split_segment.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)) for c in (a, b))
    shared = _shared(x, y)
    if strategy_mode == "amount_mode":
        score, least = shared.cast("double"), float(int(standard))
    else:
        bases = {"union_base": F.size(F.array_union(x, y)), "set1_base": F.size(x), "set2_base": F.size(y)}
        if scoring_method not in bases:
            raise NotImplementedError(scoring_method)
        score, least = shared / bases[scoring_method], float(standard)
    score = F.when(missing, -1.0).otherwise(score)
    return result((score >= least) & ~missing, score)


def shared_segments(a: Column, b: Column, split_segment: str) -> Column:
    """The segments that both sides have, sorted."""
    return F.array_sort(F.array_intersect(*(F.split(c, "\\Q" + split_segment + "\\E", -1) for c in (a, b))))


def number_jaccard(a: Column, b: Column, standard: float, *, strict_nulls: bool = False) -> Column:
    """Success by the number of shared words, score by Jaccard."""
    x, y = words(_named(a, strict_nulls)), words(_named(b, strict_nulls))
    return result(_shared(x, y) >= int(standard), jaccard_score(x, y))


def shared_words_ratio(a: Column, b: Column, standard: float) -> Column:
    """Success by the number of shared words, score by the indel ratio of the word sequences."""
    x, y = words(a), words(b)
    total = F.size(x) + F.size(y)
    return result(_shared(x, y) >= int(standard), F.when(total == 0, 1.0).otherwise(2 * lcs_column(x, y) / total))


def cosine_score(u: Column, v: Column) -> Column:
    """Cosine of two float arrays in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(norm > 0, dot(u, v) / norm)


def cosine(u: Column, v: Column, standard: float) -> Column:
    return _at_least(cosine_score(u, v), standard)


def embedding(encoder: Callable[[Column], Column]) -> Callable[..., Column]:
    """A text measure from an encoder: a pandas UDF from string to array<float>."""
    return lambda a, b, standard: cosine(encoder(a), encoder(b), standard)


# ---------------------------------------------------------------- preprocessed and abbreviation measures
def authority_steps(table: AuthorityMap) -> list:
    """Chain of the preprocessed exact measure: stopwords, foreign letters, lower, organisations, alnum, upper, sorted words."""
    name = "StrFunc_ExcelACTable_"
    return [(f"{name}STOPWORD", table), (f"{name}FOREIGN", table), "StrFunc_Lowercase", (f"{name}ALLOrg", table), "StrFunc_KeepEnglishLetterAndDigits", "StrFunc_Uppercase", "StrFunc_AscendDictionaryOrder"]


def preprocessed_exact(a: Column, b: Column, standard: float | None = None, *, table: AuthorityMap | None = None, processors: list | None = None, strict_nulls: bool = False) -> Column:
    """Equality after a chain of cleaners; both sides are equi-join keys."""
    from .clean import chain

    steps = processors if processors is not None else authority_steps(table or AuthorityMap())
    return _flag(chain(steps, _named(a, strict_nulls)) == chain(steps, _named(b, strict_nulls)))


def preprocessed_fuzzy(a: Column, b: Column, standard: float, *, processors: list) -> Column:
    from .clean import chain

    return fuzzy(chain(processors, a), chain(processors, b), standard)


# Signals of the abbreviation measure and their tiers, from no risk on.
TIERS = {"EXACT_NAME": 0, "ABBR_IN_PAREN": 1, "NAME_EQ_ABBR": 2, "SAME_ABBR": 3}
NAME_AND_ABBREVIATION = rf"(?d)^(.+?)(?:[{PY_WS}]*\((.*?)\))?\z"


def name_and_abbreviation(c: Column) -> tuple[Column, Column]:
    """Lower-cased name and dotless abbreviation of `name (abbr)`."""
    text = strip(_blank(c))
    fits = text.rlike(NAME_AND_ABBREVIATION)
    name = F.when(fits, strip(F.regexp_extract(text, NAME_AND_ABBREVIATION, 1))).otherwise(text)
    abbreviation = F.when(fits, strip(F.regexp_extract(text, NAME_AND_ABBREVIATION, 2))).otherwise("")
    return F.lower(name), F.replace(F.lower(abbreviation), F.lit("."), F.lit(""))


def abbreviation_exact(a: Column, b: Column, standard: int | None = None, *, enabled_signals: list[str] | None = None, processors: list | None = None) -> Column:
    """Success if the best signal's tier is allowed (SAFE, 1, by default)."""
    if processors:
        from .clean import chain

        a, b = chain(processors, a), chain(processors, b)
    (n1, s1), (n2, s2) = name_and_abbreviation(a), name_and_abbreviation(b)
    cross = ((s2 != "") & (n1 == s2)) | ((s1 != "") & (n2 == s1))
    signals = {"EXACT_NAME": (n1 != "") & (n1 == n2), "ABBR_IN_PAREN": cross, "NAME_EQ_ABBR": cross, "SAME_ABBR": (s1 != "") & (s1 == s2)}
    tiers = [F.when(signals[n], F.lit(t)) for n, t in TIERS.items() if n in (enabled_signals or TIERS)]
    best = F.least(*tiers) if len(tiers) > 1 else tiers[0]
    return _flag(best <= (1 if standard is None else int(standard)))


def abbreviation_steps(table: AuthorityMap) -> list:
    """Chain of the preprocessed abbreviation measure."""
    name = "StrFunc_ExcelACTable_"
    return [(f"{name}STOPWORD", table), (f"{name}FOREIGN", table), "StrFunc_Lowercase", (f"{name}ALLOrg", table), "StrFunc_NormalizeParentheses", "StrFunc_NormalizeWhitespace", "StrFunc_KeepEnglishParenthesesAndSpaces", "StrFunc_Uppercase"]


def preprocessed_abbreviation(a: Column, b: Column, standard: int | None = None, *, table: AuthorityMap | None = None, enabled_signals: list[str] | None = None) -> Column:
    return abbreviation_exact(a, b, standard, enabled_signals=enabled_signals, processors=abbreviation_steps(table or AuthorityMap()))


# ---------------------------------------------------------------- logic gates
def _scores(children: list[Column]) -> list[Column]:
    return [F.coalesce(c["score"], F.lit(0.0)) for c in children]


def all_of(*children: Column) -> Column:
    """Success of all, mean score."""
    return result(reduce(lambda x, y: x & y, (c["success"] for c in children)), reduce(lambda x, y: x + y, _scores(list(children))) / len(children))


def any_of(*children: Column) -> Column:
    """Success of any, greatest score."""
    scores = _scores(list(children))
    return result(reduce(lambda x, y: x | y, (c["success"] for c in children)), F.greatest(*scores) if len(scores) > 1 else scores[0])


def none_of(*children: Column) -> Column:
    r = any_of(*children)
    return result(~r["success"], r["score"])


def not_all_of(*children: Column) -> Column:
    r = all_of(*children)
    return result(~r["success"], r["score"])


GATES = {"AND": all_of, "OR": any_of, "NotOR": none_of, "NotAND": not_all_of}


# ---------------------------------------------------------------- registry
@dataclass(frozen=True)
class Measure:
    """A registered measure; native ones run without Python, exact ones can be join keys."""

    name: str
    apply: Callable[..., Column]
    native: bool = True
    exact: bool = False
    parameters: dict[str, dict[str, Any]] = field(default_factory=dict)


def _choice(options: list[str], default: str, label: str, level: str = "necessary") -> dict[str, Any]:
    return {"mode": "select", "level": level, "options": options, "default": default, "label": label}


# Names of the measures, and names, options, defaults and labels of their parameters.
MEASURES: dict[str, Measure] = {m.name: m for m in (
    Measure("EXACT", exact, exact=True),
    Measure("FUZZY", fuzzy, native=False),
    Measure("Levenshtein", levenshtein),
    Measure("JaroWinkler", jaro, native=False),
    Measure("IN", contains_right),
    Measure("TwoSideInStringStrategy", contained, parameters={"strategy_mode": _choice(["any", "a_in_b", "b_in_a"], "any", "Match direction")}),
    Measure("TwoSideInWith3WordsStringStrategy", contained_long),
    Measure("LetterLCS", letter_lcs, native=False),
    Measure("WordLCS", word_lcs, native=False),
    Measure("JACCARD", jaccard),
    Measure("NewJACCARDStrategy", segment_jaccard, parameters={
        "split_segment": {"mode": "input", "level": "necessary", "default": " ; ", "type": "str", "label": "Split segment"},
        "strategy_mode": _choice(["score_mode", "amount_mode"], "score_mode", "Strategy mode"),
        "scoring_method": _choice(["union_base", "set1_base", "set2_base"], "union_base", "Scoring method", "optional"),
        "extra_debug_print": _choice(["False", "True"], "False", "Debug print", "optional"),
    }),
    Measure("NumberJaccardStrategy", number_jaccard),
    Measure("FourJaccardRapidFuzzyScoreStrategy", shared_words_ratio, native=False),
    Measure("PREPROCESSED_EXACT", preprocessed_exact, exact=True),
    Measure("AbbrevExactMatchStrategy", abbreviation_exact),
    Measure("PreprocessedAbbrevExactStrategy", preprocessed_abbreviation),
    Measure("PreprocessedFuzzyRatioStrategy", preprocessed_fuzzy, native=False),
    Measure("PartialRatio", partial, native=False),
    Measure("LcsSimilarity", lcs_similarity, native=False),
    Measure("Cosine", cosine),
)}


def register(name: str, apply: Callable[..., Column], *, native: bool = True, exact: bool = False) -> None:
    MEASURES[name] = Measure(name, apply, native, exact)


def register_encoder(encoder: Callable[[Column], Column], name: str = "Embedding") -> None:
    """Makes the embedding measure available with a sentence encoder; there is none without it."""
    register(name, embedding(encoder), native=False)


def parameter_metadata(name: str) -> dict[str, dict[str, Any]]:
    return MEASURES[name].parameters if name in MEASURES else {}


def cast_parameter(text: str, kind: str) -> Any:
    """A form's text as int, float, bool or str."""
    kinds = {"int": int, "float": float, "bool": lambda x: x.strip().lower() in ("1", "true", "t", "yes", "y")}
    return kinds.get(kind, str)(text)


def similarity(name: str | Callable[..., Column], left: Column | str, right: Column | str, standard: float | None = None, **parameters: Any) -> Column:
    """struct<success, score> of a registered measure or a function of the same shape."""
    apply = MEASURES[name].apply if isinstance(name, str) else name
    return apply(as_column(left), as_column(right), standard, **parameters)
