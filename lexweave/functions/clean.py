"""Cleaning operators: string column to string column, composed in chains.

Every cleaner is one Column expression, so a chain is one projection. Null stays null.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .authority import AuthorityMap, Kind, apply_letters, apply_words
from .text import PY_WS, as_column, drop, rejoin, strip, words

# Upper-case stopwords that are deleted as whole words.
STOPWORDS = """
A AN THE
AND BUT OR NOR FOR YET SO BOTH EITHER NEITHER
ABOUT ABOVE AFTER AGAINST ALONG AMID AMONG AROUND AT
BEFORE BEHIND BELOW BENEATH BESIDE BETWEEN BEYOND BY
DOWN DURING EXCEPT FROM IN INSIDE INTO LIKE
NEAR OF OFF ON ONTO OUT OVER PAST SINCE THROUGH
THROUGHOUT TO TOWARD UNDER UNTIL UP UPON WITH WITHIN WITHOUT
I YOU HE SHE IT WE THEY THEM THEIR OUR YOUR HIS HER
US MY MINE YOURS OURS THEIRS ME HIM ITS
AM IS ARE WAS WERE BE BEEN BEING HAVE HAS HAD DO DOES DID
CAN COULD SHALL SHOULD WILL WOULD MAY MIGHT MUST
THESE THOSE THIS THAT SUCH NO NOT ONLY VERY JUST THAN
""".split()

# Brackets that become round ones.
OPENING, CLOSING = "（[［{｛<＜", ")］]）}｝>＞"

# Option names and what they stand for.
UPPER_OPTIONS, LOWER_OPTIONS = ("upper", "大寫"), ("lower", "小寫")
SENTENCE_OPTIONS, WORDS_OPTIONS = ("sentence", "句子"), ("words", "每個字詞片段")
ASCEND_OPTIONS, DESCEND_OPTIONS = ("ascend", "升序"), ("descend", "降序")
KEEP_CLASSES = {"英文": "a-zA-Z", "數字": "0-9", "符號": re.escape(string.punctuation).replace('"', r"\"").replace("'", r"\'"), "字間空白": " "}
KEEP_EDGES = "句首末空白"


class WrongOptionError(ValueError):
    """An option that the operator doesn't know."""


# ---------------------------------------------------------------- without parameters
def noop(c: Column) -> Column:
    return c


def sentence_case(c: Column) -> Column:
    """First character title-cased, the rest lower-cased as part of the whole (so a final sigma stays one)."""
    first = F.substring(c, 1, 1)
    return F.concat(F.initcap(first), F.substr(F.lower(c), F.length(F.lower(first)) + 1))


def keep_english_letters(c: Column) -> Column:
    return drop(c, "[^a-zA-Z]")


def keep_digits(c: Column) -> Column:
    """Digits of any script."""
    return drop(c, r"(?U)\D")


def keep_letters_and_digits(c: Column) -> Column:
    return drop(c, "[^a-zA-Z0-9]")


def keep_letters_and_spaces(c: Column) -> Column:
    return drop(c, "[^a-zA-Z ]")


def remove_symbols(c: Column) -> Column:
    return drop(c, r"[^\p{L}\p{N}]")


def collapse_spacing(c: Column) -> Column:
    return drop(c, f"[{PY_WS}]+", " ")


def unicode_spacing(c: Column) -> Column:
    return drop(c, r"[\p{Z}\p{Cc}\p{Cf}]+", " ")


def ascending(c: Column) -> Column:
    return rejoin(F.array_sort(words(c)))


def descending(c: Column) -> Column:
    return rejoin(F.sort_array(words(c), asc=False))


def remove_html(c: Column) -> Column:
    return drop(c, "</?[^>]+>")


def unescape_quotes(c: Column) -> Column:
    """Escaped quotes and backslashes lose their backslash, then all quotes go."""
    for old, new in (("\\'", "'"), ('\\"', '"'), ("\\\\", "\\"), ('"', ""), ("'", "")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def round_brackets(c: Column) -> Column:
    return F.translate(c, OPENING + CLOSING, "(" * len(OPENING) + ")" * len(CLOSING))


def normalize_whitespace(c: Column) -> Column:
    return F.trim(drop(c, r"[\p{Z}\p{Cc}]+", " "))


def keep_letters_brackets_spaces(c: Column) -> Column:
    return drop(c, "[^a-zA-Z() ]")


def remove_stopwords(c: Column) -> Column:
    listed = "|".join(sorted(STOPWORDS, key=lambda w: (-len(w), w)))
    return rejoin(words(drop(c, rf"(?<![\p{{L}}\p{{N}}_])(?:{listed})(?![\p{{L}}\p{{N}}_])")))


# ---------------------------------------------------------------- with parameters
def _choice(mode: str, table: dict[tuple[str, ...], Callable[[Column], Column]]) -> Callable[[Column], Column]:
    if not isinstance(mode, str):
        raise TypeError(f"a string is needed, not {type(mode).__name__}")
    for names, f in table.items():
        if mode in names:
            return f
    raise WrongOptionError(f"{mode!r} is none of {[n for names in table for n in names]}")


def _strings(values: Any) -> list[str]:
    if not isinstance(values, list) or not all(isinstance(x, str) for x in values):
        raise TypeError("a list of strings is needed")
    return values


def convert_case(c: Column, mode: str) -> Column:
    return _choice(mode, {UPPER_OPTIONS: F.upper, LOWER_OPTIONS: F.lower})(c)


def capitalize(c: Column, mode: str) -> Column:
    return _choice(mode, {SENTENCE_OPTIONS: sentence_case, WORDS_OPTIONS: F.initcap})(c)


def sort_words(c: Column, mode: str) -> Column:
    return _choice(mode, {ASCEND_OPTIONS: ascending, DESCEND_OPTIONS: descending})(c)


def keep_classes(c: Column, options: list[str]) -> Column:
    """Keeps the union of the classes; edges are stripped, or the original's put back if that is asked for."""
    kept = "".join(KEEP_CLASSES[o] for o in KEEP_CLASSES if o in _strings(options))
    if not kept:
        raise re.error("no character class to keep")
    core = strip(drop(c, f"[^{kept}]"))
    if KEEP_EDGES not in options:
        return core
    blank = strip(c) == ""
    left = F.regexp_extract(c, rf"\A([{PY_WS}]*)", 1)
    right = F.regexp_extract(c, rf"([{PY_WS}]*)\z", 1)
    return F.when(blank, F.concat(c, c)).otherwise(F.concat(left, core, right))


def remove_characters(c: Column, symbols: list[str]) -> Column:
    """Removes the listed characters; entries of several characters match nothing."""
    single = "".join(dict.fromkeys(s for s in _strings(symbols) if len(s) == 1))
    return F.translate(c, single, "") if single else c


def delete_texts(c: Column, texts: list[str]) -> Column:
    for t in _strings(texts):
        c = F.replace(c, F.lit(t), F.lit("")) if t else c
    return c


def replace_texts(c: Column, pairs: list[Sequence[str]]) -> Column:
    if not isinstance(pairs, list) or not all(isinstance(p, (list, tuple)) and len(p) == 2 and all(isinstance(x, str) for x in p) for p in pairs):
        raise TypeError("a list of (old, new) pairs is needed")
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new)) if old else c
    return c


# ---------------------------------------------------------------- registry
@dataclass(frozen=True)
class Cleaner:
    """A registered cleaner. kind of its parameter: none, choice, multi_list, list_str, list_pairs or map."""

    name: str
    apply: Callable[..., Column]
    kind: str = "none"
    options: tuple[str, ...] = ()


_PLAIN = {
    "StrFuncNoop": noop,
    "StrFunc_Lowercase": F.lower,
    "StrFunc_Uppercase": F.upper,
    "StrFunc_SentenceCapitalization": sentence_case,
    "StrFunc_WordsCapitalization": F.initcap,
    "StrFunc_KeepEnglishLetter": keep_english_letters,
    "StrFunc_KeepDigits": keep_digits,
    "StrFunc_KeepEnglishLetterAndDigits": keep_letters_and_digits,
    "StrFunc_KeepEnglishWordsAndSpaces": keep_letters_and_spaces,
    "StrFunc_RemoveAllSymbols": remove_symbols,
    "StrFunc_NormalizeSpacingBetweenWords": collapse_spacing,
    "StrFunc_NormalizeUnicodeSpacing": unicode_spacing,
    "StrFunc_StripSymbols": strip,
    "StrFunc_AscendDictionaryOrder": ascending,
    "StrFunc_DescendDictionaryOrder": descending,
    "StrFunc_RemoveHtmlTags": remove_html,
    "StrFunc_CleanEscapedSymbols": unescape_quotes,
    "StrFunc_NormalizeParentheses": round_brackets,
    "StrFunc_NormalizeWhitespace": normalize_whitespace,
    "StrFunc_KeepEnglishParenthesesAndSpaces": keep_letters_brackets_spaces,
    "StrFunc_RemoveUpperCaseStopwords": remove_stopwords,
}
_PARAMETRIC = (
    Cleaner("StrFuncWithPars_CaseConvert", convert_case, "choice", UPPER_OPTIONS + LOWER_OPTIONS),
    Cleaner("StrFunc_Capitalize", capitalize, "choice", SENTENCE_OPTIONS + WORDS_OPTIONS),
    Cleaner("StrFunc_MultipleKeepLogic", keep_classes, "multi_list", (*KEEP_CLASSES, KEEP_EDGES)),
    Cleaner("StrFuncWithPars_RemoveSpecificSymbol", remove_characters, "list_str"),
    Cleaner("StrFunc_SortWordsWithDictionaryOrder", sort_words, "choice", ASCEND_OPTIONS + DESCEND_OPTIONS),
    Cleaner("StrFunc_ReplaceInputToNothing", delete_texts, "list_str"),
    Cleaner("StrFunc_ReplaceInputToSomething", replace_texts, "list_pairs"),
)


def _mapped(kinds: Kind, by_word: bool) -> Callable[[Column, AuthorityMap], Column]:
    return lambda c, table: (apply_words if by_word else apply_letters)(c, table.entries(kinds))


_WORD_KINDS = {"STOPWORD": Kind.STOPWORD, "ENCODING": Kind.ENCODING, "COMPANY": Kind.COMPANY, "SCHOOL": Kind.SCHOOL, "ORG": Kind.ORG, "HOSPITAL": Kind.HOSPITAL, "ALLOrg": Kind.SCHOOL | Kind.ORG | Kind.HOSPITAL | Kind.COMPANY}
_LETTER_KINDS = {"SYMBOL": Kind.SYMBOL, "FOREIGN": Kind.FOREIGN}
CLEANERS: dict[str, Cleaner] = {n: Cleaner(n, f) for n, f in _PLAIN.items()}
CLEANERS |= {f"StrFunc_ExcelACTable_{n}": Cleaner(f"StrFunc_ExcelACTable_{n}", _mapped(k, n in _WORD_KINDS), "map") for n, k in (_WORD_KINDS | _LETTER_KINDS).items()}
CLEANERS |= {c.name: c for c in _PARAMETRIC}


def register(name: str, apply: Callable[..., Column], kind: str = "none") -> None:
    """Adds a cleaner of one's own: a function (Column[, parameter]) -> Column, which may be a pandas UDF."""
    CLEANERS[name] = Cleaner(name, apply, kind)


def search(part: str) -> list[str]:
    """Names of cleaners that contain `part`, whatever its case."""
    return [n for n in CLEANERS if part.lower() in n.lower()]


def parse_list(text: str) -> list[str]:
    """One entry per row."""
    return [x for x in text.splitlines() if x.strip()]


def parse_pairs(text: str) -> list[tuple[str, str]]:
    """`old=new` rows, split at the first equals sign; rows without one are skipped."""
    return [tuple(x.split("=", 1)) for x in text.splitlines() if "=" in x and x.strip()]


_NOT_GIVEN = object()


def clean(name: str, column: Column | str, parameter: Any = _NOT_GIVEN) -> Column:
    """One cleaner applied to a column. KeyError for an unknown name, TypeError for a missing or wrong parameter."""
    cleaner = CLEANERS[name]
    if cleaner.kind == "none":
        if parameter is not _NOT_GIVEN and parameter is not None:
            raise TypeError(f"{name} takes no parameter")
        return cleaner.apply(as_column(column))
    if parameter is _NOT_GIVEN:
        raise TypeError(f"{name} needs a parameter")
    return cleaner.apply(as_column(column), parameter)


Step = str | tuple[str, Any] | Callable[[Column], Column]


def chain(steps: Iterable[Step], column: Column | str) -> Column:
    """Left fold over names, (name, parameter) pairs or functions."""
    def one(c: Column, step: Step) -> Column:
        return step(c) if callable(step) else clean(step, c) if isinstance(step, str) else clean(step[0], c, step[1])

    return reduce(one, steps, as_column(column))


def require_string(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise TypeError(f"{column} is {df.schema[column].dataType.simpleString()}, not string")


def clean_column(df: DataFrame, column: str, steps: Iterable[Step]) -> DataFrame:
    """original, result, changed."""
    require_string(df, column)
    out = df.select(F.col(column).alias("original"), chain(steps, column).alias("result"))
    return out.withColumn("changed", ~F.col("original").eqNullSafe(F.col("result")))
