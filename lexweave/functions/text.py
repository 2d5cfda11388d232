"""Building blocks shared by cleaners and similarities: white space and word lists as Python's str methods see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of Python's str.split(), as the inside of a character class.
PY_WS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same characters one by one, for trimming.
PY_WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop(c: Column, pattern: str, put: str = "") -> Column:
    return F.regexp_replace(c, pattern, put)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_WS_CHARS))


def words(c: Column) -> Column:
    """Words between white space; none for a blank string."""
    return F.filter(F.split(c, f"[{PY_WS}]+"), lambda w: w != "")


def rejoin(words_column: Column) -> Column:
    return F.array_join(words_column, " ")
