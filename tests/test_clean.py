import re

import pytest
from pyspark.sql import functions as F

from lexweave.functions import clean as C
from lexweave.functions.authority import KIND_NAMES, AuthorityMap, Kind

PLAIN = [
    ("StrFuncNoop", " a ", " a "),
    ("StrFunc_Lowercase", "Hello World", "hello world"),
    ("StrFunc_Uppercase", "straße", "STRASSE"),
    ("StrFunc_SentenceCapitalization", "HELLO WORLD", "Hello world"),
    ("StrFunc_SentenceCapitalization", "", ""),
    ("StrFunc_WordsCapitalization", "hello  world foo", "Hello  World Foo"),
    ("StrFunc_KeepEnglishLetter", "abc123!@#", "abc"),
    ("StrFunc_KeepDigits", "abc123def456٣", "123456٣"),
    ("StrFunc_KeepEnglishLetterAndDigits", "abc 123!@#", "abc123"),
    ("StrFunc_KeepEnglishWordsAndSpaces", "hello 123 world!", "hello  world"),
    ("StrFunc_RemoveAllSymbols", "hello, wörld_漢!", "hellowörld漢"),
    ("StrFunc_NormalizeSpacingBetweenWords", "hello\t\nworld", "hello world"),
    ("StrFunc_NormalizeUnicodeSpacing", "hello　world", "hello world"),
    ("StrFunc_StripSymbols", "\thello　", "hello"),
    ("StrFunc_AscendDictionaryOrder", "banana apple  cherry", "apple banana cherry"),
    ("StrFunc_DescendDictionaryOrder", "apple banana cherry", "cherry banana apple"),
    ("StrFunc_RemoveHtmlTags", "<div><p>text</p></div>", "text"),
    ("StrFunc_CleanEscapedSymbols", '\\"hello\\"', "hello"),
    ("StrFunc_NormalizeParentheses", "（hello）[a]{b}", "(hello)(a)(b)"),
    ("StrFunc_NormalizeWhitespace", "  hello   world  ", "hello world"),
    ("StrFunc_KeepEnglishParenthesesAndSpaces", "hello (world) 123!", "hello (world) "),
    ("StrFunc_RemoveUpperCaseStopwords", "THE MIT OF NTU the", "MIT NTU the"),
    ("StrFunc_RemoveUpperCaseStopwords", "ÀTHE THE_A IN-OUT", "ÀTHE THE_A -"),
]
PARAMETRIC = [
    ("StrFuncWithPars_CaseConvert", "hello", "大寫", "HELLO"),
    ("StrFunc_Capitalize", "hello world", "每個字詞片段", "Hello World"),
    ("StrFuncWithPars_RemoveSpecificSymbol", "h@e#l$l%o", ["@", "#", "$", "%"], "hello"),
    ("StrFuncWithPars_RemoveSpecificSymbol", "abab", ["ab"], "abab"),
    ("StrFunc_SortWordsWithDictionaryOrder", "banana apple", "升序", "apple banana"),
    ("StrFunc_ReplaceInputToNothing", "the quick brown fox", ["quick ", "brown "], "the fox"),
    ("StrFunc_ReplaceInputToSomething", "foo bar baz", [("foo", "one"), ("bar", "two")], "one two baz"),
    ("StrFunc_MultipleKeepLogic", "hello 123!", ["英文", "數字"], "hello123"),
    ("StrFunc_MultipleKeepLogic", "  a.b [c]  ", ["英文", "符號", "句首末空白"], "  a.b[c]  "),
]


@pytest.fixture(scope="module")
def one(spark):
    def run(text, column):
        return spark.createDataFrame([(text,)], "t string").select(column.alias("r")).first()["r"]

    return run


@pytest.mark.parametrize("name,given,expected", PLAIN)
def test_plain(one, name, given, expected):
    assert one(given, C.clean(name, "t")) == expected


@pytest.mark.parametrize("name,given,parameter,expected", PARAMETRIC)
def test_parametric(one, name, given, parameter, expected):
    assert one(given, C.clean(name, "t", parameter)) == expected


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    plain = [n for n, c in C.CLEANERS.items() if c.kind == "none"]
    assert set(df.select(*(C.clean(n, "t").alias(n) for n in plain)).first()) == {None}


def test_errors():
    with pytest.raises(KeyError):
        C.clean("nope", "t")
    with pytest.raises(C.WrongOptionError):
        C.clean("StrFunc_Capitalize", F.lit("a"), "other")
    with pytest.raises(TypeError):
        C.clean("StrFunc_ReplaceInputToNothing", F.lit("a"), "text")
    with pytest.raises(TypeError):
        C.clean("StrFunc_ReplaceInputToNothing", F.lit("a"))
    with pytest.raises(re.error):
        C.clean("StrFunc_MultipleKeepLogic", F.lit("a"), [])


def test_registry_has_all():
    kinds = [c.kind for c in C.CLEANERS.values()]
    assert (kinds.count("none"), kinds.count("map"), len(kinds)) == (21, 9, 37)
    assert C.search("lower") == ["StrFunc_Lowercase"]
    assert C.parse_pairs("a=b=c\n\nx") == [("a", "b=c")]


def test_chain_order_and_changed_flag(spark):
    df = spark.createDataFrame([(" B a ",), ("a",), (None,)], "t string")
    rows = C.clean_column(df, "t", ["StrFunc_Lowercase", "StrFunc_AscendDictionaryOrder"]).collect()
    assert [tuple(r) for r in rows] == [(" B a ", "a b", True), ("a", "a", False), (None, None, False)]
    with pytest.raises(TypeError):
        C.clean_column(spark.range(1), "id", [])
    assert "Python" not in df.select(C.chain(["StrFunc_Lowercase", "StrFunc_RemoveUpperCaseStopwords"], "t"))._jdf.queryExecution().toString()


def test_authority_table(spark, one):
    stop, foreign = list(KIND_NAMES)[0], list(KIND_NAMES)[3]
    rows = [(0, stop, "of", "x", 1), (1, stop, "of", "OF", 1), (2, stop, "&", "AND", 1), (3, foreign, "ü", "u", 1), (4, stop, "at", "AT", 0), (5, "?", "q", "r", 1)]
    t = AuthorityMap.from_table(spark.createDataFrame(rows, "o int, `種類` string, `權控前` string, `權控後` string, `啟用狀態` int"), order="o")
    assert t.entries(Kind.STOPWORD) == {"of": "OF", "&": "AND"}
    assert one("bank of  a & b at", C.clean("StrFunc_ExcelACTable_STOPWORD", "t", t)) == "bank OF a AND b at"
    assert one("Zürich", C.clean("StrFunc_ExcelACTable_FOREIGN", "t", t)) == "Zurich"
    assert one(" a  b ", C.clean("StrFunc_ExcelACTable_HOSPITAL", "t", t)) == " a  b "


def test_letters_are_replaced_in_order(one):
    t = AuthorityMap([(Kind.SYMBOL, "a", "b"), (Kind.SYMBOL, "b", "c"), (Kind.SYMBOL, "xy", "")])
    assert one("abxy", C.clean("StrFunc_ExcelACTable_SYMBOL", "t", t)) == "cc"
