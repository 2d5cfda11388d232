import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import similarity as S

CASES = [
    ("EXACT", "hello", "Hello", None, {}, False, 0.0),
    ("EXACT", None, None, None, {}, True, 1.0),
    ("FUZZY", "hello", "helo", 0.8, {}, True, 8 / 9),
    ("FUZZY", "MIT", "M.I.T.", 0.7, {}, False, 2 / 3),
    ("FUZZY", "", "", 0.9, {}, True, 1.0),
    ("Levenshtein", "hello", "hellx", 0.5, {}, True, 0.8),
    ("Levenshtein", "", "", 0.9, {}, True, 1.0),
    ("Levenshtein", "héllo", "hello", 0.9, {}, False, 0.8),
    ("JaroWinkler", "martha", "marhta", 0.9, {}, True, 0.9611111111),
    ("IN", "hello world", "world", None, {}, True, 1.0),
    ("TwoSideInStringStrategy", "world", "hello world", None, {"strategy_mode": "b_in_a"}, False, 0.0),
    ("TwoSideInStringStrategy", "world", "hello world", None, {}, True, 1.0),
    ("TwoSideInWith3WordsStringStrategy", "hi", "hi there", None, {}, False, 0.0),
    ("LetterLCS", "abcd", "ab", 0.4, {}, True, 0.5),
    ("LetterLCS", None, "hello", 0.5, {}, False, -1.0),
    ("WordLCS", "apple banana cherry", "apple, banana", 0.5, {}, True, 2 / 3),
    ("JACCARD", "apple banana", "apple cherry", 0.1, {}, True, 1 / 3),
    ("JACCARD", "apple apple", "apple", 0.9, {}, True, 1.0),
    ("JACCARD", "", "", 0.1, {}, False, 0.0),
    ("NewJACCARDStrategy", "a ; b", "b ; c ; d", 0.4, {"split_segment": " ; ", "strategy_mode": "score_mode", "scoring_method": "set1_base"}, True, 0.5),
    ("NewJACCARDStrategy", "a ; b", "b ; a", 2, {"split_segment": " ; ", "strategy_mode": "amount_mode"}, True, 2.0),
    ("NewJACCARDStrategy", "", "b", 0.1, {"split_segment": ";", "strategy_mode": "score_mode"}, False, -1.0),
    ("NumberJaccardStrategy", "a b", "b c", 1, {}, True, 1 / 3),
    ("FourJaccardRapidFuzzyScoreStrategy", "a b c", "a c", 2, {}, True, 0.8),
    ("PREPROCESSED_EXACT", "b-A", "BA", None, {}, True, 1.0),
    ("AbbrevExactMatchStrategy", "MIT", "Massachusetts Institute (M.I.T.)", None, {}, True, 1.0),
    ("AbbrevExactMatchStrategy", "A B (ab)", "C D (AB)", None, {}, False, 0.0),
    ("AbbrevExactMatchStrategy", "A B (ab)", "C D (AB)", 3, {}, True, 1.0),
    ("PartialRatio", "abc", "xxabcxx", 0.9, {}, True, 1.0),
]


@pytest.mark.parametrize("name,a,b,standard,parameters,success,score", CASES)
def test_measures(spark, name, a, b, standard, parameters, success, score):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(S.similarity(name, "a", "b", standard, **parameters).alias("r")).first()["r"]
    assert r["success"] is success and r["score"] == pytest.approx(score)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_table():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(12))) for _ in "ab")
        assert S.lcs_length(a, b) == slow_lcs(a, b)
        assert S.jaro_winkler(a, b) == pytest.approx(S.jaro_winkler(b, a), abs=0.2)
        assert 0 <= S.jaro_winkler(a, b) <= 1


def test_missing_parameters_and_unknown_scoring():
    with pytest.raises(S.MissingParameters):
        S.segment_jaccard(F.lit("a"), F.lit("b"), 1)
    with pytest.raises(NotImplementedError):
        S.segment_jaccard(F.lit("a"), F.lit("b"), 1, split_segment=";", strategy_mode="score_mode", scoring_method="x")


def test_gates(spark):
    yes, no = S.result(F.lit(True), F.lit(0.9)), S.result(F.lit(False), F.lit(None).cast("double"))
    row = spark.range(1).select(*(g(yes, no).alias(n) for n, g in S.GATES.items())).first()
    assert [(row[n]["success"], row[n]["score"]) for n in S.GATES] == [(False, 0.45), (True, 0.9), (False, 0.9), (True, 0.45)]


def test_cosine_and_metadata(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "u array<float>, v array<float>")
    assert [r[0] for r in df.select(S.cosine_score(F.col("u"), F.col("v"))).collect()] == [pytest.approx(0.5**0.5), None]
    assert S.parameter_metadata("NewJACCARDStrategy")["split_segment"]["default"] == " ; "
    assert S.cast_parameter("Yes", "bool") is True and S.cast_parameter("3", "int") == 3


def test_encoder(spark):
    S.register_encoder(lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float")))
    df = spark.createDataFrame([("ab", "cd")], "a string, b string")
    assert df.select(S.similarity("Embedding", "a", "b", 0.9).alias("r")).first()["r"]["success"]
    del S.MEASURES["Embedding"]
