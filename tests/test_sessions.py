import itertools
import random
import time

import pytest

from lexweave.operators.flows import NOTHING, match_all, result_table, run_flow, with_serials
from lexweave.operators import ranker
from lexweave.operators.ranker import assign, rank_candidates, rank_typo_candidates, score_pairs
from lexweave.operators.select import Mode, category, modes_of, select_candidates

STEPS = {"raw_steps": ["StrFunc_Lowercase", "StrFunc_NormalizeWhitespace"], "ac_steps": ["StrFunc_Lowercase"], "matchers": [("EXACT", None), ("Levenshtein", 0.5)]}


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([("TarGet", "  target "), ("zzz", "q")], "ac string, raw string")


def test_flows(pair):
    phases = lambda n, **k: [(r.seq, r.matching_score, r.phases) for r in run_flow(pair, n, **(STEPS if n < 5 else {"matchers": STEPS["matchers"]}), **k).orderBy("seq").collect()]
    assert [p[0] for p in phases(1)] == [1]
    three = phases(3)
    assert [p[0] for p in three] == [1, 2, 3] and three[1][1] == 1.0
    assert three[0][2] == ["[acm]StrFunc_Lowercase", "[tcm]StrFunc_Lowercase", "[mm]EXACT", "[mm]Levenshtein"]
    assert [p[0] for p in phases(4, break_first=True)] == [1]
    assert [p[0] for p in phases(5, operations=[("acm", "StrFunc_Lowercase"), ("tcm", "StrFunc_NormalizeWhitespace")])] == [1, 2, 3]
    six = phases(6, operations=[("acm", "StrFunc_Lowercase"), ("tcm", "StrFunc_NormalizeWhitespace"), ("mm", ("EXACT", None))], keep_score=False)
    assert six == [(0, 0.0, ["StrFunc_Lowercase", "StrFunc_NormalizeWhitespace", "EXACT"])]
    with pytest.raises(ValueError):
        run_flow(pair, 7)


def test_result_tables(spark, pair):
    found = run_flow(pair, 3, **STEPS)
    table = result_table(found, pair, raw_col="raw")
    assert {r.raw_text: r.ac_texts for r in table.collect()} == {"  target ": ["TarGet"], "q": [NOTHING]}
    serials = spark.createDataFrame([("TarGet", 9)], "t string, s int")
    assert {r.raw_text: r.serials for r in with_serials(table, serials, text_col="t", serial_col="s").collect()} == {"  target ": ["9"], "q": ["Unknown"]}
    acs, raws = spark.createDataFrame([("target",), ("TarGet",)], "ac string"), spark.createDataFrame([("tAR gE t",), ("?",)], "raw string")
    best = match_all(acs, raws, ac_steps=["StrFunc_Lowercase"], raw_steps=["StrFunc_Lowercase", ("StrFunc_ReplaceInputToNothing", [" "])], matchers=[("EXACT", None)])
    assert {r.raw_text: r.ac_texts for r in best.collect()} == {"tAR gE t": ["TarGet"], "?": [NOTHING]}


def brute(rows, mode, n=2, z=None):
    """Independent reading of the modes over rows (ac, raw, score, seq, phases) of one session."""
    count = {a: sum(r[0] == a for r in rows) for a in {r[0] for r in rows}}
    top = max((r[2] for r in rows), default=0)
    most = max(count.values(), default=0)

    def per_ac(key):
        return [min((r for r in rows if r[0] == a), key=key) for a in count]

    if not rows or mode == Mode.ORIGINAL_RESULT:
        return rows
    return {
        Mode.BestScoreMatcher: lambda: [min(rows, key=lambda r: (-r[2], r[0], r[1], r[3]))],
        Mode.AllBestScoreMatchers: lambda: [r for r in rows if r[2] == top],
        Mode.All97ScoreMatchers: lambda: [r for r in rows if r[2] >= 97],
        Mode.AllAboveZScoreMatchers: lambda: [r for r in rows if r[2] >= (95 if z is None else z)],
        Mode.Top3ScoreMatchers: lambda: sorted(rows, key=lambda r: (-r[2], r[3]))[:3],
        Mode.GreatestAmountMatcher: lambda: [r for r in rows if r[0] == min(a for a in count if count[a] == most)],
        Mode.AllGreatestAmountMatchers: lambda: [r for r in rows if count[r[0]] == most],
        Mode.AllMoreThanTwoMatchers: lambda: [r for r in rows if count[r[0]] >= 2],
        Mode.AllMoreThanNMatchers: lambda: [r for r in rows if count[r[0]] >= n],
        Mode.DeduplicateByBestScore: lambda: per_ac(lambda r: (-r[2], r[3])),
        Mode.DeduplicateByFirstMatch: lambda: per_ac(lambda r: r[3]),
        Mode.DeduplicateByLastMatch: lambda: per_ac(lambda r: -r[3]),
        Mode.DeduplicateByMostPhases: lambda: per_ac(lambda r: (-len(r[4]), r[3])),
        Mode.MostFrequentInOverZScore: lambda: brute([r for r in rows if r[2] >= (85 if z is None else z)], Mode.AllGreatestAmountMatchers),
        Mode.BestScoreInFrequentGroup: lambda: brute(brute(rows, Mode.AllGreatestAmountMatchers), Mode.AllBestScoreMatchers),
    }[mode]()


@pytest.mark.parametrize("mode", list(Mode))
def test_selection(spark, mode):
    rng = random.Random(mode)
    rows = [(s, rng.choice("abc"), rng.choice("xy"), float(rng.choice([50, 86, 97, 100])), k, ["p"] * rng.randrange(3)) for s in range(4) for k in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(rows, "session int, ac_text string, raw_text string, matching_score double, seq int, phases array<string>")
    got = sorted(tuple(r) for r in select_candidates(df, mode, session=["session"], n=3).collect())
    expected = sorted((s, *r) for s in range(4) for r in brute([x[1:] for x in rows if x[0] == s], mode, 3))
    assert got == expected
    assert select_candidates(df.limit(0), mode, session=["session"]).count() == 0


def test_mode_categories():
    assert category(Mode.DeduplicateByFirstMatch) == "deduplication" and len(modes_of("score")) == 5


def ranked(spark, query, names, f=rank_candidates, **k):
    df = spark.createDataFrame([(query, c, i) for i, c in enumerate(names)], "query string, candidate string, seq int")
    return [r.candidate for r in f(df, **k).orderBy("place").collect()]


def test_ranker(spark):
    assert ranked(spark, "NATL TAIWAN UNIV", ["XX", "TAIWAN NATL UNIV HOSP", "NATL TAIWAN UNIV"])[0] == "NATL TAIWAN UNIV"
    first = ranked(spark, "NATL TAIWAN UNIV", ["NATLTAIWAN UNIV", "NATL TAI WAN UNIV", "NTL TWN"], rank_typo_candidates)
    assert first[:2] == ["NATL TAI WAN UNIV", "NATLTAIWAN UNIV"]
    df = spark.createDataFrame([("a univ", "a univ hosp", 0), ("a univ", None, 1)], "query string, candidate string, seq int")
    for mode, word, hit in (("exact", "-hos", False), ("exact", "hosp", True), ("boundary", "ho", True), ("in", "os", True), ("fuzzy", "hopp", False), ("fuzzy", "hop", True), ("other", "hosp", True)):
        rows = score_pairs(df, negatives=[word], negative_mode=mode).collect()
        assert rows[0]["rejected"] is hit and (rows[0]["score"] == 0) == hit
        assert rows[1]["score"] == 0.0


def test_assignment_is_best():
    rng = random.Random(3)
    for _ in range(60):
        q, c = (["".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 5))] for _ in "qc")
        sims = [[ranker.token_similarity(x, y) for y in c] for x in q]
        best = max(sum(sims[i][j] for i, j in zip(rows, cols, strict=True)) for k in range(min(len(q), len(c)) + 1) for rows in itertools.combinations(range(len(q)), k) for cols in itertools.permutations(range(len(c)), k))
        assert sum(s for *_, s in assign(q, c)) == pytest.approx(best)


def test_assignment_equals_brute_force():
    """Greatest total, then the earliest token that can stay unassigned or take the earliest candidate token; ties are frequent here."""
    rng = random.Random(9)

    def brute(sims):
        best = (0, ())
        rows, columns = len(sims), len(sims[0])
        for path in itertools.product(range(columns + 1), repeat=rows):
            used = [j for j in path if j]
            if len(set(used)) == len(used) and all(sims[i][j - 1] > 0 for i, j in enumerate(path) if j):
                total = sum(round(sims[i][j - 1] * 1e9) for i, j in enumerate(path) if j)
                best = min(best, (-total, path)) if best[1] else (-total, path)
        return [(i, j - 1, sims[i][j - 1]) for i, j in enumerate(best[1]) if j]

    for _ in range(400):
        q, c = (["".join(rng.choices("ab", k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 5))] for _ in range(2))
        assert ranker.assign(q, c) == brute([[ranker.token_similarity(x, y) for y in c] for x in q]), (q, c)
    for _ in range(100):
        prices = [[-rng.randrange(4) for _ in range(rng_columns)] for rng_columns in [rng.randrange(1, 5)] for _ in range(rng.randrange(1, 6))]
        got = ranker.cheapest(prices)
        taken = [j for j in got if j is not None]
        assert len(set(taken)) == len(taken)
        every = min(sum(prices[i][j] for i, j in enumerate(path) if j < len(prices[0])) for path in itertools.product(range(len(prices[0]) + 1), repeat=len(prices)) if all(path.count(j) < 2 for j in range(len(prices[0]))))
        assert sum(prices[i][j] for i, j in enumerate(got) if j is not None) == every


def test_assignment_of_many_tokens_is_quick():
    rng = random.Random(10)
    q, c = (["".join(rng.choices("abcdef", k=6)) for _ in range(30)] for _ in range(2))
    sims = [[ranker.token_similarity(x, y) for y in c] for x in q]
    start = time.perf_counter()
    found = ranker.assign(q, c)
    assert time.perf_counter() - start < 0.5 and len(found) == 30 and all(sims[i][j] == s for i, j, s in found)
