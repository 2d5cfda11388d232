import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexweave import queries as own
from lexweave.functions.similarity import MEASURES
from lexweave.operators import assemble as A
from lexweave.operators import best_match as best_match_module
from lexweave.operators.best_match import best_match
from lexweave.operators.constraints import ConstraintNode, from_rows
from lexweave.operators.edit_join import keyed_scores
from lexweave.operators.rule_join import attach_originals, constraint_pairs, merge_accepted, rule_attached, rule_debug, rule_join, rule_pairs, without_decided
from lexweave.operators.select import Mode, select_candidates
from lexweave.plans import pairing
from lexweave.plans.rule_tree import build_rule, conjunctions, depth, width


def test_best_match_golden(spark):
    left = spark.createDataFrame([("MIT",), ("Stanford",), ("Apple Inc.",), ("MIT",), (None,)], "query string")
    right = spark.createDataFrame([("M.I.T.", 0), ("Stanford University", 1), ("Apple", 2)], "ref string, pos int")
    rows = sorted(tuple(r) for r in best_match(left, right, "FUZZY", 0.3, order_col="pos", round_scores=True).collect())
    assert rows == [("Apple Inc.", "Apple", 0.6667), ("MIT", "M.I.T.", 0.6667), ("MIT", "M.I.T.", 0.6667), ("Stanford", "Stanford University", 0.5926)]
    assert best_match(left, right.limit(0), "FUZZY", 0.0).count() == 0


def test_best_match_ties_and_bands(spark):
    left = spark.createDataFrame([("ab",)], "query string")
    right = spark.createDataFrame([("b", 1), ("a", 2)], "ref string, pos int")
    assert best_match(left, right, "Levenshtein", 0.5, order_col="pos").first()["best_match"] == "b"
    assert best_match(left, right, "Levenshtein", 0.5).first()["best_match"] == "a"
    rng = random.Random(2)
    words = ["".join(rng.choices("ab", k=rng.randrange(1, 14))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for name in ("Levenshtein", "FUZZY"):
        banded = best_match(df, df, name, 0.7, left_col="w", right_col="w", exclude_same=True)
        plain = best_match(df, df, name, 0.0, left_col="w", right_col="w", exclude_same=True).where("score >= 0.7")
        assert sorted(banded.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("name", ["JACCARD", "WordLCS", "EXACT", "Levenshtein"])
def test_best_match_by_keys_equals_all_pairs(spark, monkeypatch, name):
    """Pairs that meet on rare words, equal texts or blocks of a band are all that reach the threshold; hot words and repeated words included."""
    monkeypatch.setattr(best_match_module, "BLOCK", 7)
    rng = random.Random(5)
    texts = [" ".join(["the"] * rng.randrange(3) + rng.choices(["a", "b", "cc", "dd", "e", "ff"], k=rng.randrange(0, 5))) for _ in range(70)] + ["", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    for threshold in (0.34, 0.5, 1.0):
        keyed = best_match(df, df, name, threshold, left_col="w", right_col="w", exclude_same=name != "EXACT")
        plain = best_match(df, df, MEASURES[name].apply, threshold, left_col="w", right_col="w", exclude_same=name != "EXACT")
        assert sorted(keyed.collect()) == sorted(plain.collect())


RULE = {"Rules": ["OR",
    {"C": ["AND", {"df1": "A", "df2": "A", "method": ["AND", {"algo": "EXACT"}]}, {"df1": "C", "df2": "C", "method": ["OR", {"algo": "Levenshtein", "standard": 0.5}, {"algo": "IN"}]}]},
    {"C": ["NotOR", {"df1": "C", "df2": "C", "method": ["NotAND", {"algo": "EXACT"}]}]}]}


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    make = lambda: [(i, rng.choice([1, 2, 3, None]), rng.choice(["x", "xy", "yx", "zzz"])) for i in range(14)]
    return make(), make()


def test_rule_pairs_equal_brute_force(spark, sides, monkeypatch):
    one, two = (spark.createDataFrame(x, "idx long, A int, C string") for x in sides)

    def close(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b)) >= 0.5

    expected = sorted((i, j) for (i, a, c), (j, b, d) in itertools.product(*sides) if (a == b and (close(c, d) or d in c)) or c == d)
    got = rule_pairs(one, two, RULE)
    assert sorted((r.df1_idx, r.df2_idx) for r in got.collect()) == expected
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()
    every = rule_debug(one, two, RULE)
    assert sorted((r.df1_idx, r.df2_idx) for r in every.where("final_result").collect()) == expected
    monkeypatch.setattr(pairing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pairing, "is_small", lambda df: False)
    monkeypatch.setattr(pairing, "BLOCK_ROWS", 3)
    loose = {"Rules": ["AND", {"df1": "C", "df2": "C", "method": ["AND", {"algo": "IN"}]}]}
    blocked = rule_pairs(one, two, loose)
    assert sorted((r.df1_idx, r.df2_idx) for r in blocked.collect()) == sorted((i, j) for (i, _, c), (j, _, d) in itertools.product(*sides) if d in c)


def test_rule_tree_shapes():
    t = build_rule(RULE)
    assert depth(t) == 4 and width(t) == 4 and len(conjunctions(t)) == 3
    for bad in ({"X": []}, {"Rules": ["XOR", {"algo": "EXACT"}]}, {"Rules": ["AND"]}, {"Rules": ["AND", {"algo": "nope", "df1": "a", "df2": "b"}]}):
        with pytest.raises(ValueError):
            build_rule(bad)


def test_merge_and_attach(spark):
    one = spark.createDataFrame([(0, 5, "p")], "idx long, A int, C string")
    two = spark.createDataFrame([(7, 5, "q")], "idx long, A int, D string")
    rule = {"Rules": ["AND", {"df1": "A", "df2": "A", "algo": "EXACT"}]}
    assert rule_join(one, two, rule).first().asDict() == {"df1_idx": 0, "df2_idx": 7, "final_result": True, "df1_A": 5, "df1_C": "p", "df2_A": 5, "df2_D": "q"}
    assert set(attach_originals(rule_pairs(one, two, rule), one, two).columns) == {"df1_idx", "df2_idx", "final_result", "A_df1", "C", "A_df2", "D"}


def test_constraints(spark):
    rows = [(1, 2, 3, "AND", "", ""), (2, 4, None, "NOT", "", ""), (3, None, None, "IN", "taipei", "a"), (4, None, None, "SIMPLE", "New Road 12, x", "")]
    t = from_rows(rows)
    assert t.render() == "NOT New Road 12, x AND taipei" and t.depth() == 3 and t.width() == 2
    assert [n.node_id for n in t.walk("post")] == [4, 2, 3, 1]
    df = spark.createDataFrame([(0, "Dept, TAIPEI"), (1, "x"), (2, None)], "idx long, Address string")
    assert [tuple(r) for r in constraint_pairs(df, {"t": t}, text_col="Address").collect()] == [(0, "t", True)]
    either = ConstraintNode("OR", left=ConstraintNode("FUZZY", "X"), right=None)
    assert [r.df1_idx for r in constraint_pairs(df, {"e": either}, text_col="Address").collect()] == [1]


def test_assembly(spark):
    a = spark.createDataFrame([("1", "q", "u"), ("2", "r", "v"), (None, "s", "w")], "id string, query string, colA string")
    b = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "ref string, colB string")
    m = A.normalize_headings(spark.createDataFrame([("1", "x", 0.5)], "str1 string, `Best Match` string, ratio double"))
    got = A.matched(m, a, b, "id", "ref", ["query", "colA"], ["colB"])
    assert got.columns == ["_scenario", "query", "best_match", "score", "query_A", "colA", "colB"] and got.count() == 2
    ua, ub = A.unmatched(a, m, "id", "A", ["colA"]), A.unmatched(b, m, "ref", "B", ["colB"])
    assert [r["query"] for r in ua.collect()] == ["2"] and [r["best_match"] for r in ub.collect()] == ["y"]
    full = A.report(got, ua, ub, got.limit(0))
    assert {r["_scenario"]: r["n_rows"] for r in A.scenario_counts(full).collect()} == {"matched": 2, "unmatched_A": 1, "unmatched_B": 1}
    assert [tuple(r) for r in A.duplicate_keys(full).collect()] == [("matched", "1", 2)]
    assert [tuple(r) for r in A.duplicate_summary(full).collect()] == [("matched", ["1"], 0)]
    assert A.unique_names(["a", "a", "a"], "_A") == ["a", "a_A", "a_A2"]
    with pytest.raises(ValueError):
        A.normalize_headings(spark.range(1))


def test_index_is_gapless(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r["idx"] for r in pairing.with_index(df).collect()) == list(range(100))
    assert all(r["id"] == r["idx"] for r in pairing.with_index(df, order=["id"]).collect())
    assert pairing.with_index(df.limit(0)).count() == 0
    again = pairing.with_index(pairing.with_index(df, order=["id"]).groupBy("id").agg(F.max("idx").alias("idx")), order=["idx"])
    assert again.columns == ["id", "idx"] and sorted(r["idx"] for r in again.collect()) == list(range(100))


def test_grid_of_two_large_sides(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pairing, "BLOCK_ROWS", 4)
    one, two = spark.range(23).withColumnRenamed("id", "a"), spark.range(17).withColumnRenamed("id", "b")
    got = pairing.theta_join(one.union(one.limit(3)), two, F.col("a") > F.col("b"))
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((a, b) for a in [*range(23), 0, 1, 2] for b in range(17) if a > b)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


@pytest.fixture
def tiny_cells(monkeypatch):
    monkeypatch.setattr(pairing, "HOT_PAIRS", 3)
    monkeypatch.setattr(pairing, "CELL_ROWS", 2)
    monkeypatch.setattr(pairing, "TASK_PAIRS", 4)


def test_frequent_keys_are_cut_into_cells(spark, sides, tiny_cells):
    """Frequent, rare and null keys; the pairs of a frequent key are those of more than one task, each pair once."""
    one = spark.createDataFrame([*sides[0], (20, 7, "r"), (20, 7, "r")], "idx long, A int, C string")
    two = spark.createDataFrame([*sides[1], (30, 7, "s")], "idx long, A int, C string")
    got = rule_pairs(one, two, {"Rules": ["AND", {"df1": "A", "df2": "A", "algo": "EXACT"}]})
    expected = sorted((l.idx, r.idx) for l in one.collect() for r in two.collect() if l.A == r.A)
    assert sorted((r.df1_idx, r.df2_idx) for r in got.collect()) == expected
    tasks = got.select("df1_idx", F.spark_partition_id().alias("p"), F.lit(0).alias("k")).join(one.where("A = 1").withColumnRenamed("idx", "df1_idx"), "df1_idx").select("p").distinct().count()
    assert tasks > 1


def test_attached_originals_come_along(spark, sides, tiny_cells):
    """Repeated ids and nulls give the same rows as joins after pairing do."""
    one = spark.createDataFrame([*sides[0], (3, 1, "again"), (None, 2, "no id")], "idx long, A int, C string")
    two = spark.createDataFrame([*sides[1], (5, 2, "again")], "idx long, A int, D string")
    rule = {"Rules": ["AND", {"df1": "A", "df2": "A", "algo": "EXACT"}]}
    got, plain = rule_attached(one, two, rule), attach_originals(rule_pairs(one, two, rule), one, two)
    assert got.columns == plain.columns and sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_decided_pairs_are_not_shuffled(spark, tiny_cells):
    one = spark.createDataFrame([(i, i % 2) for i in range(12)], "i long, a int")
    two = spark.createDataFrame([(j, j % 3) for j in range(12)], "j long, b int")
    pairs = pairing.keyed_join(one, two, [("a", "b")], cell="cell").select("cell", "i", "j")
    got = without_decided(pairs, pairs.where("j > i"), ("cell", "i", "j"))
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i in range(12) for j in range(12) if i % 2 == j % 3 and j <= i)
    assert "ENSURE_REQUIREMENTS" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x)


def test_neighbours_are_cleaned_before_they_pair(spark, small):
    """The cleaner's pattern is a step of each side's rows, below the join, not of each pair."""
    plan = own.QUERIES["measure_preprocessed_exact"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and plan.index("Join") < plan.index("regexp_replace")


NAMES = ["", "a", "ab", "ba", "abc", "abd", "üx", "a" * 9, "ab" * 8, "b" * 40, "𝒳y", None]


@pytest.mark.parametrize("least", [None, 0.4, 1.0])
def test_scores_of_cells_equal_the_builtin(spark, tiny_cells, least):
    """Frequent, rare and null keys, null and empty names, repeated rows: the same pairs and scores as of a plain join."""
    rng = random.Random(8)
    make = lambda: [(i, rng.choice([1, 1, 2, 3, None]), rng.choice(NAMES)) for i in range(30)]
    one = spark.createDataFrame([*make(), (90, 7, "ab"), (3, 1, "ab"), (3, 1, "ab")], "i long, k int, a string")
    two = spark.createDataFrame([*make(), (91, 7, "abd"), (92, 8, "q")], "j long, l int, b string")
    got = keyed_scores(one, two, [("k", "l")], "a", "b", least=least)
    assert "FlatMapCoGroups" in got._jdf.queryExecution().toString()
    score = MEASURES["Levenshtein"].apply(F.col("a"), F.col("b"), 0.5)["score"]
    plain = one.join(two, one.k.eqNullSafe(two.l)).withColumn("score", score).where(F.lit(True) if least is None else F.col("score") >= least)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_near_neighbours_are_scored_in_cells(spark, small, monkeypatch):
    """The built-in distance takes some microseconds a pair, so it isn't taken of a frequent nation's pairs."""
    plain = sorted(own.QUERIES["measure_levenshtein_neighbours"](spark, small).collect())
    monkeypatch.setattr(pairing, "HOT_PAIRS", 0)
    monkeypatch.setattr(pairing, "CELL_ROWS", 5)
    got = own.QUERIES["measure_levenshtein_neighbours"](spark, small)
    assert sorted(got.collect()) == plain and plain
    assert "FlatMapCoGroups" in got._jdf.queryExecution().toString()


def test_levenshtein_alternatives_are_scored_in_cells(spark, sides, tiny_cells):
    """The built-in distance isn't taken of a frequent key's pairs; the pairs are those of the tree over all pairs."""
    one, two = (spark.createDataFrame([*x, (50, 1, None), (51, 1, "xy")], "idx long, A int, C string") for x in sides)
    near = ["AND", {"df1": "A", "df2": "A", "algo": "EXACT"}, {"df1": "C", "df2": "C", "algo": "Levenshtein", "standard": 0.5}]
    other = {"df1": "C", "df2": "C", "algo": "IN"}
    jaccard = {"df1": "C", "df2": "C", "algo": "JACCARD", "standard": 0.5}
    for rule in (near, ["OR", near, ["AND", near[1], other]], [*near, ["NotOR", jaccard]]):
        got = rule_pairs(one, two, {"Rules": rule})
        expected = rule_debug(one, two, {"Rules": rule}).where("final_result").select("df1_idx", "df2_idx", "final_result")
        assert sorted(got.collect()) == sorted(expected.collect())
        assert sum("FlatMapCoGroups" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
    attached = rule_attached(one, two, {"Rules": rule})
    assert sorted(map(repr, attached.collect())) == sorted(map(repr, attach_originals(expected, one, two).collect()))


def test_joined_rules_are_scored_in_cells(spark, small, monkeypatch):
    plain = sorted(map(repr, own.QUERIES["rule_join_attached"](spark, small).collect()))
    monkeypatch.setattr(pairing, "HOT_PAIRS", 4)
    monkeypatch.setattr(pairing, "CELL_ROWS", 5)
    got = own.QUERIES["rule_join_attached"](spark, small)
    assert sorted(map(repr, got.collect())) == plain and plain
    assert "FlatMapCoGroups" in got._jdf.queryExecution().toString()


def test_greatest_amount_sorts_once(spark):
    """The most frequent ac of a session, the least of equally frequent ones, null first; from one sort of the session's rows."""
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", None]), k) for k in range(40)] + [(9, "y", 41), (9, "x", 42), (8, None, 43), (8, "a", 44)]
    df = spark.createDataFrame(rows, "session int, ac_text string, seq int")
    got = select_candidates(df, Mode.GreatestAmountMatcher, session=["session"])
    expected = []
    for own in {r[0] for r in rows}:
        n = {ac: sum(r[:2] == (own, ac) for r in rows) for ac in {r[1] for r in rows if r[0] == own}}
        top = min(n, key=lambda ac: (-n[ac], ac or ""))
        expected += [r for r in rows if r[:2] == (own, top)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    spread = select_candidates(pairing.spread(df, ["session"], 44), Mode.GreatestAmountMatcher, session=["session"])
    plan = spread._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count(" Sort ") == 1 and plan.count("Exchange ") == 1


def test_tasks_of_candidates_follow_the_rows(spark, small, monkeypatch):
    monkeypatch.setattr(pairing, "SORT_ROWS", 100)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert own.QUERIES["select_greatest_amount_matcher"](spark, small).rdd.getNumPartitions() == -(-rows // 100)


MIXED = {"Rules": ["OR",
    ["AND", {"df1": "A", "df2": "A", "algo": "EXACT"}, {"df1": "C", "df2": "C", "method": ["OR", {"algo": "Levenshtein", "standard": 0.5}, {"algo": "IN"}]}],
    ["AND", {"df1": "C", "df2": "C", "method": ["NotOR", {"algo": "JACCARD", "standard": 0.5}]}, {"df1": "idx", "df2": "idx", "algo": "EXACT"}]]}


def _shuffles(df) -> str:
    """What the physical plan shuffles by its own requirement."""
    return "".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ENSURE_REQUIREMENTS" in x)


def test_pairs_of_unique_ids_are_not_shuffled(spark, sides, tiny_cells):
    """Alternatives that overlap give a pair once and rows bring their columns, so pairs need no distinct and no join by id."""
    one = spark.createDataFrame([*sides[0], (50, 1, None), (51, None, "xy")], "idx long, A int, C string")
    two = spark.createDataFrame([*sides[1], (52, 1, None), (51, None, "x")], "idx long, A int, C string")
    decided = rule_debug(one, two, MIXED).where("final_result").select("df1_idx", "df2_idx", "final_result")
    pairs, got = rule_pairs(one, two, MIXED), rule_join(one, two, MIXED)
    assert sorted(pairs.collect()) == sorted(decided.collect())
    plain = merge_accepted(decided, one, two)
    assert got.columns == plain.columns and got.dtypes == plain.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    for df in (pairs, got):
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert "df1_idx" not in _shuffles(df)
    some = rule_join(one, two, MIXED, columns=("df2_C", "df1_idx"))
    assert sorted(map(repr, some.collect())) == sorted(map(repr, plain.select("df2_C", "df1_idx").collect()))


@pytest.mark.parametrize("rows", [[(3, 1, "again")], [(None, 1, "xy"), (None, 2, "x")], [(60, 1, "x" * 400)]])
def test_joined_pairs_of_other_ids(spark, sides, tiny_cells, rows):
    """Repeated ids, null ids and wide rows: the distinct pairs of ids with the columns joined to them."""
    one = spark.createDataFrame([*sides[0], *rows], "idx long, A int, C string")
    two = spark.createDataFrame([*sides[1], *rows], "idx long, A int, C string")
    decided = rule_debug(one, two, MIXED).where("final_result").select("df1_idx", "df2_idx", "final_result").distinct()
    assert sorted(map(repr, rule_pairs(one, two, MIXED).collect())) == sorted(map(repr, decided.collect()))
    got, plain = rule_join(one, two, MIXED), merge_accepted(decided, one, two)
    assert got.columns == plain.columns and sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_joined_rules_sort_few_rows(spark, small):
    """The least name of a group needs no sort of all pairs."""
    plan = own.QUERIES["rule_join_attached"](spark, small)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    names = [x for x in plan.splitlines() if "HashAggregate" in x or "SortAggregate" in x]
    assert "HashAggregate" in names[-1] and "df1_c_name" in names[-1]
