import random

import numpy as np

from lexweave.functions.edit_distance import distances
from lexweave.operators import best_match as module
from lexweave.operators.edit_join import near_pairs


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_equal_the_plain_table():
    """Empty, repeated, null-character and wide texts; a bound loses nothing within it."""
    rng = random.Random(1)
    for _ in range(60):
        a, b = (["".join(rng.choices("abé😀\0", k=rng.randrange(8))) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        expected = np.array([[plain(x, y) for y in b] for x in a])
        assert (distances(a, b) == expected).all()
        most = np.array([rng.randrange(5) for _ in a])
        inside = expected <= most[:, None]
        got = distances(a, b, most)
        assert (got[inside] == expected[inside]).all() and (got[~inside] > np.broadcast_to(most[:, None], got.shape)[~inside]).all()
    long = ["a" * 300, "b" * 260]
    assert distances(long, ["a" * 299, ""]).tolist() == [[1, 300], [299, 260]]


def test_search_in_blocks_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc", k=rng.randrange(7))) for _ in range(80)] + [None, "", "abc", "abc"]
    left = spark.createDataFrame([(t,) for t in texts], "w string")
    right = spark.createDataFrame([(t, rng.choice([None, 1, 2])) for t in texts[::-1]], "w string, pos int")
    for threshold, order, same in ((0.5, "pos", False), (0.6, None, True), (1.0, "pos", False)):
        run = lambda: sorted(map(repr, module.best_match(left, right, "Levenshtein", threshold, left_col="w", right_col="w", order_col=order, exclude_same=same).collect()))  # noqa: B023, E731
        monkeypatch.setattr(module, "SEARCH_PAIRS", 1 << 22)
        expected = run()
        monkeypatch.setattr(module, "SEARCH_PAIRS", 0)
        monkeypatch.setattr(module, "SEARCH_BLOCK", 9)
        assert run() == expected


def test_near_pairs_are_those_of_the_scores():
    """Scores at, just above and below a standard; texts of several lengths, with and without a common prefix."""
    rng = random.Random(7)
    for start in ("", "Customer#00"):
        a, b = (sorted({start + "".join(rng.choices("012", k=rng.randrange(9))) for _ in range(40)}) for _ in range(2))
        for least in (0.1, 0.4, 0.6, 2 / 3, 0.7, 0.9, 1.0):
            every = [(i, j, 1 - plain(x, y) / max(len(x), len(y), 1)) for i, x in enumerate(a) for j, y in enumerate(b)]
            got = zip(*(x.tolist() for x in near_pairs(a, b, least)), strict=True)
            assert sorted(got) == [t for t in every if t[2] >= least]
