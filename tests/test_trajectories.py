"""Message trees, token drift and samples of sessions, on values chosen by hand."""

import pytest
from pyspark.sql import functions as F

from trajlake.operators import packing, trajectories, weights
from trajlake.operators.weight_search import _Problem, improve, search_weights

SHAPE = "session string, turn int, messages array<string>, answer string, prompt_ids array<int>, output_ids array<int>, logprobs array<double>, reward double"


def m(role, text):
    return f"{role}\x1f{text}"


def samples(spark, turns, **options):
    rows = spark.createDataFrame([("s", k, *t, 1.0) for k, t in enumerate(turns)], SHAPE)
    found = trajectories.session_samples(rows, **options).orderBy("sample").collect()
    return [(r.tokens, r.loss_mask, r.logprobs, r.reward) for r in found]


SYS, U1, A1, U2, A2 = m("system", "s"), m("user", "u1"), m("assistant", "a1"), m("user", "u2"), m("assistant", "a2")


def test_a_clean_chain_is_one_sample(spark):
    turns = [([SYS, U1], A1, [1, 2], [3, 4], [-0.1, -0.2]), ([SYS, U1, A1, U2], A2, [1, 2, 3, 4, 5], [6], [-0.3])]
    assert samples(spark, turns) == [([1, 2, 3, 4, 5, 6], [1, 1, 0, 1], [-0.1, -0.2, 0.0, -0.3], 1.0)]


def test_drift_inside_the_last_answer_is_realigned_if_short(spark):
    turns = [([SYS, U1], A1, [1, 2], [3, 4], None), ([SYS, U1, A1, U2], A2, [1, 2, 3, 9, 5], [6], None)]
    assert samples(spark, turns) == [([1, 2, 3, 9, 5, 6], [0, 0, 0, 1], [0.0] * 4, 1.0)]
    # Long answers, and drift before the last answer, begin a sample of their own.
    assert samples(spark, turns, threshold=1) == [([1, 2, 3, 4], [1, 1], [0.0] * 2, 0.5), ([1, 2, 3, 9, 5, 6], [1], [0.0], 0.5)]
    early = [turns[0], ([SYS, U1, A1, U2], A2, [1, 7, 3, 4, 5], [6], None)]
    assert len(samples(spark, early)) == 2


def test_branches_share_an_answer_that_is_trained_once(spark):
    turns = [
        ([SYS, U1], A1, [1], [2], None), ([SYS, U1, A1, U2], A2, [1, 2, 3], [4], None), ([SYS, U1, A1, m("user", "other")], m("assistant", "a3"), [1, 2, 5], [6], None),
    ]
    assert [(t, k) for t, k, _, _ in samples(spark, turns)] == [([1, 2, 3, 4], [1, 0, 1]), ([1, 2, 5, 6], [0, 0, 1])]
    assert {r for *_, r in samples(spark, turns)} == {0.5}


def test_a_rewritten_answer_replaces_a_short_leaf(spark):
    turns = [([SYS, U1], A1, [1], [2, 2], None), ([SYS, U1, m("assistant", "a1 "), U2], A2, [1, 7, 3], [4], None)]
    assert samples(spark, turns) == [([1, 7, 3, 4], [1], [0.0], 1.0)]
    assert len(samples(spark, turns, threshold=2)) == 2 and len(samples(spark, turns, threshold=0)) == 2


def test_edges_of_sessions(spark):
    assert samples(spark, [([], A1, [1], [2], None), (None, A1, [1], [2], None)]) == []
    assert samples(spark, [([U1], None, [1], [], None)]) == []
    with pytest.raises(Exception, match="differ in length"):
        samples(spark, [([U1], A1, [1], [2, 3], [0.1])])


def test_drift_classes(spark):
    rows = [([1, 2, 3], [1, 2, 3, 4], 1, 5, "clean"), ([1, 2, 3], [1, 2, 9], 1, 5, "realign"), ([1, 2, 3], [1, 2, 9], 1, 2000, "fork"), ([1, 2, 3], [9], 1, 5, "fork"), ([], [9], None, 5, "clean"), ([1], [], None, 5, "fork")]
    df = spark.createDataFrame(rows, "h array<int>, p array<int>, a int, n int, w string")
    assert df.where(trajectories.drift_class(F.col("h"), F.col("p"), F.col("a"), F.col("n")) != F.col("w")).count() == 0


def test_bins_and_loads():
    assert packing.split_bin([0, 1, 2, 3], [5, 4, 3, 2]) == ([0, 3], [1, 2])
    grown = packing.grow_bins([5, 4, 3, 2], 100, 3)
    assert len(set(grown)) == 3 and max(sum(n for n, b in zip([5, 4, 3, 2], grown) if b == k) for k in set(grown)) <= 7
    assert packing.grow_bins([5, 4], 4, 9) == [0, 1]
    assert packing.least_loaded([1, 0, 0], 4) == [1, 2, 0, 1]
    assert packing.greedy_chunks([0, 5], 5) == [0, 1]


def test_grid_and_search(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([100.0, 3.0, -1.0, 0.2])] + [("b", 0, 0.0), ("b", 1, None)], "g string, p int, v double")
    got = {(r.g, r.p): r.tenths for r in weights.grid_weights(rows, "g", "p", "v").collect()}
    assert got == {("a", 0): 50, ("a", 1): 5, ("a", 2): 0, ("a", 3): 0, ("b", 0): 5, ("b", 1): 0}
    cells = [("i", d, p, r, float(v)) for d in (-1, 0, 1) for p, vs in enumerate([(3, -1), (1, -2), (-1, 2)]) for r, v in enumerate(vs)]
    found = search_weights(spark.createDataFrame(cells, "instance string, draw int, pair int, rubric int, value double"), spark.createDataFrame([("i", 0, 10), ("i", 1, 10)], "instance string, rubric int, tenths int"), 2, 3)
    best = {r.rubric: r.tenths for r in found.collect()}
    import numpy as np

    cube = np.array([[[3, -1], [1, -2], [-1, 2]]] * 2, float)
    problem = _Problem(cube, cube[0], np.array([10, 10]))
    every = [np.array([a, b]) for a in (0, *range(5, 51)) for b in (0, *range(5, 51)) if a or b]
    top = max(every, key=problem.score)
    assert problem.score(np.array([best[0], best[1]]))[:3] == problem.score(top)[:3]
    assert problem.score(improve(problem, np.array([10, 10]), 3)) >= problem.score(np.array([10, 10]))
