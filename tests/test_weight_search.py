import itertools

import numpy as np
import pytest

from trajlake.operators import weight_search as ws
from trajlake.operators.weight_search import _GRID, _Problem, improve, panel, starts


def made(seed, draws=10, pairs=30, rubrics=3):
    rng = np.random.default_rng(seed)
    nominal = rng.integers(-4, 5, (pairs, rubrics)).astype(float)
    return _Problem(nominal[None] + rng.integers(-1, 2, (draws, pairs, rubrics)), nominal, np.full(rubrics, 10))


def plain_key(problem, w):
    """The objective from its definition, pair by pair."""
    drawn, nominal = np.moveaxis(problem.drawn, 0, 2), problem.nominal.T
    right = [sum(float(cell @ w) > 0 for cell in draw) for draw in drawn]
    margins = [float(row @ w) for row in nominal]
    on = w[w > 0]
    return (sum(right), sum(sorted(right)[: -(-len(right) // 10)]), sum(m > 0 for m in margins), round(sum(margins) / max(w.sum(), 1), 12), -len(on), on.min() / w.max(), -round(float(np.abs(w / w.sum() - problem.base).sum()), 12))


def test_incremental_margins_and_moves(monkeypatch):
    monkeypatch.setattr(ws, "BLOCK", 700)
    for seed in range(6):
        problem = made(seed)
        w = np.array([10, 0, 25])
        for r in range(3):
            best = problem.column(w, problem.margins(w), r, _GRID[1:])
            every = [np.array([*w[:r], t, *w[r + 1 :]]) for t in _GRID[1:]]
            assert best[0] == max((*plain_key(problem, v), *(-v)) for v in every) and tuple(best[1]) == tuple(max(every, key=problem.score))
        swap = problem.best_of(w, problem.margins(w), [{0: 0, 1: 20}, {2: 0, 1: 5}])
        assert swap[0] == max(problem.score(np.array(v)) for v in ([0, 20, 25], [10, 5, 0]))


def test_no_single_move_or_swap_is_better():
    for seed in range(8):
        problem = made(seed, rubrics=4)
        w = improve(problem, np.array([10, 10, 10, 10]), 50, active=2 if seed % 2 else 6, swaps=50) if seed % 2 == 0 else improve(problem, np.array([10, 10, 0, 0]), 50, active=2, swaps=50)
        limit = 2 if seed % 2 else 6
        value = problem.key(w)
        assert 0 < (w > 0).sum() <= limit
        swaps = [{on: 0, off: t} for on in np.flatnonzero(w > 0) for off in np.flatnonzero(w == 0) for t in ws.SWAPPED]
        for move in swaps:
            v = w.copy()
            for r, t in move.items():
                v[r] = t
            assert problem.key(v) <= value


def test_against_the_whole_grid():
    hits = 0
    for seed in range(10):
        problem = made(seed, pairs=12, rubrics=2)
        found = max((improve(problem, w, 5) for w in starts(problem, np.array([10, 10]), 6, seed)), key=problem.score)
        top = max((np.array(v) for v in itertools.product(_GRID, _GRID) if any(v)), key=problem.score)
        assert problem.key(found)[0] >= 0.97 * problem.key(top)[0]
        hits += problem.key(found)[0] == problem.key(top)[0]
    assert hits >= 8


def test_panel_is_balanced(spark):
    raw = spark.createDataFrame([("i", 0, 0, 1, [3, 3, 1], [2, 5]), ("i", 0, 1, -1, [4], [4, 4])], "instance string, pair int, rubric int, sign int, left array<int>, right array<int>")
    rows = panel(raw, 20, 3).collect()
    assert len(rows) == 2 * 21
    nominal = {r.rubric: r.value for r in rows if r.draw == -1}
    assert nominal == {0: pytest.approx(7 / 3 - 3.5), 1: pytest.approx(0)}
    one = spark.createDataFrame([("i", p, 0, 1, [3], [9]) for p in range(5)], "instance string, pair int, rubric int, sign int, left array<int>, right array<int>")
    for p in range(5):
        moved = sorted(r.value + 5 - 3 for r in panel(one.where(f"pair = {p}"), 20, 3).collect() if r.draw >= 0)
        assert moved == [-1.0] * 2 + [0.0] * 16 + [1.0] * 2
    assert sorted(map(tuple, panel(raw, 20, 3).collect())) == sorted(map(tuple, rows)) != sorted(map(tuple, panel(raw, 20, 4).collect()))
    with pytest.raises(ValueError):
        panel(raw, 15, 3)


def test_search_draws_the_panel_in_the_instance_s_task(spark):
    rng = np.random.default_rng(5)
    rows = [(i, p, r, int(rng.choice([-1, 1])), rng.integers(1, 6, 2).tolist(), rng.integers(1, 6, 1 + p % 2).tolist()) for i in (7, 12) for p in range(9) for r in range(3)]
    rows.append((7, 99, 0, 1, [], [2]))
    raw = spark.createDataFrame(rows, "instance long, pair int, rubric int, sign int, left array<int>, right array<int>")
    base = spark.createDataFrame([(i, r, 10) for i in (7, 12) for r in range(3)], "instance long, rubric int, tenths int")
    out = ws.search_weights(raw, base, 10, 3, 2, 2)
    # Raw scores go through the exchange, not ten draws of each.
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.instance, r.rubric): r.tenths for r in out.collect()}
    cells = panel(raw, 10, 3).collect()
    for i in (7, 12):
        cube = np.zeros((11, 9, 3))
        for c in cells:
            if c.instance == i:
                cube[c.draw + 1, c.pair, c.rubric] = c.value
        problem = _Problem(cube[1:], cube[0], np.full(3, 10))
        begins = sorted(starts(problem, np.full(3, 10), 2, 20260814), key=problem.key, reverse=True)[:4]
        best = max((improve(problem, w, 2) for w in begins), key=problem.score)
        assert [got[str(i), r] for r in range(3)] == best.tolist()


def test_weights_of_a_column_are_told_apart_by_their_counts(monkeypatch):
    """Signs of margins that are rounded, without margins of all weights or keys of any but the best."""
    monkeypatch.setattr(ws, "BLOCK", 40)
    keys = []
    plain = _Problem._key
    monkeypatch.setattr(_Problem, "_key", lambda self, *args: keys.append(0) or plain(self, *args))
    rng = np.random.default_rng(3)
    asked = 0
    for trial in range(20):
        drawn = rng.integers(-4, 5, (10, 40, 3)) / rng.choice([1, 2, 3, 7])
        problem = _Problem(drawn, drawn[0] * (trial % 2), np.full(3, 10))
        w = rng.choice(_GRID, 3)
        held = problem.margins(w)
        for r in range(3):
            for values in (_GRID, _GRID[1:], _GRID[:1]):
                if not any(np.delete(w, r)) and 0 in values:
                    continue
                want = problem.best_of(w, held, [{r: int(t)} for t in values])
                keys.clear()
                got = problem.column(w, held, r, values)
                asked += len(keys) * (len(values) > 1)
                assert got[0] == want[0] and tuple(got[1]) == tuple(want[1])
    assert asked < 20 * 3 * 2 * 12
