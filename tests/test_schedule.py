import random

import pytest

from trajlake.operators.packing import largest_differencing, split_heaviest
from trajlake.operators.schedule import Plan, dealt, micro_batches, schedule


def differencing_by_definition(lengths, bins, equal):
    """The same rule over plain lists: of all partitions the widest two, ties by the greatest largest part."""
    ranked = sorted((n, i) for i, n in enumerate(lengths))
    width = bins if equal else 1
    states = []
    for at in range(0, len(ranked), width):
        states.append(sorted([[n, 1, [(i, n)]] for n, i in ranked[at : at + width]] + [[0, 0, []] for _ in range(bins - width)], reverse=True))
    while len(states) > 1:
        pick = []
        for _ in range(2):
            best = max(range(len(states)), key=lambda k: (states[k][0][0] - states[k][-1][0], states[k][0]))
            pick.append(states.pop(best))
        a, b = pick
        states.append(sorted(([x[0] + y[0], x[1] + y[1], x[2] + y[2]] for x, y in zip(a, b[::-1], strict=True)), reverse=True))
    return [sorted(i for i, _ in part[2]) for part in states[0]]


def bins_of(numbers, bins):
    return [[i for i, b in enumerate(numbers) if b == k] for k in range(bins)]


def test_differencing_with_many_equal_lengths():
    rng = random.Random(1)
    for _ in range(200):
        bins = rng.choice([1, 2, 3, 5])
        equal = rng.random() < 0.5
        n = rng.randrange(1, 6) * bins if equal else rng.randrange(1, 25)
        lengths = [rng.choice([1, 2, 2, 3, 7]) for _ in range(n)]
        assert bins_of(largest_differencing(lengths, bins, equal), bins) == differencing_by_definition(lengths, bins, equal)
    with pytest.raises(ValueError):
        largest_differencing([1, 2, 3], 2, equal_size=True)


def test_micro_batches():
    assert micro_batches([15, 3, 3, 3, 3, 3, 3, 3], [1.0] * 8, Plan(8, 2, tokens=10)) == [[0], [1, 2, 3], [4, 5, 6], [7]]
    assert micro_batches([5] * 8, [1.0] * 8, Plan(8, 2, tokens=10)) == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert split_heaviest([[0, 1, 2]], [5, 1, 1], 5) == [[0], [1], [2]]
    with pytest.raises(ValueError):
        micro_batches([1] * 6, [1.0] * 6, Plan(6, 4, samples=1))
    with pytest.raises(ValueError):
        micro_batches([1] * 3, [1.0] * 3, Plan(3, 4, tokens=9))
    assert dealt([[0], [1], [2], [3]], [1.0, 2.0, 3.0, 4.0], Plan(4, 2, samples=1)) == [[0, 2], [1, 3]]
    assert sorted(map(sorted, dealt([[0], [1], [2], [3]], [1.0, 2.0, 3.0, 4.0], Plan(4, 2, samples=1, balance_ranks=True)))) == [[0, 3], [1, 2]]
    for bad in ({}, {"tokens": 1, "samples": 1}, {"tokens": 0}):
        with pytest.raises(ValueError):
            Plan(1, 1, **bad)


@pytest.mark.parametrize("plan", [Plan(10, 2, tokens=50), Plan(10, 3, tokens=50, together=2, balance_ranks=True), Plan(8, 2, tokens=40, balance_bins=True), Plan(6, 2, samples=3)])
def test_invariants(spark, plan):
    rng = random.Random(plan.rollouts * 7 + plan.ranks)
    per = 1 if plan.samples else None
    rows, sample = [], 0
    for rollout in rng.sample(range(1000), 43):
        for _ in range(per or rng.choice([1, 2, 3])):
            rows.append((sample, rollout, rng.choice([1, 5, 20, 30, 70])))
            sample += 1
    rng.shuffle(rows)
    got = schedule(spark.createDataFrame(rows, "sample long, rollout long, length long"), plan, "sample", "rollout", "length").collect()
    length, rollout = {s: n for s, _, n in rows}, {s: r for s, r, _ in rows}
    order = list(dict.fromkeys(rollout[s] for s in sorted(rollout)))
    kept = {r: k // plan.rollouts for k, r in enumerate(order) if k // plan.rollouts < 43 // plan.rollouts}
    assert {r.sample: r.step for r in got} == {s: kept[x] for s, x in rollout.items() if x in kept} and len(got) == len({r.sample for r in got})
    for rank in range(plan.ranks):
        own = sorted((r.place, r.micro_batch, r.step, r.sample) for r in got if r["rank"] == rank)
        assert [p for p, *_ in own] == list(range(len(own)))
        micros = [m for _, m, *_ in own]
        assert micros == sorted(micros) and set(micros) == set(range(max(micros) + 1))
        for step in set(kept.values()):
            count = {q: len({r.micro_batch for r in got if r["rank"] == q and r.step == step}) for q in range(plan.ranks)}
            assert len(set(count.values())) == 1 and count[0] % plan.together == 0
        for m in set(micros):
            members = [s for _, k, _, s in own if k == m]
            assert plan.samples is None or len(members) <= plan.samples
            if plan.tokens and not plan.balance_bins:
                assert len(members) == 1 or sum(length[s] for s in members) <= plan.tokens
