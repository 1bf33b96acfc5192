import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

from trajlake.llm import mixing
from trajlake.llm.mixing import mix


def check(rows, out, weights, slots, block_rows):
    assert sorted(r.position for r in out) == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in out) == Counter(rows)
    n = Counter(s for _, s in rows)
    want = {s: (weights.get(s, 0) if weights else math.sqrt(c)) for s, c in n.items()}
    total = sum(want.values())
    quota = {s: max(1, math.floor(slots * w / total + 0.5)) if total else 1 for s, w in want.items()}
    blocks = {s: -(-c // block_rows) for s, c in n.items()}
    at = {}
    for r in out:
        assert at.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(at) == list(range(sum(blocks.values())))
    fill = Counter((r.source, r.block) for r in out)
    assert all(c == block_rows or b == blocks[s] - 1 for (s, b), c in fill.items())
    # Ideal share: fluid service in proportion to quota until a source has ended.
    ideal, had = defaultdict(Fraction), Counter()
    for slot in range(len(at)):
        s, b = at[slot]
        assert b == had[s]
        had[s] += 1
        left = Fraction(1)
        while left:
            live = [x for x in quota if ideal[x] < blocks[x]]
            rate = sum(quota[x] for x in live)
            step = min([left, *((blocks[x] - ideal[x]) * Fraction(rate, quota[x]) for x in live)])
            for x in live:
                ideal[x] += step * Fraction(quota[x], rate)
            left -= step
        assert all(abs(ideal[x] - had[x]) < 1 for x in quota)


def test_less_than_one_block_from_the_ideal_share(spark):
    rng = random.Random(1)
    names = ["a", "b", "c", None, "e"]
    rows = [(i, rng.choices(names, [50, 20, 3, 9, 1])[0]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 AS slot", "2 AS s", "3 AS quota")
    for weights, slots, block in ((None, 20, 7), ({"a": 1, "b": 3, "c": 0.5, "x": 9}, 13, 4)):
        check(rows, mix(docs, weights, slots=slots, block_rows=block).collect(), weights, slots, block)


def test_edges(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    check(rows, mix(docs).collect(), None, 200, 64)
    assert mix(docs.limit(0)).count() == 0


def from_exact_share(rows, out, weights, block_rows):
    """The greatest distance of a source from the share of its unrounded weight, in blocks; sources of weight 0 come last."""
    assert sorted(r.position for r in out) == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in out) == Counter(rows)
    n = Counter(s for _, s in rows)
    weight = {s: Fraction(float(weights.get(s, 0)) if weights else math.sqrt(c)) for s, c in n.items()}
    blocks = {s: -(-c // block_rows) for s, c in n.items()}
    at = {r.slot: (r.source, r.block) for r in out}
    assert sorted(at) == list(range(sum(blocks.values())))
    ideal, had, far = defaultdict(Fraction), Counter(), Fraction(0)
    for slot in range(len(at)):
        s, b = at[slot]
        assert b == had[s]
        had[s] += 1
        left = Fraction(1)
        while left:
            live = [x for x in n if ideal[x] < blocks[x]]
            share = {x: weight[x] for x in live if weight[x]} or dict.fromkeys(live, Fraction(1))
            rate = sum(share.values())
            step = min([left, *((blocks[x] - ideal[x]) * rate / w for x, w in share.items())])
            for x, w in share.items():
                ideal[x] += step * w / rate
            left -= step
        far = max([far, *(abs(ideal[x] - had[x]) for x in n)])
    return far


def test_exact_weights_with_more_sources_than_slots(spark, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, source string")
    many = [(i, "hot" if i < 150 else f"s{i % 230}") for i in range(600)]
    weights = {f"s{i}": 0.5 / 230 for i in range(230)} | {"hot": 0.5}
    assert from_exact_share(many, mix(frame(many), weights, block_rows=1).collect(), weights, 1) < 1
    # Jobs of few slots, sources without weight, one of them null.
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 8)
    monkeypatch.setattr(mixing, "EPOCH_SLOTS", 64)
    rng = random.Random(2)
    rows = [(i, rng.choices(["a", "b", "c", None, "e"], [50, 20, 3, 9, 1])[0]) for i in range(900)]
    for w, block in ((None, 4), ({"a": 0.7, "b": 0.1, "c": 0}, 5)):
        assert from_exact_share(rows, mix(frame(rows), w, block_rows=block).collect(), w, block) < 1


def test_blocks_grow_with_the_table_and_weight_zero_comes_last(spark):
    assert [mixing.rows_of_a_block(n) for n in (0, 1, 10**6, 64 * 2**20, 10**10)] == [64, 64, 64, 64, 9537]
    rows = [(i, "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 AS begin", "2 AS gaps", "3 AS rest")
    weights = {"a": 0.9967, "b": 0.0033, "c": 0.0}
    out = mix(docs, weights, block_rows=2).collect()
    assert from_exact_share(rows, out, weights, 2) < 1
    last = {s: max(r.position for r in out if r.source == s) for s in "ab"}
    assert min(r.position for r in out if r.source == "c") > max(last.values())
