import random

import pytest

from trajlake.operators.permutation import epoch_places, round_keys
from trajlake.operators.spans import clipped_spans


def by_definition(events):
    """The rules on one trace's list of (ts, kind, span, parent, name)."""
    starts, closed, orphans = {}, [], []
    for ts, kind, span, parent, name in events:
        if kind == "span_start" and span:
            starts.pop(span, None)
            starts[span] = [span, parent or None, name, ts, None]
        elif kind == "span_end":
            if span and span in starts:
                closed.append([*starts.pop(span)[:4], ts])
            else:
                orphans.append((span, parent or None, name, "orphan_end", ts, ts, ts, None))
    every = closed + list(starts.values())
    by_id = {s[0]: s for s in every}
    out = [(*s[:3], "closed_span", s[3], s[4], s[4], None) for s in closed] + orphans
    for span, parent, name, start, _ in starts.values():
        ends = [(max(e[0] for e in events), "row_end")]
        later = [s[3] for s in every if s[1] == parent and s[3] > start]
        if later:
            ends.append((min(later), "next_sibling_start"))
        at, seen = parent, set()
        while at and at in by_id and at not in seen:
            seen.add(at)
            if by_id[at][4] is not None:
                if by_id[at][4] > start:
                    ends.append((by_id[at][4], "ancestor_end"))
                break
            at = by_id[at][1]
        end, why = min(ends, key=lambda x: x[0])
        out.append((span, parent, name, "open_span", start, None, *((end, why) if end > start else (start, "self"))))
    return out


def test_spans_against_definition(spark):
    rng = random.Random(8)
    rows = []
    for trace in range(120):
        names = [f"s{k}" for k in range(7)]
        for ord_ in range(rng.choice([1, 2, 6, 25])):
            kind = rng.choice(["span_start", "span_start", "span_start", "span_end", "event"])
            span = rng.choice([*names, names[0], None, ""])
            parent = rng.choice([*names, None, None, "", "gone"])
            rows.append((trace, ord_, float(ord_ // rng.choice([1, 2])), kind, span, parent, rng.choice("ab")))
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    chain = [(900, k, float(k), "span_start", f"c{k}", f"c{k - 1}" if k else None, "c") for k in range(70)] + [(900, 99, 80.0, "span_end", "c0", None, "c"), (900, 100, 90.0, "event", None, None, "e")]
    cycle = [(901, 0, 0.0, "span_start", "x", "y", "n"), (901, 1, 1.0, "span_start", "y", "x", "n"), (901, 2, 2.0, "event", None, None, "n")]
    rows += chain + cycle
    got = clipped_spans(spark.createDataFrame(rows, "trace long, ord long, ts double, kind string, span string, parent string, name string"))
    want = []
    for trace in {r[0] for r in rows}:
        want += [(trace, *x) for x in by_definition([r[2:] for r in rows if r[0] == trace])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50, 1000])
def test_places_are_dense(spark, n):
    rows = spark.range(n).selectExpr("id * 3 - 5 AS key", "id AS rank_of")
    places = [[r.place for r in epoch_places(rows, "key", 42, e).orderBy("key").collect()] for e in (0, 1, 0)]
    assert sorted(places[0]) == sorted(places[1]) == list(range(n)) and places[0] == places[2]
    if n >= 50:
        assert places[0] != places[1] and places[0] != sorted(places[0])
        # No trend: neighbours lie as far apart as in a random order, about a third of the rows.
        apart = sum(abs(a - b) for a, b in zip(places[0], places[0][1:])) / (n - 1)
        assert 0.25 * n < apart < 0.42 * n
    assert len(set(round_keys(1, 2))) == 8
