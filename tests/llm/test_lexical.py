import math
import random
import re
from collections import Counter

from trajlake.llm import lexical
from trajlake.llm.lexical import lexical_search

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, top):
    held = [(doc, Counter(terms(text))) for doc, text in docs]
    held = [(doc, c) for doc, c in held if c]
    n, size = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in held:
            m = 100 - 75 + (75 * c.total() * n) // size
            parts = (k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if c[t])
            score = sum(parts)
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, k + 1, doc, -score) for k, (score, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def check(spark, docs, items, top=10, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS n", "'x' AS `a.b`").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id", "4 AS rank")
    got = sorted(map(tuple, lexical_search(d, i, top=top, **more).collect()))
    want = brute(docs, items, top)
    assert got == want
    return got


def made(seed, n_docs, vocabulary=400):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["É", "é", "x9"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    docs = [(d, " ".join(rng.choices(vocab, weights, k=rng.choice([0, 1, 8, 40, 200])))) for d in range(n_docs)]
    items = [(k, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 3, 30])))) for k in range(12)]
    docs += [(n_docs + k, f"W1 {items[k][1].upper()} tail") for k in range(6)]
    docs += [(5, docs[5][1]), (6, docs[8][1]), (None, docs[9][1]), (None, None), (n_docs + 90, ""), (n_docs + 91, "w0 " * 60_000)]
    items += [(50, ""), (51, None), (None, "w1"), (3, "w2 w2 w300"), (52, "unknown"), (53, "w0 w0 w0 W0"), (54, items[0][1])]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = made(1, 400)
    check(spark, docs, items)
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", 500)
    monkeypatch.setattr(lexical, "RANGE_BITS", 5)
    monkeypatch.setattr(lexical, "PROBES", 1)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    docs, items = made(2, 900)
    check(spark, docs, items, top=3)


def test_ties_blocks_and_few_documents(spark):
    docs = [(d, "same words here") for d in range(30)] + [(99, "other")]
    got = check(spark, docs, [(1, "same"), (2, "here other")], top=7)
    assert [r[2] for r in got if r[0] == 1] == list(range(7))
    docs, items = made(3, 40)
    check(spark, docs, items, top=60, item_bytes=200)


def test_empty_tables(spark):
    docs, items = made(4, 10)
    check(spark, [], items)
    check(spark, docs, [])
    check(spark, [(1, None), (2, "...")], items)
