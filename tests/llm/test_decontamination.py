import random
import re

from trajlake.llm.decontamination import contamination, longest_matches, remove_contaminated

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if n and item is not None else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[k : k + n]:
                        hit.update(range(i, i + n))
                        named.add(str(item))
        spans = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [i + 1 for i in sorted(hit) if i + 1 not in hit]
        out.append((doc, len(w), [(a, b - a) for a, b in zip(spans, ends)] or None, sorted(named) or None))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_words, r.spans and [tuple(s) for s in r.spans], r["items"]) for r in rows), key=repr)


def made(seed, n_docs=60, n_items=14):
    rng = random.Random(seed)
    vocab = ["ab", "Cd", "e9", "éa", "ÉA", "x", "yy", "no"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(n_items)]
    items += [(3, items[5][1]), (77, items[5][1]), (None, items[6][1]), (78, None), (79, ""), (100, "single")]
    docs = []
    for d in range(n_docs):
        w = rng.choices([*vocab, "un", "known"], k=rng.choice([0, 2, 9, 10, 80]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = rng.choice(items)[1] or ""
            p = rng.randrange(len(w) + 1)
            w[p:p] = v.split()[rng.choice([0, 0, 1]) :]
        docs.append((d, rng.choice([" ", ", ", "\n-"]).join(w)))
    docs += [(None, items[5][1]), (None, None), (7, docs[7][1]), (8, ""), (9, docs[9][1] + " single")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS spans", "2 AS `a.b`")
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")


def test_equals_brute_force(spark):
    for seed in range(4):
        docs, items = made(seed)
        d, i = frames(spark, docs, items)
        want = brute(docs, items)
        assert found(contamination(d, i)) == want
        # Items in several blocks: passes merged by document, repeated rows kept apart.
        assert found(contamination(d, i, item_bytes=100)) == want
        kept = sorted((r.doc_id, r.text) for r in remove_contaminated(d.where("doc_id is not null"), i, item_bytes=300).collect())
        clean = [x for x in docs if x[0] is not None and brute([x], items)[0][2] is None]
        assert kept == sorted((a, b) for a, b in clean if b is not None)
    assert remove_contaminated(d, i).columns == d.columns


def test_longest_matches(spark):
    docs, items = made(11, 40, 8)
    d, i = frames(spark, docs, items)
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in longest_matches(d, i, least=3).collect()}
    want = {}
    for item, body in items:
        v = words(body)
        for k in range(len(v) if item is not None else 0):
            best = (0, 0, 0)
            for doc, text in docs:
                w = words(text)
                for p in range(len(w) if doc is not None else 0):
                    n = 0
                    while k + n < len(v) and p + n < len(w) and v[k + n] == w[p + n]:
                        n += 1
                    best = min(best, (-n, doc, p))
            if -best[0] >= 3:
                key = (str(item), k)
                want[key] = min(want.get(key, (0, 0, 0)), best)
    assert {k: v[0] for k, v in got.items()} == {k: -v[0] for k, v in want.items()}
    for (item, k), (n, doc, p) in got.items():
        bodies = [words(b)[k : k + n] for x, b in items if str(x) == item]
        assert any(words(t)[p : p + n] in bodies for x, t in docs if x == doc)


def test_empty_tables_and_long_text(spark):
    docs, items = made(5)
    d, i = frames(spark, docs, items)
    assert found(contamination(d, i.limit(0))) == brute(docs, [])
    assert contamination(d.limit(0), i).count() == 0 and longest_matches(d, i.limit(0)).count() == 0
    long = [(1, "filler words " * 100_000 + items[5][1] + " tail" * 9), (2, (items[5][1] + " ") * 2000)]
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "filler words filler words")]
    long.append((3, "x " * 50_000 + "ONE two, three-four five six seven eight nine ten eleven twelve"))
    d, i = frames(spark, long, items)
    got = found(contamination(d, i))
    assert got[0] == (1, len(words(long[0][1])), [(0, 200_000)], ["2"])
    assert got[1][2:] == (None, None) and got[2] == (3, 50_012, [(50_000, 11)], ["1"])
