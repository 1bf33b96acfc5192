import random
import re
from collections import defaultdict

from trajlake.llm.ngram_jaccard import jaccard_components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 10**18)
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], k)
    return {k: (len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)}


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "Ab", "aB"]
    passage = [rng.choice(vocab) for _ in range(40)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 30, 90, 150]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.75 else [rng.choice(vocab) for _ in range(60)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            words = passage + words
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(2, None), (5, ""), (8, " \t\n"), (11, "one"), (14, "ONE"), (17, "a b"), (20, "x" * 100_000)]


def test_equals_brute_force(spark):
    for seed, n, num, den, count in ((1, 3, 90, 100, 300), (2, 5, 80, 100, 300)):
        rows = corpus(seed, count)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        docs = docs.selectExpr("*", "'z' AS node", "1 AS size", "'t' AS token")
        got = {
            r.doc_id: (r.n_shingles, r.component_id)
            for r in jaccard_components(docs, words=n, num=num, den=den).collect()
        }
        assert got == brute(rows, n, num, den)


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, "q r s"), (4, "totally other words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_components(docs, words=3, num=90, den=100)
    assert sorted((r.doc_id or 0, r.component_id) for r in out.collect()) == [(0, 1), (1, 1), (1, 1), (4, 4), (4, 4)]
    assert jaccard_components(docs.limit(0)).count() == 0
