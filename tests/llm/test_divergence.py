import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from trajlake.llm import divergence
from trajlake.llm.divergence import _share, source_divergence

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    groups, docs, uses = set(), defaultdict(set), defaultdict(Counter)
    for k, row in enumerate(rows):
        lang, source, text = (x or "" for x in row)
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(FOLD)):
            docs[lang, term].add(k)
            uses[lang, source][term] += 1
    kept = defaultdict(list)
    for (lang, term), held in docs.items():
        if len(held) >= 3:
            kept[lang].append(term)
    out = []
    for lang, source in groups:
        terms = kept[lang]

        def shares(counts, terms=terms):
            n = sum(counts[t] for t in terms)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(terms)) for t in terms}

        p = shares(uses[lang, source])
        q = shares(sum((uses[g] for g in groups if g[0] == lang), Counter()))
        pair = []
        for lang2, other in groups:
            if lang2 == lang and other != source:
                r = shares(uses[lang2, other])
                pair.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in terms), other.encode()))
        term = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in terms if uses[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
            out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def check(spark, rows, top=200):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "'z' AS uses", "2 AS `a.b`")
    assert sorted(map(tuple, source_divergence(df, top=top).collect())) == brute(rows, top)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COUNT_BYTES", 300)
    rng = random.Random(3)
    vocab = ["the", "The", "é", "É", "naïve", "a", "b1c", "ab", "日本", "x", "y", "z", "𝒳", "ü"]
    rows = []
    for _ in range(150):
        w = rng.choices(vocab, weights=range(1, len(vocab) + 1), k=rng.choice([0, 1, 5, 60]))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "ß", None]), rng.choice([" ", "1", "-\n"]).join(w)))
    rows += [("xx", "a", "only once"), ("xx", "b", None), ("xx", "c", ""), ("yy", "one", "w w w"), ("en", "none", None), rows[0], rows[0], ("fr", "h", "mot " * 40_000)]
    rows += [("fr", "i", "mot un"), ("fr", "j", "un mot"), ("fr", "j", "un")]
    check(spark, rows)
    check(spark, rows, top=2)


def test_empty_and_ties(spark):
    check(spark, [])
    check(spark, [("en", s, "b a c") for s in "xyzw"] + [("en", "v", "A a a")])


def test_large_counts(spark):
    counts = [0, 5, 8_999_999_999, 9_000_000_000, 800_000_000_000]
    df = spark.createDataFrame([(c,) for c in counts], "c long")
    got = [r[0] for r in df.select(_share(F.col("c"), F.lit(16_000_000_000_123))).collect()]
    assert got == [1 + 1_000_000_000 * (c + 1) // 16_000_000_000_123 for c in counts]
