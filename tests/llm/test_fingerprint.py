import hashlib
import random

from pyspark.sql import functions as F

from trajlake.llm.fingerprint import K, containment, distinct_shingles, fingerprints, merge_parts, resemblance, sketch


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(seed=2):
    rng = random.Random(seed)
    rows = [(i * 7 % 211 + 10**10, " ".join(rng.choice("ab cd ef gh éé zz").strip() or "x" + str(rng.randrange(90)) for _ in range(rng.choice([0, 2, 5, 60, 400])))) for i in range(211)]
    return rows + [(1, None), (2, ""), (3, "one two"), (4, " \t"), (5, "w " * 3000)]


def test_contract_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS sketch").repartition(7)
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        for other, near in ((b, r.near_edited), (c, r.near_next)):
            true = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(near - true) < (1e-12 if len(a | other) <= K else 0.2)
        assert (r.fingerprint == r.edited_fingerprint) == (a == b) or len(a | b) > K
        assert len(r.fingerprint) == 16 * min(K, len(a))


def test_merge_and_estimates(spark):
    words = [f"t{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1500:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        sketch(F.col("a"), 1024).alias("x"), sketch(F.col("b"), 1024).alias("y")
    )
    e = row.select(
        resemblance(F.col("x"), F.col("y"), 1024).alias("r"), containment(F.col("x"), F.col("y"), 1024).alias("c"),
        distinct_shingles(F.col("x"), 1024).alias("n"),
    ).first()
    assert abs(e.r - 1496 / 3996) < 0.06 and abs(e.c - 1496 / 2996) < 0.1 and abs(e.n / 2996 - 1) < 0.12
    parts = spark.createDataFrame([("k", a), ("k", b), ("e", ""), (None, "p q")], "k string, t string")
    parts = parts.select("k", sketch(F.col("t")).alias("s"))
    merged = {r.k: r.s for r in merge_parts(parts, "k", "s").collect()}
    whole = spark.createDataFrame([(a + " " + b,)], "t string").select(sketch(F.col("t"), 10**6).alias("s")).first().s
    assert merged["e"] == [] and len(merged[None]) == 1 and len(merged["k"]) == K
    assert set(merged["k"]) <= set(whole)


def test_small_tables(spark):
    one = spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")
    r = fingerprints(one).first()
    assert r.near_next == 1.0
    same = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "x"), (None, None)], "doc_id long, text string")
    assert fingerprints(same).count() == 4
    assert fingerprints(one.limit(0)).count() == 0
