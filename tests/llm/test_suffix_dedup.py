import random

from trajlake.llm.suffix_dedup import cut_spans, repeated_spans


def brute(rows, length):
    """Covered word positions of each document."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").lower().split()
        covered = set()
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                covered.update(range(i, i + length))
            seen.add(w)
        if covered:
            out[doc] = covered
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(n)] for n in (51, 60, 120, 300)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randrange(10, 200))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) - 49)
            at = rng.randrange(len(words))
            words[at:at] = p[a : rng.randrange(a + 40, len(p) + 1)] if rng.random() < 0.6 else p
        rows.append((i, " ".join(words)))
    copy = "\n".join(word() for _ in range(80))
    rows += [(200 + i, copy) for i in range(30)] + [(300, copy + " " + copy)]
    return rows + [(400, None), (401, ""), (402, "short"), (403, "again " * 3000)]


def test_spans_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pos", "'k' AS kept").repartition(6)
    got = {}
    for r in repeated_spans(docs).collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
        assert all(k <= r.doc_id for k in r.kept_doc_ids)
    assert got == brute(rows, 50)


def test_cut(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in cut_spans(docs, repeated_spans(docs)).collect()}
    covered = brute(rows, 50)
    assert len(out) == len(rows)
    for doc, text in rows:
        words = (text or "").split()
        left = [w for i, w in enumerate(words) if i not in covered.get(doc, ())]
        assert (out[doc] or "").split() == left
        if doc not in covered:
            assert out[doc] == text
    assert repeated_spans(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a " * 90), (7, "b c d " * 40), (7, "b c d " * 40)], "doc_id long, text string")
    assert {(r.doc_id, r.first_word) for r in repeated_spans(same).collect()} == {(7, 3)}


def test_ids_with_several_texts_and_clashing_columns(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one, 1), (2, one, 2), (2, two, 3), (None, one, 4), (3, None, 5), (3, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `sp.ans` int")
    for clash in ("spans", "Span_Key", "text_key", "first_word"):
        frame = docs.withColumn(clash, docs.doc_id)
        cut = cut_spans(frame, repeated_spans(frame))
        assert cut.columns == frame.columns
        left = {r["sp.ans"]: r.text for r in cut.collect()}
        assert left == {1: one, 2: "", 3: two, 4: one, 5: None, 6: ""}


def test_runs_over_several_partitions(spark):
    """One passage in most documents, more partitions than keys: heads lie in earlier partitions."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"x{rng.random()}" for _ in range(rng.randrange(60))] + passage + [f"y{i}"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in repeated_spans(docs).collect():
            got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
            assert r.kept_doc_ids == [0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, 50)
