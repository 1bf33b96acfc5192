import random

import corpus_pipeline
from trajlake.llm.bpe import default_path
from trajlake.llm.common import read, scratch
from trajlake.llm.mixing import mix
from trajlake.llm.quality import op10_quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch(stage(spark, docs, SF), "t")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.count() == len(kept[-1])
        if k < 4:
            assert docs.columns == columns
    good = {r.doc_id for r in op10_quality(spark, SF).where("predicted = 1").collect()}
    assert kept[0] == good and len(good) < before
    assert kept[1] < kept[0] and kept[1] == kept[2] == kept[3] == kept[4]
    assert all(r.n_tokens == len(r.ids) for r in docs.collect())


def test_rows_end_in_the_order_of_the_mix(spark):
    docs = scratch(read(spark, SF, "documents").repartition(5), "t")
    want = {r.doc_id: r.position for r in mix(docs).collect()}
    mixed = scratch(corpus_pipeline.mixing(spark, docs, SF).repartition(3), "t")
    got = corpus_pipeline.encoding(spark, mixed, SF).collect()
    assert [r.position for r in got] == list(range(len(want)))
    assert {r.doc_id: r.position for r in got} == want


def corpus():
    """Rows with nulls, empty texts, repeated rows and ids, near copies and shared passages."""
    rng = random.Random(3)
    word = lambda: rng.choice("ka lo mi ne su ta vo wi".split()) + rng.choice("bel dor fin gast hum".split()) + str(rng.randrange(90))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, passage = [], text(70)
    for i in range(40):
        words = text(rng.randrange(5, 160)).split()
        if i % 5 == 0:
            words[3:3] = passage.split()
        rows.append((i, " ".join(words), "en", rng.choice(["web", "book", None]), 0))
    near = text(200).split()
    for i in range(40, 46):
        near[rng.randrange(200)] = word()
        rows.append((i, " ".join(near), "en", "web", 0))
    rows += [(50, None, None, None, None), (51, "", "de", "web", 0), (None, rows[0][1], "en", "web", 0), rows[3], rows[3]]
    rows += [(60, rows[2][1], "en", "web", 0), (60, "an other text of the same id", "en", "book", 0)]
    return rows


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["id", "key", "Spans", "position", "score", "of", "c0", "node", "token", "block", "a.b"]


def frame(spark, rows):
    out = spark.createDataFrame(rows, SHAPE).repartition(3)
    return out.toDF("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *(f"doc_id AS `{c}`" for c in CLASHES))


def bag(rows):
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF)
    assert got.columns[5:] == CLASHES

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    want = [r for r, g in zip(rows, group) if r[0] is None or r[0] == least[g]]
    assert bag(got.collect()) == bag(want) and len(want) < len(rows) - 5


def test_repeated_passages_against_brute_force(spark):
    rows = corpus()
    got = corpus_pipeline.repeated_passages(spark, frame(spark, rows), SF)
    assert got.columns[5:] == CLASHES
    seen, left = set(), {}
    import pyspark.sql.functions as F

    keys = {(r.doc_id, r.text): r.k for r in spark.createDataFrame(rows, SHAPE).select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}, key=lambda x: (x[0], keys[x])):
        w, gone = text.split(), set()
        for i in range(len(w) - 49):
            if tuple(w[i : i + 50]) in seen:
                gone.update(range(i, i + 50))
            seen.add(tuple(w[i : i + 50]))
        left[doc, text] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
    want = []
    for doc, text, lang, source, n in rows:
        new = left.get((doc, text), text)
        want.append((doc, new, lang, source, n if text is None else len(new)))
    strip = lambda b: sorted(((d, t and t.strip(), x, s) for d, t, x, s, _ in b), key=repr)
    assert strip(bag(got.collect())) == strip(want)
    assert any(new != text for (_, text), new in left.items())


def test_quality_mixing_and_encoding_keep_rows_and_columns(spark):
    from tokenizers import Tokenizer

    rows = corpus()
    docs = frame(spark, rows)
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns and set(bag(kept.collect())) <= set(bag(rows))
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and bag(mixed.collect()) == bag(rows)
    coder = Tokenizer.from_file(default_path())
    coder.no_truncation(), coder.no_padding()
    out = corpus_pipeline.encoding(spark, docs, SF).collect()
    ids = sorted((r.doc_id, list(r.ids)) for r in out if r.doc_id is not None)
    assert ids == sorted((r[0], coder.encode(r[1] or "", add_special_tokens=False).ids) for r in rows if r[0] is not None)
    places = {(d, s): [r.position for r in out if (r.doc_id, r.source) == (d, s)] for d, _, _, s, _ in rows}
    assert all(len(set(p)) == 1 for p in places.values()) and len({p[0] for p in places.values()}) == len(places)
    assert [r.position for r in out] == sorted(r.position for r in out)


def test_stages_of_an_empty_table(spark):
    docs = frame(spark, corpus()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
