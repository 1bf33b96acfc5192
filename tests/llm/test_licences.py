import re
import textwrap

from trajlake.llm.licences import HOLDER, TEMPLATES, scan_licences


def grams(text):
    w = re.findall(r"[^\W_]+", re.sub(HOLDER, "", text or "").lower())
    return set(zip(w[:-1], w[1:]))


def brute(rows):
    out = set()
    for doc, text in rows:
        units = list(enumerate((text or "").split("\n"))) + ([(-1, text)] if "\n" in (text or "") else [])
        for line, unit in units:
            g = grams(unit)
            found = []
            for name, t in TEMPLATES.items():
                h = grams(t)
                if g and 10 * 2 * len(g & h) >= 8 * (len(g) + len(h)):
                    found.append((-2 * len(g & h) / (len(g) + len(h)), name))
            if found:
                out.add((doc, line, min(found)[1]))
    return out


def test_equals_brute_force(spark):
    t = list(TEMPLATES.values())
    rows = [(i, f"some words here\n{x}\nthe end of it") for i, x in enumerate(t)]
    rows += [(100 + i, " ".join(x.split()[j:])) for i, x in enumerate(t) for j in (1, 2, 3)]
    rows += [(200 + i, x.upper().replace(" ", " -- ")) for i, x in enumerate(t)]
    rows += [(300 + i, "\n".join(x.split(" "))) for i, x in enumerate(t)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "license " * 50000), (404, t[0] + " " + t[1]), (405, "Éa bé\n" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS line", "'x' AS best")
    assert {(r.doc_id, r.line, r.licence) for r in scan_licences(docs).collect()} == brute(rows)
    assert scan_licences(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, t[0]), (None, t[0])], "doc_id long, text string")
    assert scan_licences(twice).count() == 2


def test_long_texts_of_few_bigrams(spark):
    text = TEMPLATES["MIT-text"]
    wrapped = "\n".join(textwrap.wrap(text, 80))
    rows = [(1, "\n".join([text] * 20)), (2, wrapped + ("\n" + "=" * 80) * 110), (3, "\n".join([wrapped] * 15)), (4, wrapped + "\nword" * 5000)]
    assert all(len(x) > 7680 for _, x in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line, r.licence) for r in scan_licences(docs).collect()}
    assert got == brute(rows) and {(i, -1, "MIT-text") for i in (1, 2, 3, 4)} <= got


def test_lines_of_holders_and_long_texts(spark):
    head = "Copyright (c) 2019 Some Holder and Others of a Long Name\n# Copyright 2020, 2021 the authors of this very long list\n"
    mit = "\n".join(textwrap.wrap(TEMPLATES["MIT-text"], 70))
    rows = [(1, head + mit), (2, head * 30 + mit), (3, "\n".join([TEMPLATES["MIT-text"]] * 40)), (4, "word one two\n" * 8000), (5, mit + "\n" + "filler text\n" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line, r.licence) for r in scan_licences(docs).collect()}
    assert got == brute(rows) and {(i, -1, "MIT-text") for i in (1, 2, 3, 5)} <= got
