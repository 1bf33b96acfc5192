"""Column functions on values chosen by hand."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from trajlake.functions import text, tokens


def test_keyword_tokens_are_counted_by_pattern(spark):
    rows = [(0, "!!! ???"), (1, "a-b c/d"), (2, " ".join("abcdefghijklm")), (3, "+ ".join("abcdefghijkl")), (4, None), (5, "x")]
    df = spark.createDataFrame(rows, "id int, p string")
    got = {r.id: r.k for r in df.select("id", text.clean_keyword(F.col("p"), "http", ["code"]).alias("k")).collect()}
    assert got == {0: None, 1: "a-b c/d", 2: None, 3: "+ ".join("abcdefghijkl"), 4: None, 5: None}


def test_phrase_terms_keep_paths_whole(spark):
    df = spark.createDataFrame([("src/a.py fails", "src x a.py fails"), ("fails at src/a.py", "src/a.py fails")], "p string, v string")
    assert [r[0] for r in df.select(text.phrase_match(F.col("p"), F.col("v"))).collect()] == [False, True]


@pytest.mark.parametrize("algorithm", ["zlib", "gzip", "bz2", "lzma"])
def test_compression(spark, algorithm):
    df = spark.createDataFrame([(0, "ab" * 500), (1, ""), (2, None)], "id int, t string")
    got = {r.id: r.c for r in df.select("id", text.compression(F.col("t"), algorithm, 6).alias("c")).collect()}
    assert got[0].ratio > 5 and math.isclose(got[0].savings, 100 * (1 - 1 / got[0].ratio))
    if algorithm == "zlib":
        assert math.isclose(got[0].ratio, 1000 / len(zlib.compress(b"ab" * 500, 6)))
    assert (got[1].ratio, got[1].savings) == (math.inf, 0.0)
    assert got[2] is None
    with pytest.raises(ValueError):
        text.compression(F.col("t"), "none")


def test_masked_spans(spark):
    rows = [([1, 2, 3, 4], [1, 1, 0, 1]), ([1, 2], [0, 0]), ([], [])]
    df = spark.createDataFrame(rows, "t array<int>, m array<int>")
    got = [r[0] for r in df.select(tokens.masked_spans(F.col("t"), F.col("m"))).collect()]
    assert got == [[[1, 2], [4]], [], []]


def test_dedupe_fold_keeps_first_forms_of_many_lines(spark):
    import time

    from pyspark.sql import functions as F

    from trajlake.functions.text import dedupe_fold

    lines = [" B ", "a", "", "b", "A ", "  ", "É", "é", None, "c"]
    rows = spark.createDataFrame([(lines,), ([],), (None,)], "x array<string>")
    assert [r[0] for r in rows.select(dedupe_fold("x")).collect()] == [["B", "a", "É", "c"], [], None]
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("Line "), (i % 15_000).cast("string"))).alias("x"))
    many.select(F.size(dedupe_fold("x"))).collect()
    began = time.time()
    assert many.select(F.size(dedupe_fold("x"))).first()[0] == 15_000
    assert time.time() - began < 5
