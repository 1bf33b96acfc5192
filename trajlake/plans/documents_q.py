"""JSON documents, observations, repetition and weight search over pages, documents and lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import documents as j
from ..functions.text import compression
from ..operators import weight_search
from .groups_q import _t

_C = F.col


def _page(spark, d):
    doc = F.to_json(F.struct("url", "page_id", F.array(F.struct(F.lit("x\ny").alias("b")), F.struct(F.lit("t").alias("b"))).alias("list"), F.lit("").alias("none")))
    return _t(spark, d, "pages").select("page_id", doc.alias("doc"))


def stable_ids(spark, d):
    return _page(spark, d).select("page_id", j.stable_id(_C("doc")).alias("key"))


def flat_texts(spark, d):
    return _page(spark, d).select("page_id", j.text_values(_C("doc")).alias("text"))


def markdown_texts(spark, d):
    return _page(spark, d).select("page_id", j.compact_markdown(_C("doc")).alias("text"))


def name_lists(spark, d):
    n = _C("p_size").cast("string")
    text = F.when(_C("p_partkey") % 4 == 0, F.concat(F.lit('["a", '), n, F.lit("]"))).when(_C("p_partkey") % 4 == 1, F.concat(F.lit("('t', "), n, F.lit(", '')"))).when(_C("p_partkey") % 4 == 2, F.concat(F.lit("  test::"), n, F.lit(" ")))
    return _t(spark, d, "part").select("p_partkey", F.array_join(j.test_names(text), "|").alias("names"))


def whole_objects(spark, d):
    n = _C("p_size").cast("string")
    text = F.when(_C("p_partkey") % 3 == 0, F.concat(F.lit("say {x} {{\"b\": "), n, F.lit(", \"a\": {}}}"))).when(_C("p_partkey") % 3 == 1, F.concat(F.lit("{\"a\": "), n, F.lit("} then"))).otherwise("{broken")
    return _t(spark, d, "part").select("p_partkey", j.whole_json(text).alias("found"))


def short_observations(spark, d):
    text = F.concat(F.when(_C("doc_id") % 3 == 0, F.concat(F.lit("<exception>"), F.substring("text", 1, 90), F.lit("</exception>\n"))).otherwise(""), F.lit("<returncode> 1 </returncode>\n<output>\n"), "text", F.lit("</output>"))
    out = j.short_observation(F.when(_C("doc_id") % 5 > 0, text).otherwise(_C("text")))
    return _t(spark, d, "documents").select("doc_id", F.length(out).alias("n"), (F.length(out) <= 512).alias("fits"))


def repetition_flags(spark, d):
    """Texts above 10,000 characters whose last 10,000 compress more than tenfold; shorter ones aren't compressed."""
    tail = F.when(F.length("text") > 10000, F.right("text", F.lit(10000)))
    rows = _t(spark, d, "documents").select("doc_id", compression(tail)["ratio"].alias("r"))
    return rows.select("doc_id", F.coalesce(_C("r") > 10, F.lit(False)).alias("repeats"))


def _raw_scores(spark, d):
    """Pairs of neighbouring lines of a supplier under four rubrics: two scores a side from price, tax, discount and quantity."""
    score = lambda c: (F.floor(c) % 5 + 1).cast("int")
    rows = _t(spark, d, "lineitem")
    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    kinds = ["l_quantity", "l_extendedprice", "l_discount * 100", "l_tax * 100"]
    own = rows.select("l_suppkey", F.row_number().over(by).alias("pair"), *(F.array(score(F.expr(e)), score(F.expr(f"({e}) / 2"))).alias(f"k{k}") for k, e in enumerate(kinds)))
    ahead = Window.partitionBy("l_suppkey").orderBy("pair")
    both = own.select("*", *(F.lead(f"k{k}").over(ahead).alias(f"n{k}") for k in range(4))).where("n0 is not null")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rubric"), F.col(f"k{k}").alias("left"), F.col(f"n{k}").alias("right")) for k in range(4)))).alias("x")
    return both.select(_C("l_suppkey").alias("instance"), "pair", each, F.when(_C("pair") % 2 == 0, 1).otherwise(-1).alias("sign")).select("instance", "pair", "sign", "x.*")


def panel_draws(spark, d):
    """Every score keeps its place in the panel: as many draws lower as higher, nominal values from the scores."""
    raw = _raw_scores(spark, d)
    rows = weight_search.panel(raw, 10, 7)
    return rows.groupBy("instance").agg(F.count("*").alias("cells"), F.round(F.sum(F.when(_C("draw") == -1, _C("value"))), 6).alias("nominal"))


def searched_weights(spark, d):
    """Weights of four rubrics for each supplier over all of its lines."""
    some = _t(spark, d, "lineitem").groupBy(_C("l_suppkey").alias("instance")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    base = some.select("instance", F.explode(F.array(*map(F.lit, range(4)))).alias("rubric"), F.lit(10).alias("tenths"))
    return weight_search.search_weights(_raw_scores(spark, d), base, 10, 7, 2, 2)


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "panel_draws": """WITH o AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS pair, [[1 + floor(l_quantity) % 5, 1 + floor(l_quantity / 2) % 5], [1 + floor(l_extendedprice) % 5, 1 + floor(l_extendedprice / 2) % 5],
  [1 + floor(l_discount * 100) % 5, 1 + floor(l_discount * 100 / 2) % 5], [1 + floor(l_tax * 100) % 5, 1 + floor(l_tax * 100 / 2) % 5]] AS k FROM lineitem),
b AS (SELECT l_suppkey, pair, k, lead(k) OVER (PARTITION BY l_suppkey ORDER BY pair) AS n FROM o)
SELECT l_suppkey AS instance, 44 * count(*) AS cells, round(sum(CASE WHEN pair % 2 = 0 THEN 1 ELSE -1 END * (list_sum(list_transform(k, lambda x: list_sum(x) / 2)) - list_sum(list_transform(n, lambda x: list_sum(x) / 2)))), 6) AS nominal FROM b WHERE n IS NOT NULL GROUP BY 1""",
    "stable_ids": """SELECT page_id, sha256('{"list":[{"b":"x\\ny"},{"b":"t"}],"none":"","page_id":' || page_id || CASE WHEN url IS NULL THEN '' ELSE ',"url":' || to_json(url) END || '}') AS key FROM pages""",
    "flat_texts": "SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN '' ELSE 'url: ' || url || chr(10) END || 'page_id: ' || page_id || chr(10) || 'list: b: x' || chr(10) || 'y' || chr(10) || 'b: t' AS text FROM pages",
    "markdown_texts": "SELECT page_id, '- **url**: ' || url || chr(10) || '- **page_id**: ' || page_id || chr(10) || '- **list**:' || chr(10) || '  -' || chr(10) || '    - **b**:' || chr(10) || '      x' || chr(10) || '      y' || chr(10) || '  -' || chr(10) || '    - **b**: t' || chr(10) || '- **none**: ' AS text FROM pages",
    "name_lists": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a|' || p_size WHEN 1 THEN 't|' || p_size WHEN 2 THEN 'test::' || p_size ELSE '' END AS names FROM part",
    "whole_objects": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a":{},"b":' || p_size || '}' WHEN 1 THEN '{"a":' || p_size || '}' END AS found FROM part""",
}
