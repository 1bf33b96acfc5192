"""Search rewards, graders, cards and rubric portfolios over documents, items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths
from ..functions import search as s
from ..operators import cards as c
from .groups_q import _SQL_LINES, _lines, _t

_C = F.col
#: Shapes of a search conversation, by document id; $ stands for the text.
_SHAPES = [
    "<|im_start|>assistant\n<think>$</think> <answer>$</answer>", "<think>a</think><answer>$</answer>", "<|im_start|>assistant<think>a</think><search>q</search><information>$</information><think>b</think><answer>$</answer>",
    "<|im_start|>assistant <think>a</think>$<answer>x</answer>", "<|im_start|>assistant<think>a</think><search>q</search><answer>$</answer>", "<|im_start|>assistant<think>$</think><answer>$</answer> more",
    "<answer>p</answer><|im_start|>assistant<think>a</think><search>q</search>\n<information>the $</information> <think>b</think>\n<answer>The $!</answer>\n", "<|im_start|>assistant<think>a<think></think><answer>$</answer>",
]


def _shaped(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (_C("doc_id") % 8 + 1).cast("int"))
    return docs.select("doc_id", F.replace(shape, F.lit("$"), _C("text")).alias("said"), F.array("text", F.lit("other")).alias("golds"))


def valid_sequences(spark, d):
    return _shaped(spark, d).select("doc_id", s.valid_sequence(_C("said")).alias("valid"))


def retrieval_hits(spark, d):
    return _shaped(spark, d).select("doc_id", s.retrieval_hit(_C("said"), _C("golds")).alias("hit"))


def search_scores(spark, d):
    return _shaped(spark, d).select("doc_id", s.search_score(_C("said"), _C("golds"), 0.2, 0.1, 0.1).alias("score"))


_ANSWERS = ["so \\boxed{@}", "</think> \\boxed{@} it is", "\\boxed{@} or \\boxed{7}", "Answer: @", "###Response \\boxed{@}", "@ it is", "\\boxed{@"]


def _answered(spark, d):
    shape = F.element_at(F.array(*map(F.lit, _ANSWERS)), (_C("p_partkey") % 7 + 1).cast("int"))
    said = F.concat("p_name", F.lit(" "), F.replace(shape, F.lit("@"), _C("p_size").cast("string")))
    truth = F.when(_C("p_partkey") % 2 == 0, _C("p_size")).otherwise(_C("p_size") + _C("p_partkey") % 3).cast("string")
    return _t(spark, d, "part").select("p_partkey", said.alias("said"), truth.alias("truth"))


def strict_boxes(spark, d):
    return _answered(spark, d).select("p_partkey", maths.strict_box_score(_C("said"), _C("truth")).alias("s")).select("p_partkey", "s.score", "s.acc", "s.pred")


def plain_scores(spark, d):
    return _answered(spark, d).select("p_partkey", maths.plain_score(_C("said"), _C("truth")).alias("s")).select("p_partkey", "s.score", "s.acc")


def tool_scores(spark, d):
    return _answered(spark, d).select("p_partkey", F.round(maths.tool_score(_C("said"), _C("truth"), _C("p_partkey") % 12), 9).alias("score"))


def thought_rewards(spark, d):
    return _answered(spark, d).select("p_partkey", maths.thought_reward(_C("said"), _C("truth")).alias("reward"))


def boxed_or_plain(spark, d):
    bare = F.when(_C("p_partkey") % 3 == 0, F.concat(F.lit(" "), "truth", F.lit(" "))).when(_C("p_partkey") % 3 == 1, _C("said")).otherwise("x")
    return _answered(spark, d).select("p_partkey", maths.boxed_or_plain(bare, _C("truth")).alias("reward"))


def short_answers(spark, d):
    said = F.concat("said", F.when(_C("p_partkey") % 2 == 0, "\nlast line  \n\n").otherwise(""))
    return _answered(spark, d).select("p_partkey", maths.short_answer(said).alias("answer"))


def rewards_by_kind(spark, d):
    kinds = ["math", "dapo", "deepscaler", "f1", "boxed_f1", "gpqa"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (_C("p_partkey") % 6 + 1).cast("int"))
    rows = _answered(spark, d).withColumn("kind", kind)
    return rows.select("p_partkey", "kind", F.round(maths.reward_by_kind(_C("kind"), _C("said"), _C("truth"), F.lit(None).cast("array<string>")), 6).alias("reward"))


# Cards


def _cards(spark, d):
    k = _C("doc_id")
    docs = _t(spark, d, "documents")
    fields = {
        "experience_id": F.when(k % 11 > 0, k.cast("string")), "title": F.when(k % 5 > 0, F.concat(F.lit("  "), "source", F.lit(" "))).otherwise(" "), "description": _C("lang"),
        "context": F.when(k % 7 > 0, F.concat("text", F.when(k % 3 == 0, " hidden test ").otherwise(""))), "experience": F.when(k % 2 == 0, "Experience\n").otherwise("x in v12"),
    }
    return docs, fields


def card_checks(spark, d):
    docs, fields = _cards(spark, d)
    errors = c.card_errors(fields, _C("doc_id") % 4 > 0)
    gate = c.candidate_reasons(errors, F.array().cast("array<string>"), _C("doc_id") % 2, _C("doc_id") % 3 > 0)
    return docs.select("doc_id", F.array_join(errors, "; ").alias("errors"), (F.size(gate) == 0).alias("accepted"), F.size(gate).alias("reasons"))


def normalized_cards(spark, d):
    docs, fields = _cards(spark, d)
    inner = {n: F.concat(F.lit(" "), v) for n, v in fields.items()}
    card = c.normalize_card(fields, inner, _C("doc_id") % 3 == 1, _C("doc_id").cast("string"))
    return docs.select("doc_id", card.alias("card")).select("doc_id", "card.title", "card.experience", F.md5(_C("card.context").cast("binary")).alias("context"))


def duplicate_cards(spark, d):
    rows = _t(spark, d, "documents").select(_C("doc_id").cast("string").alias("experience_id"), _C("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), F.left("text", F.length("text")).alias("body"))
    return c.duplicate_cards(rows)


def rubric_checks(spark, d):
    k = _C("p_partkey")
    metadata = F.map_from_arrays(F.array(*map(F.lit, c.RUBRIC_METADATA)), F.transform(F.array(*[F.lit(i) for i in range(7)]), lambda i: F.when(k % 8 == i, " ").otherwise("set")))
    conditions = F.when(k % 6 > 0, F.array("p_type", F.when(k % 5 == 0, "compare both").when(k % 7 == 0, " ").otherwise("when it runs")))
    anchors = F.when(k % 9 > 0, F.array(*map(F.lit, "54321"))).otherwise(F.array(*map(F.lit, "1234")))
    errors = c.rubric_errors(F.when(k % 4 == 0, "neutral").otherwise("positive"), k % 3, conditions, anchors, F.when(k % 10 > 0, _C("p_name")), _C("p_brand"), metadata, F.when(k % 13 == 0, "see G12").otherwise(_C("p_name")))
    return _t(spark, d, "part").select("p_partkey", F.array_join(errors, "; ").alias("errors"))


def generation_checks(spark, d):
    rows = _lines(spark, d).withColumn("title", F.floor("l_quantity"))
    out = c.generation_errors(rows, "l_orderkey", "l_discount", "title")
    return out.select("l_orderkey", F.array_join("errors", "; ").alias("errors"))


def refinement_checks(spark, d):
    k = _C("o_orderkey")
    orders = _t(spark, d, "orders")
    failed = orders.where(k % 9 > 0).select(k.alias("candidate_id"), (k % 50).alias("pos"), k.alias("contract"))
    made = orders.where(k % 7 > 0).select(k.alias("candidate_id"), F.when(k % 5 == 0, -1).otherwise(k % 50).alias("pos"), F.when(k % 11 == 0, "keep").otherwise("refine").alias("action"),
                                          F.when(k % 6 == 0, k).when(k % 6 == 1, -(k % 100)).otherwise(-1000 - k).alias("contract"))
    return c.refinement_errors(failed, made)


def named_candidates(spark, d):
    public = F.concat("text", F.lit(" in src/core/a.py raises ValueError from os.path, calls parse (x)"))
    rows = _t(spark, d, "documents").select("doc_id", c.named_candidates(F.substring_index("text", "\n", 1), public, F.array("source", F.lit("code"))).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|").cast("binary")).alias("digest"))


def overlap_candidates(spark, d):
    items = _t(spark, d, "benchmark").select("item_id", "text")
    other = items.select((_C("item_id") + 1).alias("item_id"), _C("text").alias("asked"))
    rows = items.join(other, "item_id").select("item_id", c.overlap_candidates(_C("text"), F.concat("asked", F.lit(" the lib/x.py "))).alias("k"))
    return rows.select("item_id", F.size("k").cast("long").alias("n"), F.array_join("k", "|").alias("keywords"))


def case_slugs(spark, d):
    return _t(spark, d, "pages").select("page_id", c.case_slug(F.concat(F.lit("a b:"), "url"), F.when(_C("page_id") % 2 == 0, "pc").otherwise("siblings")).alias("slug"))


def stage_queries(spark, d):
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(_C("role") == "user").alias("patched"), F.count(F.lit(1)).alias("branches"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.lpad(_C("turn").cast("string"), 6, "0"), "text"))), "\n").alias("text"), F.array_sort(F.collect_set("role")).alias("files"))
    text = F.concat("text", F.when(_C("conv_id") % 3 == 0, " Reproduce it, then git diff").when(_C("conv_id") % 3 == 1, " pytest: build failed").otherwise(""))
    return rows.select("conv_id", c.stage_query(F.when(_C("conv_id") % 4 == 0, 0).when(_C("conv_id") % 4 == 1, _C("branches")).otherwise(_C("patched")), _C("branches"), c.evidence_kinds(text), _C("files")).alias("query"))


def query_summaries(spark, d):
    words = F.split("text", " ")
    lists = {"task_contract": F.slice(words, 1, 12), "implementation_boundaries": F.slice(words, 5, 3), "failure_modes": F.array(F.lit(" "), F.lit("x")), "visible_branch_discriminators": F.slice(words, 9, 4)}
    out = c.query_summary(lists, F.concat(F.lit(" "), "lang"), F.when(_C("doc_id") % 2 == 0, F.slice(words, 2, 20)))
    rows = _t(spark, d, "documents").select("doc_id", out.alias("q"))
    return rows.select("doc_id", F.array_join("q.task_contract", "|").alias("contract"), F.array_join("q.failure_modes", "|").alias("modes"), "q.trajectory_stage", F.array_join("q.retrieval_queries", "|").alias("queries"))


def rubric_texts(spark, d):
    meta = F.array(F.struct(F.lit("stage").alias("key"), _C("p_type").alias("value")), F.struct(F.lit("focus").alias("key"), F.concat("p_brand", F.lit("\n"), "p_name").alias("value")))
    text = c.rubric_text(F.concat(F.lit(" "), "p_name"), F.lit("Positive "), _C("p_brand"), F.array(*[F.lit(f"a{i}") for i in range(5)]), meta)
    return _t(spark, d, "part").select("p_partkey", text.alias("text"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_NA = lambda t: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[!-/:-@\\[-`{{-~]', '', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_Q = lambda t: "'" + t.replace("'", "''") + "'"
_SHAPED = "WITH h AS (SELECT doc_id, text, replace([" + ", ".join(_Q(t) for t in _SHAPES) + """][doc_id % 8 + 1], '$', text) AS s FROM documents),
v AS (SELECT *, strpos(s, '<|im_start|>assistant') AS mark, substr(s, strpos(s, '<|im_start|>assistant') + 21) AS c FROM h),
w AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(translate(c, '\x01\x02\x03\x04\x05\x06\x0e\x0f', ''), '<think>', '\x01'), '</think>', '\x02'), '<search>', '\x03'), '</search>', '\x04'), '<information>', '\x05'), '</information>', '\x06'), '<answer>', '\x0e'), '</answer>', '\x0f') AS m FROM v),
x AS (SELECT doc_id, text, s, mark > 0 AND regexp_full_match(m, '\\s*(?:\x01[^\x01-\x06\x0e\x0f]*\x02\\s*\x03[^\x01-\x06\x0e\x0f]*\x04\\s*\x05[^\x01-\x06\x0e\x0f]*\x06\\s*)*\x01[^\x01-\x06\x0e\x0f]*\x02\\s*\x0e[^\x01-\x06\x0e\x0f]*\x0f\\s*') AS valid,
 regexp_extract_all(s, '(?s)<information>(.*?)</information>', 1) AS b, regexp_extract_all(s, '(?s)<answer>(.*?)</answer>', 1) AS a FROM w)"""
_SQL_ANSWERED = "WITH p AS (SELECT p_partkey, p_size, p_partkey % 7 AS k, p_name || ' ' || replace([" + ", ".join(_Q(t) for t in _ANSWERS) + "][p_partkey % 7 + 1], '@', p_size::VARCHAR) AS said, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + p_partkey % 3 END::VARCHAR AS truth FROM part), b AS (SELECT *, regexp_extract_all(said, '\\\\boxed\\{([^{}]*)\\}', 1)[-1] AS pred FROM p)"
_SQL_CARDS = """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN doc_id::VARCHAR END AS i, CASE WHEN doc_id % 5 > 0 THEN '  ' || source || ' ' ELSE ' ' END AS t, lang AS d, CASE WHEN doc_id % 7 > 0 THEN text || CASE WHEN doc_id % 3 = 0 THEN ' hidden test ' ELSE '' END END AS c, CASE WHEN doc_id % 2 = 0 THEN 'Experience' || chr(10) ELSE 'x in v12' END AS e FROM documents),
g AS (SELECT *, concat_ws(chr(10), t, d, coalesce(c, ''), e) AS pub FROM f),
r AS (SELECT doc_id, list_filter([CASE WHEN i IS NULL THEN 'missing experience_id' END, CASE WHEN trim(t, ' ') = '' THEN 'missing title' END, CASE WHEN trim(coalesce(c, ''), ' ') = '' THEN 'missing context' END, CASE WHEN doc_id % 4 = 0 THEN 'metadata is not an object' END,
 CASE WHEN regexp_matches(pub, '(?i)\\bnode[-_ ]?id\\b') THEN 'public leakage: node_id' END, CASE WHEN regexp_matches(pub, '(?i)\\b(terminal|ground[- ]truth|gt)[-_ ]?rewards?\\b') THEN 'public leakage: terminal reward' END,
 CASE WHEN regexp_matches(pub, '(?i)\\bhidden tests?\\b') THEN 'public leakage: hidden test' END, CASE WHEN regexp_matches(pub, '(?i)\\bgolden (patch|solution)\\b') THEN 'public leakage: golden patch' END,
 CASE WHEN regexp_matches(pub, '(?i)\\b(this|the) experiment\\b|\\bv\\d{2,3}\\b') THEN 'public leakage: experiment identity' END, CASE WHEN regexp_matches(pub, '(?i)\\binstance[-_ ]?id\\b') THEN 'public leakage: instance identity' END], lambda x: x IS NOT NULL) AS er FROM g)"""
_FOLD = lambda l: f"(SELECT list(v ORDER BY i) FROM (SELECT v, i, row_number() OVER (PARTITION BY lower(v) ORDER BY i) AS k FROM (SELECT trim(unnest({l}), ' ') AS v, generate_subscripts({l}, 1) AS i) WHERE v <> '') WHERE k = 1)"
SQL = {
    "valid_sequences": _SHAPED + " SELECT doc_id, valid FROM x",
    "retrieval_hits": _SHAPED + f" SELECT doc_id, len(list_filter(b, lambda y: contains({_NA('y')}, {_NA('text')}) OR contains({_NA('y')}, 'other'))) > 0 AS hit FROM x",
    "search_scores": _SHAPED + f""", z AS (SELECT doc_id, valid, CASE WHEN len(a) >= 2 THEN trim(a[-1], ' ') END AS ans, text, len(list_filter(b, lambda y: contains({_NA('y')}, {_NA('text')}) OR contains({_NA('y')}, 'other'))) > 0 AS hit FROM x),
y AS (SELECT *, coalesce({_NA('ans')} = {_NA('text')} OR {_NA('ans')} = 'other', false) AS ok FROM z)
SELECT doc_id, CASE WHEN ok AND valid THEN 1.0::DOUBLE WHEN ok THEN 0.8 WHEN valid AND hit THEN 0.2::DOUBLE + 0.1::DOUBLE WHEN valid THEN 0.2 WHEN ans IS NOT NULL THEN 0.1 ELSE 0 END AS score FROM y""",
    "strict_boxes": _SQL_ANSWERED + " SELECT p_partkey, CASE WHEN coalesce(pred = truth, false) THEN 1.0::DOUBLE ELSE -1 END AS score, coalesce(pred = truth, false) AS acc, pred FROM b",
    "plain_scores": _SQL_ANSWERED + " SELECT p_partkey, CASE WHEN k = 3 AND p_size::VARCHAR = truth THEN 1.0::DOUBLE ELSE -1 END AS score, k = 3 AND p_size::VARCHAR = truth AS acc FROM b",
    "tool_scores": _SQL_ANSWERED + " SELECT p_partkey, round(CASE WHEN coalesce(pred = truth, false) THEN 1.0::DOUBLE ELSE least(-0.6::DOUBLE, -1 + (p_partkey % 12 - 2) / 2 * 0.1::DOUBLE) END, 9) AS score FROM b",
    "thought_rewards": _SQL_ANSWERED + " SELECT p_partkey, (k IN (1, 4) AND coalesce(pred = truth, false))::INTEGER AS reward FROM b",
    "boxed_or_plain": _SQL_ANSWERED + " SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN coalesce(pred = truth, false)::INTEGER ELSE 0 END AS reward FROM b",
    "short_answers": _SQL_ANSWERED + " SELECT p_partkey, coalesce(pred, CASE WHEN p_partkey % 2 = 0 THEN 'last line' ELSE said END) AS answer FROM b",
    "card_checks": _SQL_CARDS + " SELECT doc_id, array_to_string(er, '; ') AS errors, len(er) = 0 AND doc_id % 2 = 0 AND doc_id % 3 > 0 AS accepted, (len(er) + CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS reasons FROM r",
    "normalized_cards": _SQL_CARDS + ", n AS (SELECT *, trim(t, ' ') <> '' AND c IS NOT NULL AND trim(c, ' ') <> '' AS ok FROM f) SELECT doc_id, CASE WHEN ok THEN trim(t, ' ') END AS title, CASE WHEN ok THEN trim(e, ' ') END AS experience, CASE WHEN ok THEN md5(trim(c, ' ')) END AS context FROM n",
    "rubric_checks": """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'rubric polarity must be positive or negative' END, CASE WHEN p_partkey % 3 = 0 THEN 'rubric weight must be positive' END,
CASE WHEN p_partkey % 6 = 0 OR (p_partkey % 5 > 0 AND p_partkey % 7 = 0) THEN 'rubric applies_when must be a nonempty string list' END, CASE WHEN p_partkey % 6 > 0 AND (p_partkey % 5 = 0 OR regexp_matches(p_type, '(?i)\\b(judge|score|scoring|weight|anchor|credit|penali[sz]e|grade|inspect|look for|compare|verify)\\b')) THEN 'applies_when contains judge-facing instructions' END,
CASE WHEN p_partkey % 9 = 0 THEN 'rubric scale must have exactly anchors 1 through 5' END, CASE WHEN p_partkey % 10 = 0 THEN 'rubric lacks title' END, CASE WHEN p_partkey % 8 < 7 THEN 'rubric metadata lacks required judge-facing fields' END,
CASE WHEN p_partkey % 13 = 0 OR regexp_matches(p_name, '(?i)\\b(G|T)\\d+\\b') THEN 'rubric contains supervision or trajectory alias leakage' END], lambda x: x IS NOT NULL), '; ') AS errors FROM part""",
    "generation_checks": _SQL_LINES + """, b AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_discount) AS c, count(DISTINCT floor(l_quantity)) AS t FROM li GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN n > 6 THEN 'reference_golden_rubrics must contain one to six rubrics' END, CASE WHEN c < n THEN 'duplicate rubric contracts' END, CASE WHEN t < n THEN 'duplicate rubric titles' END], lambda x: x IS NOT NULL), '; ') AS errors FROM b""",
    "refinement_checks": """WITH f AS (SELECT o_orderkey AS id, o_orderkey % 50 AS pos FROM orders WHERE o_orderkey % 9 > 0),
m AS (SELECT o_orderkey AS mid, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 50 END AS mpos, o_orderkey % 11 = 0 AS kept, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN -(o_orderkey % 100) ELSE -1000 - o_orderkey END AS c FROM orders WHERE o_orderkey % 7 > 0),
n AS (SELECT *, count(*) OVER (PARTITION BY c) AS n FROM m),
e AS (SELECT coalesce(id, mid) AS candidate_id, CASE WHEN id IS NULL OR mid IS NULL THEN 'refinement decisions must cover failed candidates in order' WHEN kept THEN 'refinement action must be refine' WHEN c = id THEN 'refinement did not change the candidate contract' WHEN n > 1 THEN 'refinement contains duplicate rubrics' END AS error FROM f FULL JOIN n ON id = mid AND pos = mpos)
SELECT * FROM e WHERE error IS NOT NULL""",
    "case_slugs": "SELECT page_id, replace(replace(replace(CASE WHEN page_id % 2 = 0 THEN 'pc' ELSE 'siblings' END || '__a b:' || url, '/', '_'), ':', '__'), ' ', '_') AS slug FROM pages",
    "rubric_texts": "SELECT p_partkey, 'Title: ' || trim(p_name, ' ') || chr(10) || 'Type: positive' || chr(10) || 'Description: ' || trim(p_brand, ' ') || chr(10) || 'Scale:' || chr(10) || '1: a0' || chr(10) || '2: a1' || chr(10) || '3: a2' || chr(10) || '4: a3' || chr(10) || '5: a4' || chr(10) || 'Metadata:' || chr(10) || '- **stage**: ' || p_type || chr(10) || '- **focus**:' || chr(10) || '  ' || p_brand || chr(10) || '  ' || p_name AS text FROM part",
    "stage_queries": "WITH b AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) AS n, lower(string_agg(text, chr(10)) || CASE conv_id % 3 WHEN 0 THEN ' Reproduce it, then git diff' WHEN 1 THEN ' pytest: build failed' ELSE '' END) AS t, list_sort(list(DISTINCT role)) AS f FROM conversations GROUP BY 1), c AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN 0 WHEN 1 THEN n ELSE u END AS p, list_filter([" + ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(t, '{m}')" for m in marks) + f" THEN '{name}' END" for name, marks in c.EVIDENCE) + f"""], lambda x: x IS NOT NULL) AS k FROM b)
SELECT conv_id, 'Trajectory stage portfolio: ' || CASE WHEN p = 0 THEN 'all continuations are pre-patch exploration' WHEN p = n THEN 'all continuations have source patches' ELSE 'mixed patched and unpatched continuation population' END || '.' || chr(10) || 'Patched branches: ' || p || '; unpatched branches: ' || (n - p) || '.' || chr(10) || 'Visible evidence kinds: ' || CASE WHEN len(k) > 0 THEN array_to_string(k, ', ') ELSE 'unclear' END || chr(10) || 'Changed files across branches: ' || array_to_string(f, ', ') || chr(10) || '{c.STAGE_REQUEST}' AS query FROM c""",
}
