"""Text functions over documents, conversations, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.answers import f1_table
from .groups_q import _t

_GENERIC = ["the", "and", "of", "code"]
#: Endings that make part names look like kernels, by part key.
_KERNELS = [
    "ncclAllReduce", "deep_ep::dispatch", "deep_ep.combine", "deep_ep_clean", "deep_ep", "flash_fwd_attn", "sparse_attn_v2", "paged_mqa_logits",
    "attention_kernel", "fmha_sm90", "deep_gemm", "sm90_fp8_gemm", "nvjet_tst", "cutlass::Kernel", "MatMul", "cublasLt", "topkGating",
    "per_token_quant", "RMSNorm", "triton_poi", "fused_add", "elementwise", "reduce_kernel", "softmax", "embedding_bag", "Memcpy DtoD",
    "memset", "index_put", "scatter_add", "gather", "batched_cat", "cat", "something else",
]


def _docs(spark, d, **cols):
    return _t(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in cols.items()))


def tokenizer(spark, d):
    t = x.retrieval_tokens(F.concat("text", F.lit(" src/utilFile_name.py:42 parseHTTPResponse v2")))
    return _docs(spark, d, n_tokens=F.size(t).cast("long"), digest=F.md5(F.array_join(t, " ").cast("binary")))


def dedupe_text(spark, d):
    return _docs(spark, d, n=F.size(x.dedupe_fold(F.split("text", "\n"))).cast("long"))


def sanitize_keyword(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", x.clean_keyword(F.col("t"), "(?i)eaux|http", _GENERIC).alias("keyword"))


def phrase_matches(spark, d):
    return _docs(spark, d, hit=x.phrase_match(F.substring("text", 5, 40), F.lower("text")), miss=x.phrase_match(F.lit("quantum the pad"), F.col("text")))


def compression_ratio(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", x.compression(F.col("text")).alias("c"))
    return docs.select("doc_id", F.round("c.ratio", 6).alias("ratio"), F.round("c.savings", 6).alias("savings"))


def stems(spark, d):
    w = _t(spark, d, "documents").select(F.explode(F.split("text", "[ \\t\\n]+")).alias("w"))
    return w.groupBy(x.stem(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


_LEAKS = ["", " the Node-ID", " GT rewards", " hidden tests", " a golden solution", " this experiment", " in v12", " Instance_id", " v1 and node ids"]


def leakage(spark, d):
    tail = F.element_at(F.array(*map(F.lit, _LEAKS)), (F.col("doc_id") % 9 + 1).cast("int"))
    return _docs(spark, d, errors=F.array_join(x.leakage_errors(F.concat("text", tail)), ","))


def normalized_answer(spark, d):
    return _docs(spark, d, answer=F.md5(x.normalize_answer(F.col("text")).cast("binary")))


def _pairs(spark, d):
    """Each document's text and that of the document before."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("truth"))
    return docs.join(before, "doc_id").select("doc_id", F.col("text").alias("prediction"), "truth")


def token_f1(spark, d):
    out = f1_table(_pairs(spark, d), "doc_id", "prediction", "truth")
    return out.select("doc_id", *(F.round(c, 9).alias(c) for c in ("f1", "precision", "recall")))


def em_check(spark, d):
    same = F.concat(F.lit("The "), "prediction", F.lit(" !"))
    golds = F.when(F.col("doc_id") % 2 == 0, F.array("truth", same)).otherwise(F.array("truth", F.lit("a")))
    return _pairs(spark, d).select("doc_id", x.exact_match(F.col("prediction"), golds).alias("em"))


_SAID = [" The answer is b", " so A or C", " none", " option: Z then D", " e is the correct one", " final choice J", "</think> it is F", ""]


def _said(column):
    return F.concat(column, F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % 8 + 1).cast("int")))


def gpqa_letter(spark, d):
    return _docs(spark, d, letter=x.choice_letter(_said(F.col("text")), "ABCDEFGH"))


def gpqa_reward(spark, d):
    k = F.col("doc_id") % 5
    choices = F.when(k < 4, F.array(F.lit("Alpha"), "lang", "source", F.lit("beta-gamma")))
    label = F.when(k == 0, "B").when(k == 1, F.upper("lang")).when(k == 2, "beta gamma").when(k == 3, F.substring_index("text", " ", 2)).otherwise("j")
    return _docs(spark, d, reward=x.choice_reward(_said(F.col("text")), label, choices))


def dapo_answer(spark, d):
    k = (F.col("doc_id") % 4).cast("string")
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nanswer :  "), k)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" ANSWER: x"), k, F.lit(" \nend"))).otherwise("")
    a = x.last_answer(F.concat("text", F.lit("\nAnswer: "), F.col("n_chars").cast("string"), tail))
    return _docs(spark, d, answer=a, score=F.when(F.try_to_number(a, F.lit("999999")) == 1, 1.0).otherwise(-1.0))


def answer_blocks(spark, d):
    r = F.concat(F.lit("<answer>x</answer>"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<answer> "), "text", F.lit(" </answer>"))).otherwise("text"))
    return _docs(spark, d, answer=F.md5(x.answer_block(r).cast("binary")))


def tuple_split(spark, d):
    k, n = F.col("doc_id"), (F.col("n_chars") + 1000).cast("string")
    number = F.concat(F.lit("1,"), F.lpad(F.col("n_chars").cast("string"), 6, "0").substr(1, 3), F.lit(",250"))
    r = F.when(k % 4 == 0, F.concat(F.lit("("), n, F.lit(",x, "), k.cast("string"), F.lit(")"))).when(k % 4 == 1, F.concat(F.lit(" ["), number, F.lit(","), n, F.lit(") "))).when(k % 4 == 2, number).otherwise(F.concat(F.lit("((1,2),"), n, F.lit(")")))
    return _docs(spark, d, parts=F.array_join(x.split_tuple(r), "|"))


def middle_truncation(spark, d):
    cut = {f"t{n}": F.md5(x.truncate_middle(F.col("text"), n).cast("binary")) for n in (0, 30, 201)}
    return _docs(spark, d, **cut, half=F.md5(x.truncate_halves(F.col("text"), 301).cast("binary")))


def loop_signatures(spark, d):
    return _docs(spark, d, sig=x.loop_signature(F.col("text"))).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_SCRIPTS = ["run  test_12.py\tnow", "page9.py", "apply_fix_v3.py and try7.py", "Script44.pyc", "debug-a-b_5.py.bak", "latest1.py ISSUE8.py"]


def counter_suffixes(spark, d):
    name = F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, d, t=F.md5(x.collapse_counters(F.concat(name, F.lit(" "), "text")).cast("binary")))


def labels_safe(spark, d):
    odd = F.when(F.col("page_id") % 5 == 0, None).when(F.col("page_id") % 5 == 1, "  ").when(F.col("page_id") % 5 == 2, F.concat(F.lit(" "), "html")).otherwise(F.col("url"))
    return _t(spark, d, "pages").select("page_id", x.safe_label(odd).alias("label"), x.safe_label(odd, "none", 20).alias("short"))


def model_families(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, "-Qwen3").when(F.col("doc_id") % 3 == 0, "GLM-4").when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise("")
    return _docs(spark, d, family=x.model_family(F.when(F.col("doc_id") % 7 > 0, F.concat("source", name))))


def payload_formats(spark, d):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "diff --git a b\n--- a\n+++ b\n").when(k == 1, " diff --git a b\n--- a\n+++ b\n").when(k == 2, "--- a\n+++ b\n").otherwise("")
    return _docs(spark, d, kind=x.payload_format(F.concat(head, "text"), F.col("doc_id") % 3 != 0))


def token_estimates(spark, d):
    return _docs(spark, d, tokens=x.approximate_tokens(F.col("text")))


def search_queries(spark, d):
    return _docs(spark, d, q=F.md5(x.search_query(F.col("text")).cast("binary")))


def passages_to_string(spark, d):
    return _docs(spark, d, p=F.md5(x.numbered_passages(F.split("text", "\n")).cast("binary")))


def think_stripped(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "a</think>b</think>").when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("</think>"))).otherwise("<think>")
    return _docs(spark, d, t=F.md5(x.after_think(F.concat(head, "text")).cast("binary")))


def kernel_classes(spark, d):
    name = F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, _KERNELS)), (F.col("p_partkey") % len(_KERNELS) + 1).cast("int")))
    return _t(spark, d, "part").groupBy(x.ordered_class(name).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def link_filter(spark, d):
    ext = F.lower(F.regexp_extract(F.regexp_extract("url", r"^[^?#]*", 0), r"\.([A-Za-z0-9]+)$", 1))
    return _t(spark, d, "pages").where(ext.isin("", "html", "htm", "shtml")).select("page_id", ext.alias("ext"))


def duplicate_titles(spark, d):
    t = _t(spark, d, "documents").select("doc_id", F.lower(F.trim(F.substring_index("text", "\n", 1))).alias("title"))
    first = t.groupBy("title").agg(F.min("doc_id").alias("first"))
    return t.join(first, "title").where("doc_id > first").select("doc_id", "first")


def snippet_paragraphs(spark, d):
    key = F.substring("text", 20, 8)
    hits = F.filter(F.split("text", "\n"), lambda p: F.contains(p, key))
    return _docs(spark, d, n=F.size(F.array_distinct(hits)).cast("long"))


def page_titles(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
_SQ = lambda t: f"trim(regexp_replace({t}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_ART = lambda t: f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g')"
_NA = lambda t: _SQ(_ART(_ART(f"regexp_replace(lower({t}), '[!-/:-@\\[-`{{-~]', '', 'g')")))
_SAID_SQL = "WITH t AS (SELECT doc_id, text, lang, source, string_split(text || [" + ", ".join(f"'{v}'" for v in _SAID) + "][doc_id % 8 + 1], '</think>')[-1] AS s FROM documents), "
SQL = {
    "tokenizer": r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text || ' src/utilFile_name.py:42 parseHTTPResponse v2', '[A-Za-z_][A-Za-z0-9_./:-]*|[0-9]+')) AS t, generate_subscripts(regexp_extract_all(text || ' src/utilFile_name.py:42 parseHTTPResponse v2', '[A-Za-z_][A-Za-z0-9_./:-]*|[0-9]+'), 1) AS i FROM documents),
p AS (SELECT doc_id, i, t, list_filter(string_split_regex(t, '[./:_-]+'), lambda s: s <> '') AS c FROM f),
q AS (SELECT doc_id, i, list_concat([t], CASE WHEN len(c) > 1 THEN c ELSE list_filter(c, lambda s: s <> t) END) AS ps FROM p),
h AS (SELECT doc_id, i, list_filter(list_transform(flatten(list_transform(ps, lambda s: string_split(regexp_replace(s, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '))), lambda s: lower(s)), lambda s: length(s) > 1) AS hs FROM q),
a AS (SELECT doc_id, flatten(list(hs ORDER BY i)) AS ts FROM h GROUP BY 1)
SELECT doc_id, len(ts) AS n_tokens, md5(array_to_string(ts, ' ')) AS digest FROM a""",
    "dedupe_text": "SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda s: lower(trim(s))), lambda s: s <> ''))) AS n FROM documents",
    "sanitize_keyword": f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS line, unnest(l) AS t FROM l), k AS (SELECT doc_id, line, {_SQ('t')} AS p FROM e) SELECT doc_id, line, CASE WHEN NOT (length(p) NOT BETWEEN 2 AND 160 OR regexp_matches(p, '(?i)eaux|http') OR lower(p) IN ('the', 'and', 'of', 'code') OR len(regexp_extract_all(p, '[A-Za-z0-9_./:-]+')) NOT BETWEEN 1 AND 12) THEN p END AS keyword FROM k",
    "phrase_matches": f"""WITH v AS (SELECT doc_id, lower({_SQ('substr(text, 5, 40)')}) AS p, lower({_SQ('text')}) AS v FROM documents),
t AS (SELECT *, list_filter(regexp_extract_all(p, '[a-z0-9_./:-]+'), lambda s: length(s) > 2) AS ts, ['quantum', 'the', 'pad'] AS ms FROM v)
SELECT doc_id, contains(v, p) OR (len(ts) > 0 AND len(list_filter(ts, lambda s: contains(v, s))) * 5 >= len(ts) * 4) AS hit, contains(v, 'quantum the pad') OR len(list_filter(ms, lambda s: contains(v, s))) * 5 >= 12 AS miss FROM t""",
    "stems": """WITH w AS (SELECT unnest(string_split_regex(text, '[ \\t\\n]+')) AS w FROM documents),
a AS (SELECT regexp_replace(lower(w), '^[./:_-]+|[./:_-]+$', '', 'g') AS a FROM w),
b AS (SELECT CASE WHEN length(a) > 4 AND a LIKE '%s' THEN left(a, length(a) - 1) ELSE a END AS b FROM a)
SELECT CASE WHEN b LIKE '%ing' AND length(b) > 6 THEN left(b, length(b) - 3) WHEN b LIKE '%ed' AND length(b) > 5 THEN left(b, length(b) - 2) WHEN b LIKE '%es' AND length(b) > 5 THEN left(b, length(b) - 2) ELSE b END AS stem, count(*) AS n FROM b GROUP BY 1""",
    "leakage": "WITH t AS (SELECT doc_id, text || [" + ", ".join(f"'{v}'" for v in _LEAKS) + r"""][doc_id % 9 + 1] AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(?i)\bnode[-_ ]?id\b') THEN 'public leakage: node_id' END,
 CASE WHEN regexp_matches(t, '(?i)\b(terminal|ground[- ]truth|gt)[-_ ]?rewards?\b') THEN 'public leakage: terminal reward' END,
 CASE WHEN regexp_matches(t, '(?i)\bhidden tests?\b') THEN 'public leakage: hidden test' END,
 CASE WHEN regexp_matches(t, '(?i)\bgolden (patch|solution)\b') THEN 'public leakage: golden patch' END,
 CASE WHEN regexp_matches(t, '(?i)\b(this|the) experiment\b|\bv\d{2,3}\b') THEN 'public leakage: experiment identity' END,
 CASE WHEN regexp_matches(t, '(?i)\binstance[-_ ]?id\b') THEN 'public leakage: instance identity' END], lambda s: s IS NOT NULL), ',') AS errors FROM t""",
    "token_f1": f"""WITH n AS (SELECT a.doc_id, {_NA('a.text')} AS p, {_NA('b.text')} AS t FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1),
u AS (SELECT doc_id, w, count(*) FILTER (s = 0) AS x, count(*) FILTER (s = 1) AS y FROM (
  SELECT doc_id, 0 AS s, unnest(string_split(p, ' ')) AS w FROM n UNION ALL SELECT doc_id, 1, unnest(string_split(t, ' ')) FROM n) WHERE w <> '' GROUP BY 1, 2),
c AS (SELECT doc_id, sum(least(x, y)) AS k, sum(x) AS a, sum(y) AS b FROM u GROUP BY 1),
g AS (SELECT n.doc_id, coalesce(k, 0) > 0 AND NOT (p <> t AND (p IN ('yes', 'no', 'noanswer') OR t IN ('yes', 'no', 'noanswer'))) AS ok, k, a, b FROM n LEFT JOIN c USING (doc_id))
SELECT doc_id, round(CASE WHEN ok THEN 2.0::DOUBLE * k / (a + b) ELSE 0 END, 9) AS f1, round(CASE WHEN ok THEN 1.0::DOUBLE * k / a ELSE 0 END, 9) AS precision,
 round(CASE WHEN ok THEN 1.0::DOUBLE * k / b ELSE 0 END, 9) AS recall FROM g""",
    "em_check": f"""WITH n AS (SELECT a.doc_id, {_NA('a.text')} AS p, {_NA('b.text')} AS t, {_NA("'The ' || a.text || ' !'")} AS s FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1)
SELECT doc_id, p = t OR CASE WHEN doc_id % 2 = 0 THEN p = s ELSE p = '' END AS em FROM n""",
    "dapo_answer": r"""WITH t AS (SELECT doc_id, right(text || chr(10) || 'Answer: ' || n_chars || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'answer :  ' || doc_id % 4 WHEN 1 THEN ' ANSWER: x' || doc_id % 4 || ' ' || chr(10) || 'end' ELSE '' END, 300) AS t FROM documents),
a AS (SELECT doc_id, trim(regexp_extract_all(t, '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], ' ') AS answer FROM t)
SELECT doc_id, answer, CASE WHEN TRY_CAST(answer AS INTEGER) = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM a""",
    "answer_blocks": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN trim(text, ' ') END) AS answer FROM documents",
    "tuple_split": """WITH t AS (SELECT doc_id, n_chars + 1000 AS n, '1' || left(lpad(n_chars::VARCHAR, 6, '0'), 3) || '250' AS num FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n || '|x|' || doc_id WHEN 1 THEN num || '|' || n WHEN 2 THEN num ELSE '((1,2),' || n || ')' END AS parts FROM t""",
    "middle_truncation": """WITH m AS (SELECT doc_id, text, chr(10) || '[... Observation truncated due to length ...]' || chr(10) AS m, chr(10) || '[... middle truncated ...]' || chr(10) AS h FROM documents)
SELECT doc_id, md5('') AS t0, md5(left(text, 30)) AS t30, md5(CASE WHEN length(text) <= 201 THEN text ELSE left(text, (201 - length(m)) // 2) || m || right(text, 201 - length(m) - (201 - length(m)) // 2) END) AS t201,
md5(CASE WHEN length(text) <= 301 THEN text ELSE left(text, 110) || h || right(text, 110) END) AS half FROM m""",
    "loop_signatures": "SELECT md5(left(trim(text, ' '), 400)) AS sig, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "counter_suffixes": "WITH t AS (SELECT doc_id, [" + ", ".join("'" + v.replace(chr(9), "' || chr(9) || '") + "'" for v in _SCRIPTS) + "][doc_id % 6 + 1] || ' ' || text AS t FROM documents) SELECT doc_id, md5(" + _SQ(r"regexp_replace(t, '(?i)\b((?:debug|test|issue|apply[_-]?fix|fix|script|attempt|try)(?:[_-][a-z]+)*[_-]?)\d+(\.py\b)', '\1#\2', 'g')") + ") AS t FROM t",
    "labels_safe": """WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' ' || html ELSE url END AS v FROM pages),
n AS (SELECT page_id, nullif(regexp_replace(regexp_replace(v, '^\\s+|\\s+$', '', 'g'), '[^A-Za-z0-9_.:/-]+', '_', 'g'), '') AS n FROM t)
SELECT page_id, left(coalesce(n, ''), 160) AS label, left(coalesce(n, 'none'), 20) AS short FROM n""",
    "model_families": """WITH t AS (SELECT doc_id, lower(CASE WHEN doc_id % 7 > 0 THEN source || CASE WHEN doc_id % 2 = 0 THEN '-Qwen3' WHEN doc_id % 3 = 0 THEN 'GLM-4' WHEN doc_id % 5 = 0 THEN text ELSE '' END ELSE '' END) AS n FROM documents)
SELECT doc_id, CASE WHEN contains(n, 'qwen') THEN 'qwen' WHEN contains(n, 'glm') THEN 'glm' ELSE 'other' END AS family FROM t""",
    "payload_formats": """WITH t AS (SELECT doc_id, chr(10) || CASE doc_id % 4 WHEN 0 THEN 'diff --git a b' || chr(10) || '--- a' || chr(10) || '+++ b' || chr(10) WHEN 1 THEN ' diff --git a b' || chr(10) || '--- a' || chr(10) || '+++ b' || chr(10) WHEN 2 THEN '--- a' || chr(10) || '+++ b' || chr(10) ELSE '' END || text AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'not_terminal' WHEN contains(t, chr(10) || 'diff --git ') AND contains(t, chr(10) || '--- ') AND contains(t, chr(10) || '+++ ') THEN 'unified_diff' ELSE 'non_patch' END AS kind FROM t""",
    "token_estimates": "SELECT doc_id, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens FROM documents",
    "search_queries": "SELECT doc_id, md5(" + _SQ(r"regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g')") + ") AS q FROM documents",
    "passages_to_string": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, md5(array_to_string(list_transform(l, lambda p, i: 'Doc ' || i || '(Title: ' || p || ') ' || chr(10)), '')) AS p FROM l""",
    "think_stripped": "SELECT doc_id, md5(string_split(CASE doc_id % 3 WHEN 0 THEN 'a</think>b</think>' WHEN 1 THEN text || '</think>' ELSE '<think>' END || text, '</think>')[-1]) AS t FROM documents",
    "kernel_classes": "WITH n AS (SELECT lower(p_name || ' ' || [" + ", ".join(f"'{k}'" for k in _KERNELS) + f"][p_partkey % {len(_KERNELS)} + 1]) AS n FROM part) SELECT CASE " + " ".join(
        "WHEN " + " AND ".join(f"contains(n, '{p}')" for p in parts) + f" THEN '{label}'" for parts, label in x.KERNELS) + " ELSE 'Other Compute' END AS kind, count(*) AS n FROM n GROUP BY 1",
    "link_filter": r"WITH e AS (SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages) SELECT * FROM e WHERE ext IN ('', 'html', 'htm', 'shtml')",
    "duplicate_titles": "WITH t AS (SELECT doc_id, lower(trim(string_split(text, chr(10))[1], ' ')) AS title FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY title) AS first FROM t) SELECT doc_id, first FROM f WHERE doc_id > first",
    "snippet_paragraphs": "SELECT doc_id, len(list_distinct(list_filter(string_split(text, chr(10)), lambda p: contains(p, substr(text, 20, 8))))) AS n FROM documents",
    "page_titles": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages",
    "normalized_answer": f"SELECT doc_id, md5({_NA('text')}) AS answer FROM documents",
    "gpqa_letter": _SAID_SQL + r"""u AS (SELECT doc_id, s, list_filter(regexp_extract_all(' ' || regexp_replace(s, '[^\p{L}\p{N}\p{M}_]', '  ', 'g') || ' ', ' ([A-Z]) ', 1), lambda c: contains('ABCDEFGH', c)) AS l, [upper(regexp_extract(s, '(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])', 1)), upper(regexp_extract(s, '(?i)([A-Z])\s*(?:is\s*(?:the)?\s*correct)', 1)), upper(regexp_extract(s, '(?i)final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])', 1))] AS c FROM t)
SELECT doc_id, coalesce(list_filter(c, lambda x: x <> '' AND contains('ABCDEFGH', x))[1], l[-1]) AS letter FROM u""",
    "gpqa_reward": _SAID_SQL + r"""v AS (SELECT doc_id, s, CASE WHEN doc_id % 5 < 4 THEN ['Alpha', lang, source, 'beta-gamma'] END AS ch, CASE WHEN doc_id % 5 < 4 THEN 'ABCD' ELSE 'ABCDEFGHIJ' END AS valid,
  CASE doc_id % 5 WHEN 0 THEN 'B' WHEN 1 THEN upper(lang) WHEN 2 THEN 'beta gamma' WHEN 3 THEN array_to_string(string_split(text, ' ')[:2], ' ') ELSE 'j' END AS label FROM t),
u AS (SELECT *, trim(label, ' ') AS tx, list_filter(regexp_extract_all(' ' || regexp_replace(s, '[^\p{L}\p{N}\p{M}_]', '  ', 'g') || ' ', ' ([A-Z]) ', 1), lambda c: contains(valid, c)) AS l, [upper(regexp_extract(s, '(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])', 1)), upper(regexp_extract(s, '(?i)([A-Z])\s*(?:is\s*(?:the)?\s*correct)', 1)), upper(regexp_extract(s, '(?i)final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])', 1))] AS c FROM v),
w AS (SELECT *, coalesce(list_filter(c, lambda x: x <> '' AND contains(valid, x))[1], l[-1]) AS letter, trim(regexp_replace(lower(tx), '[^a-z0-9]+', ' ', 'g'), ' ') AS nl,
  list_transform(ch, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ')) AS nc, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), ' ') AS said FROM u),
r AS (SELECT *, CASE WHEN length(tx) = 1 AND contains(valid, upper(tx)) THEN upper(tx) WHEN list_position(nc, nl) > 0 THEN valid[list_position(nc, nl)] END AS rt FROM w)
SELECT doc_id, CASE WHEN letter IS NOT NULL AND rt IS NOT NULL THEN (letter = rt)::INTEGER::DOUBLE
  WHEN len(list_filter([nl, nc[strpos(valid, rt)]], lambda x: x <> '' AND contains(said, x))) > 0 THEN 1.0::DOUBLE
  WHEN letter IS NOT NULL AND rt IS NULL AND letter = upper(tx) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM r""",
}
