"""Retrieval, event and packing operators over the standard tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens
from ..operators import events as e
from ..operators import packing, retrieval
from .groups_q import _t

_C = F.col


def bm25(spark, d):
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    words = F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), "")
    return retrieval.bm25_top_k(docs, "doc_id", words, items, "item_id", words, 6).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def rank_fusion(spark, d):
    """Items ask with four fields, documents answer with two; an item's own source is left out."""
    words = lambda c: F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")
    items = _t(spark, d, "benchmark").select("item_id", "text", F.concat(F.lit("src"), (_C("item_id") % 25).cast("string")).alias("own"))
    asked = {"prior": _C("text"), "stage": F.concat(F.lit("the stage "), "own"), "llm_contract": F.when(_C("item_id") % 3 > 0, _C("text")).otherwise(" "), "llm_state": F.substring_index("text", " ", 4)}
    held = {"full": _C("text"), "keywords": F.concat_ws(" ", "source", "lang", F.substring_index("text", " ", 8))}
    out = retrieval.weighted_rank(_t(spark, d, "documents"), "doc_id", held, "source", items, "item_id", asked, "own", words)
    return out.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def index_terms(spark, d):
    p = retrieval.postings(_t(spark, d, "documents"), "doc_id", retrieval_tokens(_C("text")))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def dense_top_k(spark, d):
    v = _t(spark, d, "embeddings")
    out = retrieval.dense_top_k(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), 5)
    return out.select("q", "vec_id", "rank", F.round("score", 6).alias("score"))


def usage_totals(spark, d):
    ev = _t(spark, d, "events")
    req = ev.select((_C("event_id") - _C("event_id") % 2).alias("event_id"), _C("event_id").alias("ord"), _C("user_id").alias("group_id"),
                    F.floor("value").cast("long").alias("tokens"), (_C("event_type") == "error").alias("failed"), _C("event_type").alias("family"))
    dis = ev.where("event_id % 7 = 0").select(_C("user_id").alias("group_id"), _C("event_id").alias("ord"), F.when(_C("value") > 50, "filtered").otherwise("accepted").alias("disposition"))
    return e.usage_totals(req, dis, ["family"])


def busy_time(spark, d):
    ev = _t(spark, d, "events").select("user_id", F.unix_micros(_C("ts").cast("timestamp")).alias("s"), (F.unix_micros(_C("ts").cast("timestamp")) + (_C("value") * 1e8).cast("long")).alias("t"))
    return e.busy_and_gaps(ev, "user_id", "s", "t")


def longest_run(spark, d):
    return e.longest_run(_t(spark, d, "events"), "user_id", "event_id", "event_type")


def step_cards(spark, d):
    ev = _t(spark, d, "events")
    return e.step_cards(ev, "user_id", "event_id", _C("event_type") == "purchase", _C("event_type") == "view", "event_id")


def span_depths(spark, d):
    ev = _t(spark, d, "events").select("event_id", F.when(_C("event_id") % 50 != 0, F.floor(_C("event_id") * 0.5)).cast("long").alias("parent"))
    return e.span_depths(ev, "event_id", "parent")


def cumulative_deltas(spark, d):
    ev = _t(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("v"))
    return e.deltas(ev, "user_id", "event_id", "v").select("event_id", "delta")


def periodic_steps(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", e.periodic(_C("o_orderkey"), 7, 50, 1500).alias("due"))


def conversation_health(spark, d):
    c = _t(spark, d, "conversations")
    long = F.length("text") >= 150
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"), F.count_if(long).alias("long_turns"),
                                    F.countDistinct(F.when(long, F.md5(F.left("text", F.lit(400)).cast("binary")))).alias("prefixes"))


def repeated_prefixes(spark, d):
    c = _t(spark, d, "documents")
    return c.groupBy("lang", F.md5(F.left(F.trim("text"), F.lit(400)).cast("binary")).alias("sig")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def trajectory_counters(spark, d):
    c = _t(spark, d, "conversations")
    extra = F.when(_C("turn") % 5 == 0, "<returncode>0</returncode> no output").when(_C("turn") % 7 == 0, "died").otherwise("")
    rows = c.select("conv_id", "turn", "role", F.concat(F.repeat("text", F.when(_C("conv_id") % 2 == 0, 6).otherwise(1)), F.lit(" "), extra).alias("text"))
    rows = rows.unionByName(rows.where("role = 'assistant' and conv_id % 4 = 0").withColumn("turn", _C("turn") + 1000))
    return e.trajectory_counters(rows, "conv_id", "turn", ["no output"], "died", "late")


def static_schedule(spark, d):
    """Samples in order of id: steps of 64, micro-batches of 8 dealt to 4 ranks, the unfilled tail dropped."""
    from ..operators.order import with_rank

    r = with_rank(_t(spark, d, "documents").select("doc_id"), "doc_id").withColumn("step", F.expr("rank div 64"))
    full = r.groupBy("step").agg(F.count(F.lit(1)).alias("n")).where("n = 64").select("step")
    return r.join(full, "step").select("doc_id", "step", F.expr("(rank % 64) div 8").alias("micro"), F.expr("((rank % 64) div 8) % 4").alias("dp_rank"))


def _pack(spark, d, method):
    docs = _t(spark, d, "documents").select((_C("doc_id") - _C("doc_id") % 64).alias("step"), "doc_id", "n_chars")
    return packing.pack(docs, "step", "doc_id", "n_chars", method)


def first_fit(spark, d):
    return _pack(spark, d, partial(packing.first_fit, capacity=20000))


def greedy_in_order(spark, d):
    return _pack(spark, d, partial(packing.in_order_greedy, bins=8))


def karmarkar_karp(spark, d):
    return _pack(spark, d, partial(packing.largest_differencing, bins=8))


def greedy_chunks(spark, d):
    return _pack(spark, d, partial(packing.greedy_chunks, limit=20000))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
_BM = """WITH dt AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda s: s <> '') AS t FROM documents),
qt AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda s: s <> ''))) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS av FROM dt),
s AS (SELECT item_id, doc_id, sum(round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / av)), 12)) AS score
FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dt USING (doc_id), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM s) """
SQL = {
    "bm25": _BM + "SELECT item_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 6",
    "rank_fusion": """WITH it AS (SELECT item_id, text, 'src' || item_id % 25 AS own FROM benchmark),
f AS (SELECT item_id, own, 'prior' AS qf, 0.6::DOUBLE AS qw, text AS t FROM it UNION ALL SELECT item_id, own, 'stage', 0.69, 'the stage ' || own FROM it UNION ALL SELECT item_id, own, 'llm_contract', 1.48, text FROM it WHERE item_id % 3 > 0
 UNION ALL SELECT item_id, own, 'llm_state', 4.01, array_to_string(string_split(text, ' ')[:4], ' ') FROM it),
q AS (SELECT DISTINCT item_id, qf, unnest(list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda s: s <> '')) AS term FROM f),
dd AS (SELECT doc_id, 'full' AS df, 0.19::DOUBLE AS dw, text AS t FROM documents UNION ALL SELECT doc_id, 'keywords', 1.39, source || ' ' || lang || ' ' || array_to_string(string_split(text, ' ')[:8], ' ') FROM documents),
dt AS (SELECT doc_id, df, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda s: s <> '') AS t FROM dd),
p AS (SELECT doc_id, df, term, count(*) AS tf FROM (SELECT doc_id, df, unnest(t) AS term FROM dt) GROUP BY 1, 2, 3), fr AS (SELECT df, term, count(*) AS n FROM p GROUP BY 1, 2), st AS (SELECT df, count(*) AS total, greatest(avg(len(t)), 1) AS av FROM dt GROUP BY 1),
s AS (SELECT item_id, qf, p.df, p.doc_id, sum(round(ln(1 + (total - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / av)), 12)) AS score
 FROM q JOIN p USING (term) JOIN fr ON fr.df = p.df AND fr.term = p.term JOIN st ON st.df = p.df JOIN dt ON dt.doc_id = p.doc_id AND dt.df = p.df GROUP BY 1, 2, 3, 4),
a AS (SELECT f.item_id, f.own, f.qf, f.qw, dd.df, dd.dw, dd.doc_id, coalesce(s.score, 0) AS score FROM f CROSS JOIN dd LEFT JOIN s ON s.item_id = f.item_id AND s.qf = f.qf AND s.df = dd.df AND s.doc_id = dd.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, qf, df ORDER BY round(score, 9) DESC, doc_id) AS r FROM a),
u AS (SELECT item_id, own, r.doc_id, sum(qw * dw * ((1.0::DOUBLE / (60 + r))::FLOAT)::DOUBLE) AS score FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE d.source <> own GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM u)
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM k WHERE rank <= 6""",
    "dense_top_k": """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS score FROM u a, u b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id)::INTEGER AS rank FROM s) SELECT q, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "usage_totals": """WITH r AS (SELECT event_id - event_id % 2 AS k, event_id AS ord, user_id, floor(value)::BIGINT AS tokens, event_type FROM events),
f AS (SELECT k, arg_min(user_id, ord) AS g, arg_min(tokens, ord) AS tokens, arg_min(event_type, ord) AS family FROM r GROUP BY 1),
d AS (SELECT user_id AS g, arg_max(CASE WHEN value > 50 THEN 'filtered' ELSE 'accepted' END, event_id) AS dis FROM events WHERE event_id % 7 = 0 GROUP BY 1)
SELECT family, count(*) AS requests, sum(tokens)::BIGINT AS tokens, count(*) FILTER (family = 'error') AS failed, coalesce(sum(tokens) FILTER (dis = 'filtered'), 0)::BIGINT AS dropped_tokens FROM f LEFT JOIN d USING (g) GROUP BY 1""",
    "busy_time": """WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + trunc(value * 1e8)::BIGINT AS t FROM events),
b AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i)
SELECT user_id, sum(greatest(t - greatest(s, coalesce(b, s)), 0))::BIGINT AS busy, sum(CASE WHEN s > b THEN s - b ELSE 0 END)::BIGINT AS idle, count(*) FILTER (b IS NULL OR s > b) AS islands FROM b GROUP BY 1""",
    "longest_run": """WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS j FROM events),
r AS (SELECT user_id, count(*) AS length, max(i)::INTEGER AS "end" FROM a GROUP BY user_id, event_type, i - j), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, "end") AS n FROM r) SELECT user_id, length, "end" FROM k WHERE n = 1""",
    "step_cards": """WITH s AS (SELECT user_id, event_id, event_type, coalesce(sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS step FROM events)
SELECT user_id, step, count(*) AS events, max(event_id) FILTER (event_type = 'view') AS last FROM s GROUP BY 1, 2""",
    "span_depths": """WITH RECURSIVE p AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN event_id // 2 END AS parent FROM events),
d AS (SELECT event_id, 0::BIGINT AS depth FROM p WHERE parent IS NULL OR parent NOT IN (SELECT event_id FROM p) UNION ALL SELECT p.event_id, d.depth + 1 FROM d JOIN p ON p.parent = d.event_id) SELECT * FROM d""",
    "cumulative_deltas": "SELECT event_id, floor(value)::BIGINT - coalesce(lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events",
    "periodic_steps": "SELECT o_orderkey, (o_orderkey + 1) % 7 = 0 OR (o_orderkey + 1) % 50 = 0 OR o_orderkey = 1499 AS due FROM orders",
    "conversation_health": "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) >= 150) AS long_turns, count(DISTINCT CASE WHEN length(text) >= 150 THEN left(text, 400) END) AS prefixes FROM conversations GROUP BY 1",
    "repeated_prefixes": "SELECT lang, md5(left(trim(text, ' '), 400)) AS sig, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) >= 2",
    "trajectory_counters": """WITH b AS (SELECT conv_id, turn, role, repeat(text, CASE WHEN conv_id % 2 = 0 THEN 6 ELSE 1 END) || ' ' || CASE WHEN turn % 5 = 0 THEN '<returncode>0</returncode> no output' WHEN turn % 7 = 0 THEN 'died' ELSE '' END AS text FROM conversations),
r AS (SELECT * FROM b UNION ALL SELECT conv_id, turn + 1000, role, text FROM b WHERE role = 'assistant' AND conv_id % 4 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, md5(left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 400)) AS sig FROM r),
l AS (SELECT conv_id, sum(n) AS loop_turns, count(*) AS sigs FROM (SELECT conv_id, sig, count(*) AS n FROM o WHERE role = 'assistant' AND length(text) >= 1500 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
v AS (SELECT conv_id, list_sort(list(length(text))) AS v FROM o WHERE role = 'assistant' GROUP BY 1)
SELECT o.conv_id, count(*) AS n_msgs, count(*) FILTER (role = 'assistant') AS n_assistant_turns, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS asst_chars_total, floor(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) / 3.5::DOUBLE)::BIGINT AS asst_tokens_est,
coalesce(any_value(v[-1]), 0)::BIGINT AS asst_per_turn_max, coalesce(any_value(v[round_even((len(v) - 1) * 0.9, 0)::INTEGER + 1]), 0)::BIGINT AS asst_per_turn_p90, coalesce(any_value(loop_turns), 0)::BIGINT AS loop_turns, coalesce(any_value(sigs), 0)::BIGINT AS loop_signatures_repeated,
count(*) FILTER (role = 'user' AND contains(text, '<returncode>0</returncode>') AND contains(text, 'no output')) AS empty_bash_outputs, count(*) FILTER (role = 'user' AND contains(text, 'died')) AS docker_death_msgs, coalesce(min(i) FILTER (role = 'user' AND contains(text, 'died')), -1) AS first_docker_death_msg, count(*) FILTER (role = 'user' AND contains(text, 'late')) AS litellm_timeout_msgs
FROM o LEFT JOIN l ON l.conv_id = o.conv_id LEFT JOIN v ON v.conv_id = o.conv_id GROUP BY 1""",
    "static_schedule": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents), s AS (SELECT *, k // 64 AS step, count(*) OVER (PARTITION BY k // 64) AS n FROM r)
SELECT doc_id, step, k % 64 // 8 AS micro, k % 64 // 8 % 4 AS dp_rank FROM s WHERE n = 64""",
}
