"""Buffers, batches, updates, spans, sessions and weights over orders, events and parts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import flow as f
from ..operators import packing, trajectories
from ..operators import weights as w
from .groups_q import _SQL_LINES, _lines, _t

_C = F.col


def drained_buffer(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return f.drain_first(o.where("o_orderkey % 40 = 7"), o.where("o_orderkey % 40 <> 7"), "o_orderkey", 300)


def stale_groups(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", (_C("l_orderkey") % 4 + 6).alias("rollout"), F.concat(F.lit("policy-"), (8 - _C("l_orderkey") % 5).cast("string")).alias("version"))
    return f.drop_stale(rows, "l_orderkey", "rollout", "version", 9).select("l_orderkey", f.checked_lag(_C("lag"), 4, "buffer").alias("lag"), "disposition")


def excess_rows(spark, d):
    from ..operators.order import with_rank

    return f.excess(with_rank(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey"), "rank", 700).select("o_orderkey", "reason")


def usage_prefixes(spark, d):
    k = _C("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", f.usage_prefix(F.lit("train"), _C("o_orderstatus"), (k % 20000).cast("int"), _C("o_orderpriority"), k.cast("int"), F.when(k % 3 == 0, "swe").when(k % 3 == 1, "")).alias("prefix"))


def endpoint_batches(spark, d):
    tasks = _t(spark, d, "orders").select(F.concat(F.lit("http://"), (_C("o_custkey") % 7).cast("string")).alias("endpoint"), "o_orderkey")
    return f.endpoint_batches(tasks, "endpoint", "o_orderkey", 17)


def inverse_permutations(spark, d):
    rows = _lines(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    return f.inverse_permutation(rows.withColumn("to", n + 1 - _C("pos")).withColumn("pos", _C("pos").cast("long")), "l_orderkey", "pos", "to")


def changed_rows(spark, d):
    p = _t(spark, d, "part")
    value = F.when(_C("p_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(_C("p_retailprice"))
    now = p.select("p_partkey", value.alias("v")).where("p_partkey % 11 > 0")
    then = p.select("p_partkey", F.when(_C("p_partkey") % 7 == 0, -value).otherwise(value).alias("v")).where("p_partkey % 13 > 0")
    return f.changed_rows(now, then, "p_partkey", "v")


def first_seen_groups(spark, d):
    return f.first_seen_groups(_t(spark, d, "events"), "event_type", "event_id")


def bank_updates(spark, d):
    rows = _lines(spark, d).select("l_orderkey", F.concat(F.when(_C("pos") % 2 == 0, "T").otherwise("t"), F.floor(_C("l_quantity") / 8).cast("string")).alias("title"), "pos", "l_discount")
    return f.bank_update(rows.where("pos <= 4"), rows.where("pos >= 3"), "l_orderkey", "title", "pos", "l_discount", 3)


def replaced_values(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return f.replaced(o, o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", -_C("o_totalprice")), "o_orderkey", "o_totalprice")


def improving_candidates(spark, d):
    p = _t(spark, d, "part")
    return f.improving_candidates(p.select("p_partkey", (_C("p_size") % 7).alias("before")), p.select("p_partkey", (_C("p_size") % 5).alias("after")), "p_partkey", "before", "after")


def pair_matrices(spark, d):
    rows = _lines(spark, d)
    cells = rows.select("l_orderkey", "pos", F.explode(F.array(F.struct(F.lit(1).alias("c"), F.floor("l_quantity").alias("s")), F.struct(F.lit(2).alias("c"), F.floor(_C("l_discount") * 100).alias("s")))).alias("e"), F.floor(_C("l_quantity") / 10).alias("reward"))
    out = f.pair_matrix(cells.select("l_orderkey", "pos", "e.c", "e.s", "reward"), "l_orderkey", "pos", "c", "s", "reward")
    return out.select("l_orderkey", "left", "right", "sign", F.array_join(_C("deltas").cast("array<string>"), ",").alias("deltas"))


def first_accepted(spark, d):
    return f.first_accepted(_lines(spark, d).withColumn("ok", _C("l_discount") > 0.06), ["l_orderkey"], "pos", "ok")


def outcome_rewards(spark, d):
    rows = _lines(spark, d).withColumn("r", F.when(_C("l_quantity") > 20, 1.0).otherwise(0.0))
    return f.outcome_rewards(rows, "l_orderkey", "r", _C("pos") == 2, 1.2, 0.8).select("l_orderkey", "pos", F.round("scaled", 9).alias("scaled"))


def child_spans(spark, d):
    rows = _lines(spark, d).select("l_orderkey", "pos", (_C("l_orderkey") * 10.0).alias("start"), (_C("l_quantity") - 5).alias("duration"))
    return f.child_spans(rows, "l_orderkey", "pos", "start", "duration")


def paired_spans(spark, d):
    ev = _t(spark, d, "events").select("user_id", F.when(_C("event_id") % 9 > 0, F.floor(_C("event_id") / 3)).alias("span"), F.when(_C("event_id") % 7 > 0, _C("event_id").cast("double")).alias("ts"),
                                       F.when(_C("event_id") % 2 == 0, "span_start").otherwise("span_end").alias("kind"), F.lit(1e9).alias("last"))
    return f.paired_spans(ev, "user_id", "span", "ts", "kind", "last")


def stack_parents(spark, d):
    """Each user's events open or close spans; the parent is the span left open last."""
    from ..operators import events

    ev = _t(spark, d, "events").select(_C("user_id").cast("string").alias("trace"), "event_id", F.when(_C("event_id") % 3 < 2, "span_start").otherwise("span_end").alias("kind"), (_C("event_id") % 5).cast("string").alias("span"))
    out = events.stack_parents(ev, "trace", "event_id", "kind", "span")
    return out.groupBy("trace").agg(F.count("parent").alias("nested"), F.count(F.lit(1)).alias("n"))


def inferred_sources(spark, d):
    k = _C("doc_id")
    meta = F.map_from_arrays(F.array(F.lit("source"), F.lit("source_name"), F.lit("my_Source_url")), F.array(F.when(k % 3 == 0, _C("lang")).otherwise(""), F.when(k % 4 == 0, "named"), F.when(k % 5 > 0, "else").otherwise("")))
    return _t(spark, d, "documents").select("doc_id", f.inferred_source(F.when(k % 2 == 0, _C("source")).otherwise(""), meta).alias("found"))


def merged_settings(spark, d):
    k = _C("doc_id")
    one = lambda a, b: F.map_from_arrays(F.array(F.lit("rm_type"), F.lit("x")), F.array(a, b))
    over = F.when(k % 3 == 0, F.map_from_arrays(F.array(F.lit("x")), F.array(F.lit("over")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = f.merged_metadata(one(F.lit("f1"), _C("lang")), F.when(k % 2 == 0, "gpqa"), over)
    setting = f.resolved(F.when(k % 4 == 0, k), F.when(k % 3 == 0, -k), F.lit(7))
    return _t(spark, d, "documents").select("doc_id", F.element_at(merged, F.lit("rm_type")).alias("rm_type"), F.element_at(merged, F.lit("x")).alias("x"), setting.alias("setting"))


def patch_texts(spark, d):
    k = _C("doc_id")
    warning = "sh: cwd [gone]"
    patch = F.when(k % 4 == 0, F.concat(F.lit(f"{warning}\n{warning}\n"), "text")).when(k % 4 == 1, f"{warning}\n \n").when(k % 4 == 2, F.concat("text", F.lit("\n")))
    return _t(spark, d, "documents").select("doc_id", F.md5(f.patch_text(patch, warning).cast("binary")).alias("patch"))


def role_counts(spark, d):
    return _t(spark, d, "conversations").groupBy(f.known_roles(_C("role")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def group_normalized(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = f.group_normalized(rows, "l_orderkey", "l_quantity")
    return out.groupBy("l_orderkey").agg(F.round(F.sum(F.col("normalized") * _C("normalized")), 6).alias("squares"))


def short_prompts(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.when(_C("doc_id") % 5 > 0, F.split("text", " ")).alias("t"))
    return f.short_prompts(rows, "t", 200).select("doc_id")


def chosen_instances(spark, d):
    return f.chosen_instances(_t(spark, d, "part").select("p_name", "p_partkey").groupBy("p_name").agg(F.min("p_partkey").alias("k")), "p_name", "[a-m]", 3, 60)


def mount_depths(spark, d):
    m = _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit("\x1f"), x["text"])).alias("m"))
    known = m.select("conv_id", F.slice("m", 1, 3).alias("m"))
    asked = m.select("conv_id", F.lit(0).alias("k"), "m").unionByName(m.select("conv_id", F.lit(1).alias("k"), F.concat(F.slice("m", 1, 1), F.array(F.lit("user\x1fnew"))).alias("m")))
    return trajectories.mount_depths(asked, known, "conv_id", "k", "m").select("conv_id", "k", _C("depth").cast("long").alias("depth"))


def drift_classes(spark, d):
    v = F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_quantity"))), lambda x: x["l_quantity"].cast("int"))
    rows = _lines(spark, d).groupBy("l_orderkey").agg(v.alias("held"))
    k = _C("l_orderkey")
    prompt = F.when(k % 3 == 0, F.concat("held", F.array(F.lit(1)))).when(k % 3 == 1, F.transform("held", lambda x, i: F.when(i == 2, 0).otherwise(x))).otherwise(F.slice("held", 1, 2))
    return rows.select("l_orderkey", trajectories.drift_class(_C("held"), prompt, F.lit(2), (k % 2000).cast("int")).alias("kind"))


def session_samples(spark, d):
    """Every conversation replayed turn by turn: a prompt is all messages before an assistant's, tokens are lengths of texts."""
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    each = c.select("conv_id", "m", F.posexplode("m").alias("i", "x")).where("x.role = 'assistant' and i > 0")
    text = lambda x: F.concat(x["role"], F.lit("\x1f"), x["text"])
    ids = lambda ms: F.transform(ms, lambda x: F.length(x["text"]))
    before = F.slice("m", 1, _C("i"))
    turns = each.select(_C("conv_id").alias("session"), _C("x.turn").alias("turn"), F.transform(before, text).alias("messages"), text(_C("x")).alias("answer"), ids(before).alias("prompt_ids"),
                        F.array(F.length("x.text"), F.lit(1)).alias("output_ids"), F.array(F.lit(-0.5), F.lit(-0.25)).alias("logprobs"), (_C("conv_id") % 3).cast("double").alias("reward"))
    out = trajectories.session_samples(turns)
    return out.select("session", "sample", "response_length", F.aggregate("loss_mask", F.lit(0), lambda s, m: s + m).alias("trained"), F.round("reward", 6).alias("reward"))


def _packed(method, spark, d):
    docs = _t(spark, d, "documents").select((_C("doc_id") - _C("doc_id") % 64).alias("step"), "doc_id", "n_chars")
    return packing.pack(docs, "step", "doc_id", "n_chars", method)


grown_bins = partial(_packed, partial(packing.grow_bins, capacity=40000, count=12))
least_loaded = partial(_packed, lambda sizes: packing.least_loaded([s % 7 for s in sizes], len(sizes)))


def grid_weights(spark, d):
    rows = _lines(spark, d).withColumn("v", F.when(_C("l_orderkey") % 3 == 0, _C("l_quantity") * 3 - 20).otherwise(_C("l_discount") * 100 - 3))
    return w.grid_weights(rows, "l_orderkey", "pos", "v", 3)


def distinct_weight_rows(spark, d):
    rows = _lines(spark, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_quantity"))), lambda x: F.floor(x["l_quantity"] / 20)).alias("v"))
    rows = rows.select((_C("l_orderkey") % 10).alias("g"), _C("l_orderkey").alias("pos"), "v")
    return w.distinct_vectors(rows, "g", "pos", "v", 3).select("g", "pos", F.array_join(_C("v").cast("array<string>"), ",").alias("v"))


def cluster_weights(spark, d):
    rows = _lines(spark, d).select(_C("l_orderkey").alias("instance"), _C("pos").alias("rubric"), F.when(_C("l_orderkey") % 4 > 0, _C("l_quantity")).otherwise(0.0).alias("weight"), "l_discount")
    members = rows.where("rubric = 3").select("instance", F.col("rubric").alias("member"), F.lit(1).alias("keep"))
    initial = rows.select("instance", "rubric", F.floor(_C("l_discount") * 100).alias("numerator"), F.lit(4).alias("denominator"))
    return w.cluster_weights(rows, members, initial).select("instance", "rubric", F.round("weight", 6).alias("weight"))


def balanced_offsets(spark, d):
    out = w.balanced_offsets(50, _t(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "panel")
    return out.groupBy("s_suppkey").agg(F.count_if(_C("offset") == -1).alias("down"), F.count_if(_C("offset") == 1).alias("up"), F.count(F.lit(1)).alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if (isinstance(v, partial) or callable(v) and getattr(v, "__module__", "") == __name__) and not k.startswith("_")}

_MS = "WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
SQL = {
    "drained_buffer": "SELECT o_orderkey, o_orderkey % 40 = 7 AS buffered FROM orders ORDER BY 2 DESC, 1 LIMIT 300",
    "stale_groups": "SELECT DISTINCT l_orderkey, (l_orderkey % 5)::INTEGER AS lag, CASE WHEN l_orderkey % 4 + 6 >= 8 AND l_orderkey % 5 <= 1 THEN 'kept' ELSE 'dropped:stale' END AS disposition FROM lineitem",
    "excess_rows": "SELECT o_orderkey, 'excess_after_quota' AS reason FROM orders ORDER BY o_orderkey OFFSET 700",
    "usage_prefixes": "SELECT o_orderkey, 'train/attempt-' || o_orderstatus || printf('/r%04d', o_orderkey % 20000) || CASE WHEN o_orderkey % 3 = 0 THEN '/swe' ELSE '' END || '/' || o_orderpriority || printf('/t%06d', o_orderkey) AS prefix FROM orders",
    "endpoint_batches": """WITH t AS (SELECT 'http://' || o_custkey % 7 AS endpoint, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS k FROM orders),
e AS (SELECT endpoint, count(*) AS n, row_number() OVER (ORDER BY endpoint) - 1 AS i, count(*) OVER () AS e FROM t GROUP BY 1), s AS (SELECT endpoint, least(n, 1 + greatest(0, 17 - e) // e + (i < greatest(0, 17 - e) % e)::INTEGER) AS s FROM e) SELECT endpoint, o_orderkey, (k % s)::INTEGER AS slot FROM t JOIN s USING (endpoint)""",
    "inverse_permutations": _SQL_LINES + " SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) + 1 - pos AS pos, pos AS source FROM li",
    "changed_rows": "SELECT p_partkey FROM part WHERE (p_partkey % 11 = 0) <> (p_partkey % 13 = 0) OR (p_partkey % 11 > 0 AND p_partkey % 13 > 0 AND p_partkey % 7 = 0 AND p_partkey % 5 > 0)",
    "first_seen_groups": "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1",
    "bank_updates": _SQL_LINES + """, r AS (SELECT l_orderkey, CASE WHEN pos % 2 = 0 THEN 'T' ELSE 't' END || floor(l_quantity / 8)::BIGINT AS title, 't' || floor(l_quantity / 8)::BIGINT AS k, pos, l_discount FROM li),
n AS (SELECT l_orderkey, k, arg_max(title, pos) AS title, arg_max(l_discount, pos) AS l_discount, min(pos) AS pos FROM r WHERE pos >= 3 GROUP BY 1, 2), a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) <= 3),
o AS (SELECT l_orderkey, k, arg_min(title, pos) AS title, arg_min(l_discount, pos) AS l_discount, min(pos) AS pos FROM r WHERE pos <= 4 GROUP BY 1, 2)
SELECT l_orderkey, title, l_discount, pos, true AS active FROM a UNION ALL SELECT l_orderkey, title, l_discount, pos, false FROM o ANTI JOIN a USING (l_orderkey, k)""",
    "replaced_values": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders",
    "improving_candidates": "SELECT p_partkey, p_size % 7 AS before, p_size % 5 AS after FROM part WHERE p_size % 5 > p_size % 7",
    "pair_matrices": _SQL_LINES + """ SELECT a.l_orderkey, a.pos AS left, b.pos AS right, CASE WHEN floor(a.l_quantity / 10) > floor(b.l_quantity / 10) THEN 1 ELSE -1 END AS sign, (floor(a.l_quantity) - floor(b.l_quantity))::BIGINT || ',' || (floor(a.l_discount * 100) - floor(b.l_discount * 100))::BIGINT AS deltas
FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos WHERE floor(a.l_quantity / 10) <> floor(b.l_quantity / 10)""",
    "first_accepted": _SQL_LINES + " SELECT l_orderkey, min(pos) FILTER (l_discount > 0.06) AS pos FROM li GROUP BY 1",
    "outcome_rewards": _SQL_LINES + " SELECT l_orderkey, pos, round((l_quantity > 20)::INTEGER * CASE WHEN coalesce(max((l_quantity > 20)::INTEGER) FILTER (pos = 2) OVER (PARTITION BY l_orderkey) > 0, false) THEN 1.2::DOUBLE ELSE 0.8 END, 9) AS scaled FROM li",
    "child_spans": _SQL_LINES + ", s AS (SELECT l_orderkey, pos, l_quantity - 5 AS d, sum(l_quantity - 5) OVER (PARTITION BY l_orderkey ORDER BY pos) AS u FROM li WHERE l_quantity > 5) SELECT l_orderkey, pos, l_orderkey * 10.0::DOUBLE + u - d AS begin, l_orderkey * 10.0::DOUBLE + u AS \"end\" FROM s",
    "paired_spans": """WITH b AS (SELECT user_id, event_id // 3 AS span, min(event_id) FILTER (event_id % 2 = 0)::DOUBLE AS s, max(event_id) FILTER (event_id % 2 = 1)::DOUBLE AS e FROM events WHERE event_id % 9 > 0 AND event_id % 7 > 0 GROUP BY 1, 2)
SELECT user_id, span, coalesce(s, e) AS begin, greatest(coalesce(e, 1e9::DOUBLE), coalesce(s, e)) AS "end", e IS NULL AS open FROM b""",
    "inferred_sources": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND source <> '' THEN source WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 4 = 0 THEN 'named' WHEN doc_id % 5 > 0 THEN 'else' END AS found FROM documents",
    "merged_settings": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'gpqa' ELSE 'f1' END AS rm_type, CASE WHEN doc_id % 3 = 0 THEN 'over' ELSE lang END AS x, CASE WHEN doc_id % 4 = 0 THEN doc_id WHEN doc_id % 3 = 0 THEN -doc_id ELSE 7 END AS setting FROM documents",
    "patch_texts": "WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 2 THEN text ELSE '' END AS t FROM documents) SELECT doc_id, md5(CASE WHEN NOT regexp_matches(t, '\\S') THEN '' WHEN doc_id % 4 = 2 THEN t || chr(10) WHEN suffix(t, chr(10)) THEN t ELSE t || chr(10) END) AS patch FROM p",
    "role_counts": "SELECT role, count(*) AS n FROM conversations GROUP BY 1",
    "group_normalized": "WITH z AS (SELECT l_orderkey, (l_quantity - avg(l_quantity) OVER w) / (stddev_samp(l_quantity) OVER w + 1e-6) AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, round(sum(z * z), 6) AS squares FROM z GROUP BY 1",
    "short_prompts": "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR len(string_split(text, ' ')) <= 200",
    "chosen_instances": "SELECT p_name, min(p_partkey) AS k FROM part WHERE regexp_matches(p_name, '^[a-m]') GROUP BY 1 ORDER BY 1 LIMIT 57 OFFSET 3",
    "mount_depths": _MS + ", c AS (SELECT conv_id, max(n) AS n, max(CASE WHEN i = 2 THEN role = 'user' AND text = 'new' END) AS same FROM m GROUP BY 1) SELECT conv_id, 0 AS k, least(n, 3) AS depth FROM c UNION ALL SELECT conv_id, 1, CASE WHEN same THEN 2 ELSE 1 END FROM c",
    "drift_classes": _SQL_LINES + """, h AS (SELECT l_orderkey, count(*) AS n, max(l_quantity::INTEGER) FILTER (pos = 3) AS third FROM li GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'clean' WHEN l_orderkey % 3 = 1 THEN CASE WHEN n < 3 OR third = 0 THEN 'clean' WHEN l_orderkey % 2000 < 1024 THEN 'realign' ELSE 'fork' END ELSE CASE WHEN n <= 2 THEN 'clean' WHEN l_orderkey % 2000 < 1024 THEN 'realign' ELSE 'fork' END END AS kind FROM h""",
    "grid_weights": _SQL_LINES + """, v AS (SELECT l_orderkey, pos, greatest(CASE WHEN l_orderkey % 3 = 0 THEN l_quantity * 3 - 20 ELSE l_discount * 100 - 3 END, 0) AS x FROM li), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x DESC, pos) AS k, max(x) OVER (PARTITION BY l_orderkey) AS top FROM v),
s AS (SELECT l_orderkey, pos, round_even(CASE WHEN top > 0 THEN CASE WHEN k <= 3 THEN x ELSE 0 END WHEN pos = 1 THEN 1 ELSE 0 END * CASE WHEN top > 50 THEN 50.0::DOUBLE / top ELSE 1 END, 0)::INTEGER AS t FROM k) SELECT l_orderkey, pos, CASE WHEN t > 0 THEN least(greatest(t, 5), 50) ELSE 0 END AS tenths FROM s""",
    "distinct_weight_rows": _SQL_LINES + ", v AS (SELECT l_orderkey % 10 AS g, l_orderkey AS pos, array_to_string(list(floor(l_quantity / 20)::BIGINT ORDER BY li.pos), ',') AS v, count(*) AS n FROM li GROUP BY 1, 2) SELECT g, min(pos) AS pos, v FROM v WHERE n = 3 GROUP BY g, v",
    "cluster_weights": _SQL_LINES + """, r AS (SELECT l_orderkey AS instance, pos, CASE WHEN l_orderkey % 4 > 0 THEN l_quantity ELSE 0 END AS weight, floor(l_discount * 100) / 4.0::DOUBLE AS first FROM li), t AS (SELECT instance, CASE WHEN pos = 3 THEN 1 ELSE pos END AS rubric, sum(weight) AS s FROM r GROUP BY 1, 2),
b AS (SELECT r.instance, r.pos, first, coalesce(s, 0) AS s, max(s) OVER (PARTITION BY r.instance) AS top FROM r LEFT JOIN t ON t.instance = r.instance AND t.rubric = r.pos) SELECT instance, pos::VARCHAR AS rubric, round(CASE WHEN top > 0 THEN s * (50.0::DOUBLE / top) ELSE first END, 6) AS weight FROM b""",
    "balanced_offsets": "SELECT s_suppkey, 5::BIGINT AS down, 5::BIGINT AS up, 50::BIGINT AS n FROM supplier",
}
