"""Schedules, permutations, clipped spans and algebraic grades over documents, orders, events and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths
from ..operators import permutation, schedule, spans
from .groups_q import _t

_C = F.col


def _scheduled(spark, d, plan, cap):
    docs = _t(spark, d, "documents").select("doc_id", F.expr("doc_id div 2").alias("rollout"), "n_chars")
    rows = schedule.schedule(docs, plan, "doc_id", "rollout", "n_chars").join(docs.select(_C("doc_id").alias("sample"), "n_chars"), "sample")
    bins = rows.groupBy("step", "rank", "micro_batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("tokens"))
    ranks = bins.groupBy("step", "rank").agg(F.count("*").alias("bins"), F.sum("n").alias("n"), F.bool_and((_C("tokens") <= cap) | (_C("n") == 1)).alias("fits"), F.sum("tokens").alias("tokens"))
    steps = ranks.groupBy("step").agg(
        F.count("*").alias("ranks"), F.sum("n").alias("samples"), F.sum("tokens").alias("tokens"), (F.min("bins") == F.max("bins")).alias("even"),
        F.bool_and(_C("bins") % plan.together == 0).alias("whole"), F.bool_and("fits").alias("fits"),
    )
    places = rows.groupBy("step").agg((F.count_distinct("sample") == F.count("*")).alias("once"))
    return steps.join(places, "step")


def full_schedule(spark, d):
    """Steps of 32 rollouts of two documents over four ranks, micro-batches within 40,000 characters in pairs."""
    return _scheduled(spark, d, schedule.Plan(32, 4, tokens=40_000, together=2, balance_ranks=True), 40_000)


def epoch_places(spark, d):
    rows = permutation.epoch_places(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42, 3)
    return rows.select("o_orderkey", "place")


def _trace_events(spark, d):
    """Blocks of four events a user: A starts, B starts in it, B may end, A may end; every fifth A begins a chain of parents."""
    e = _t(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    k, m = F.expr("r div 4"), _C("r") % 4
    a, b = F.concat(F.lit("A"), k.cast("string")), F.concat(F.lit("B"), k.cast("string"))
    kind = F.when(m < 2, "span_start").when((m == 2) & (_C("value") > 20), "span_end").when((m == 3) & ((_C("value") > 50) | (_C("value") < 5)), "span_end").otherwise("event")
    span = F.when(m == 0, a).when((m == 1) | (m == 2), b).when(_C("value") < 5, "zz").otherwise(a)
    parent = F.when(m == 0, F.when(k % 5 > 0, F.concat(F.lit("A"), (k - 1).cast("string")))).when(m < 3, a)
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(_C("user_id").alias("trace"), _C("event_id").alias("ord"), seconds.alias("ts"), kind.alias("kind"), span.alias("span"), parent.alias("parent"), _C("event_type").alias("name"))


def clipped_spans(spark, d):
    return spans.clipped_spans(_trace_events(spark, d))


def algebra_grades(spark, d):
    """Whether (x+a)^2 + y/2 is x^2 + bx + c + y/2, written in three ways."""
    a = (_C("p_size") + _C("p_partkey") % 2) % 10
    b, c = 2 * (_C("p_size") % 10), (_C("p_size") % 10) * (_C("p_size") % 10) + F.when(_C("p_partkey") % 3 == 0, 1).otherwise(0)
    said = F.format_string("so \\boxed{(x+%d)^2+\\frac{y}{2}}", a)
    truth = F.when(_C("p_partkey") % 2 == 0, F.format_string("x^2+%dx+%d+0.5y", b, c)).otherwise(F.format_string("\\frac{2x^2+y+%d+%d*x*2}{2}", 2 * c, b))
    rows = _t(spark, d, "part").select("p_partkey", said.alias("said"), truth.alias("truth"))
    return maths.graded_by_algebra(rows, "said", "truth").select("p_partkey", "right")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}


def _network_sql() -> str:
    """The rounds of the permutation, each a subquery over the one before."""
    p, m = permutation.PRIME, permutation.MULTIPLIER
    hashed = lambda x, k: f"((((({x} + {k}) % {p}) * (({x} + {k}) % {p}) + {k}) % {p}) * {m}) % {p}"
    inner = "SELECT o_orderkey, x, n, a, b, x // b AS l, x % b AS r FROM w WHERE fresh OR x >= n"
    for i, k in enumerate(permutation.round_keys(42, 3)):
        one = f"(l + {hashed('r', k)}) % a AS l, r" if i % 2 == 0 else f"l, (r + {hashed('l', k)}) % b AS r"
        inner = f"SELECT o_orderkey, n, a, b, {one} FROM ({inner})"
    return inner


SQL = {
    "full_schedule": """WITH f AS (SELECT doc_id // 2 AS rollout, min(doc_id) AS first FROM documents GROUP BY 1), o AS (SELECT rollout, (row_number() OVER (ORDER BY first) - 1) // 32 AS step FROM f),
k AS (SELECT step FROM o GROUP BY step HAVING count(*) = 32)
SELECT step, 4 AS ranks, count(*) AS samples, CAST(sum(n_chars) AS BIGINT) AS tokens, true AS even, true AS whole, true AS fits, true AS once FROM documents d JOIN o ON o.rollout = d.doc_id // 2 WHERE step IN (SELECT step FROM k) GROUP BY step""",
    "epoch_places": f"""WITH RECURSIVE c AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS a FROM orders),
w AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS x, n, a, (n + a - 1) // a AS b, true AS fresh FROM orders, c
UNION ALL SELECT o_orderkey, l * b + r, n, a, b, false FROM ({_network_sql()}))
SELECT o_orderkey, x AS place FROM w WHERE NOT fresh AND x < n""",
    "clipped_spans": """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events),
m AS (SELECT user_id AS trace, event_id AS ord, epoch_us(ts) AS ts, event_type AS name,
  CASE WHEN r % 4 < 2 THEN 'span_start' WHEN r % 4 = 2 AND value > 20 THEN 'span_end' WHEN r % 4 = 3 AND (value > 50 OR value < 5) THEN 'span_end' ELSE 'event' END AS kind,
  CASE WHEN r % 4 = 0 THEN 'A' || (r // 4) WHEN r % 4 < 3 THEN 'B' || (r // 4) WHEN value < 5 THEN 'zz' ELSE 'A' || (r // 4) END AS span,
  CASE WHEN r % 4 = 0 THEN CASE WHEN (r // 4) % 5 > 0 THEN 'A' || (r // 4 - 1) END WHEN r % 4 < 3 THEN 'A' || (r // 4) END AS parent FROM e),
s AS (SELECT a.trace, a.span, a.parent, a.name, a.ts AS start, (SELECT min(b.ts) FROM m b WHERE b.trace = a.trace AND b.span = a.span AND b.kind = 'span_end') AS "end" FROM m a WHERE a.kind = 'span_start'),
up AS (SELECT trace, span, parent AS at, NULL::BIGINT AS found, true AS live FROM s WHERE "end" IS NULL
  UNION ALL SELECT up.trace, up.span, s.parent, s."end", s."end" IS NULL FROM up JOIN s ON s.trace = up.trace AND s.span = up.at WHERE up.live),
anc AS (SELECT trace, span, max(found) AS found FROM up GROUP BY 1, 2), last AS (SELECT trace, max(ts) AS t FROM m GROUP BY 1),
o AS (SELECT s.*, last.t AS t1, (SELECT min(z.start) FROM s z WHERE z.trace = s.trace AND z.parent IS NOT DISTINCT FROM s.parent AND z.start > s.start) AS t2,
  CASE WHEN anc.found > s.start THEN anc.found END AS t3 FROM s JOIN last USING (trace) LEFT JOIN anc USING (trace, span) WHERE s."end" IS NULL),
p AS (SELECT *, least(t1, coalesce(t2, t1), coalesce(t3, t1)) AS best FROM o)
SELECT trace, span, parent, name, 'open_span' AS state, start, NULL::BIGINT AS "end", greatest(best, start) AS display_end,
  CASE WHEN best <= start THEN 'self' WHEN best = t1 THEN 'row_end' WHEN best = t2 THEN 'next_sibling_start' ELSE 'ancestor_end' END AS clipped_by FROM p
UNION ALL SELECT trace, span, parent, name, 'closed_span', start, "end", "end", NULL FROM s WHERE "end" IS NOT NULL
UNION ALL SELECT trace, span, parent, name, 'orphan_end', ts, ts, ts, NULL FROM m WHERE kind = 'span_end' AND span = 'zz'""",
    "algebra_grades": """SELECT p_partkey, 2 * ((p_size + p_partkey % 2) % 10) = 2 * (p_size % 10) AND ((p_size + p_partkey % 2) % 10) * ((p_size + p_partkey % 2) % 10) = (p_size % 10) * (p_size % 10) + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS "right" FROM part""",
}
