"""Cards, weights, structured texts, maths answers and collapse over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths, structured
from ..operators import collapse, replay, weights
from ..sources.cursor import Cursor

THRESHOLD, WORDS, PHRASE_THRESHOLD = 0.5003, ["the", "license", "zzzz"], 0.45003


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _replays(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("scope"))
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_discount") * 100).alias("c")).join(part, "l_partkey")
    return lines.groupBy("scope", "l_orderkey").agg((F.avg("c") / 10).alias("pairwise"), F.collect_set("l_partkey").alias("retrieved"))


def _bank(spark, d):
    return _t(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("experience_id"), F.col("p_name").alias("title"))


def card_decisions(spark, d):
    out = replay.card_decisions(_bank(spark, d), _replays(spark, d), THRESHOLD)
    return out.withColumn("mean_pairwise", F.round("mean_pairwise", 9))


def filtered_bank(spark, d):
    bank = _bank(spark, d)
    return replay.counts(replay.filter_bank(bank, replay.card_decisions(bank, _replays(spark, d), THRESHOLD)))


_DECISIONS = f"""WITH r AS (SELECT p_brand AS scope, l_orderkey, avg(round(l_discount * 100)) / 10 AS pairwise, list(DISTINCT l_partkey) AS ids
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
s AS (SELECT scope, id, count(*) AS n, avg(pairwise) AS m FROM (SELECT scope, pairwise, unnest(ids) AS id FROM r) GROUP BY ALL),
dec AS (SELECT p_brand AS scope, p_partkey AS experience_id, p_brand NOT IN (SELECT scope FROM r) OR coalesce(m >= {THRESHOLD}, false) AS keep,
  CASE WHEN p_brand NOT IN (SELECT scope FROM r) THEN 'scope_not_evaluated' WHEN m >= {THRESHOLD} THEN 'kept' WHEN n IS NULL THEN 'never_retrieved'
  ELSE 'mean_judge_pairwise_accuracy_below_{THRESHOLD:g}' END AS reason, coalesce(n, 0) AS retrieval_count, round(m, 9) AS mean_pairwise
  FROM part LEFT JOIN s ON s.scope = p_brand AND s.id = p_partkey)
"""


def keyword_selection(spark, d):
    docs = _t(spark, d, "documents")
    results = docs.select(F.col("source").alias("scope"), ((F.col("n_chars") % 10) / 10).alias("pairwise"), F.array("lang").alias("retrieved"), F.col("text").alias("view"))
    cards = docs.select(F.col("source").alias("scope"), F.col("lang").alias("experience_id")).distinct()
    cards = cards.withColumn("selected_keywords", F.array(*map(F.lit, WORDS)))
    out = replay.keyword_selection(cards, results, PHRASE_THRESHOLD)
    return out.withColumn("selected_keywords", F.array_join("selected_keywords", ","))


def score_weights(spark, d):
    li = _t(spark, d, "lineitem")
    parts = {1: F.round(F.col("l_discount") * 100) - 5, 2: F.round(F.col("l_tax") * 100) - 4, 3: F.floor(F.col("l_quantity") / 10) - 2}
    # Lines lie by order before they are multiplied: a task then sums a share of them rather than what a file split makes.
    rows = li.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity").repartition("l_orderkey").select(
        F.col("l_linenumber").alias("draw"), F.col("l_orderkey").alias("pair"),
        F.explode(F.array(*(F.struct(F.lit(k).alias("rubric"), v.cast("long").alias("value")) for k, v in parts.items()))).alias("x"),
    ).select("draw", "pair", "x.*")
    nominal = rows.groupBy("pair", "rubric").agg(F.sum("value").alias("value"), F.max(F.lit(2)).alias("denominator"))
    vectors = {1: (10, 10, 10), 2: (5, 0, 20), 3: (1, 2, 0)}
    table = [(w, k + 1, v) for w, ws in vectors.items() for k, v in enumerate(ws)]
    ws = spark.createDataFrame(table, "weight_id int, rubric int, weight long")
    out = weights.rank_weights(weights.score_weights(rows, nominal, ws, ws.where("weight_id = 1").drop("weight_id"), 4))
    return out.select("weight_id", "robust_correct", "cvar10_correct", "nominal_correct", "active", "rank",
                      *(F.round(c, 6).alias(c) for c in ("signed_margin", "min_max_ratio", "l1")))


_WEIGHTS = """WITH w(weight_id, a, b, c) AS (VALUES (1, 10, 10, 10), (2, 5, 0, 20), (3, 1, 2, 0)),
x AS (SELECT l_linenumber AS draw, l_orderkey AS pair, sum(round(l_discount * 100) - 5)::BIGINT AS d1, sum(round(l_tax * 100) - 4)::BIGINT AS d2,
  sum(floor(l_quantity / 10) - 2)::BIGINT AS d3 FROM lineitem GROUP BY ALL),
g AS (SELECT weight_id, draw, count(*) FILTER (a * d1 + b * d2 + c * d3 > 0) AS correct FROM x, w GROUP BY ALL),
t AS (SELECT weight_id, sum(correct) AS robust_correct, min(correct) AS cvar10_correct FROM g GROUP BY ALL),
n AS (SELECT weight_id, count(*) FILTER (m > 0) AS nominal_correct, sum(m / 2) / (any_value(a + b + c) * 4) AS signed_margin
  FROM (SELECT weight_id, a, b, c, pair, sum(a * d1 + b * d2 + c * d3) AS m FROM x, w GROUP BY ALL) GROUP BY ALL),
k(weight_id, active, min_max_ratio, l1) AS (VALUES (1, 3, 1.0, 0.0), (2, 2, 0.25, 14 / 15), (3, 2, 0.5, 2 / 3))
SELECT weight_id, robust_correct::BIGINT AS robust_correct, cvar10_correct, nominal_correct, active::BIGINT AS active,
  round(signed_margin::DOUBLE, 6) AS signed_margin, round(min_max_ratio::DOUBLE, 6) AS min_max_ratio, round(l1::DOUBLE, 6) AS l1,
  row_number() OVER (ORDER BY robust_correct DESC, cvar10_correct DESC, nominal_correct DESC, signed_margin DESC, active, min_max_ratio DESC, l1, weight_id)::INTEGER AS rank
FROM t JOIN n USING (weight_id) JOIN k USING (weight_id)"""


def _call(tool, value):
    return F.concat(F.lit(f"<tool_call>\n<function={tool}><parameter=cmd> "), value, F.lit(" </parameter></function>\n</tool_call>"))


def _shape(key, *shapes):
    """One of the shapes by key."""
    out = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        out = F.when(F.col(key) % len(shapes) == k, shape).otherwise(out)
    return out


def tool_calls(spark, d):
    body = _shape(
        "doc_id", F.concat(F.lit("see "), _call("run", F.col("source")), _call("none", F.col("lang")), F.lit(" end")), F.concat(_call("edit", F.col("lang")), F.lit("and "), _call("run", F.col("text"))),
        F.col("text"), F.concat(F.lit("<tool_call><function=run><parameter=cmd>1</parameter><parameter=cmd>"), "source", F.lit("</parameter></function></tool_call>")),
        F.concat(F.lit("<tool_call><function=run>"), "lang"),
    )
    found = _t(spark, d, "documents").select("doc_id", structured.tool_calls(body, ["run", "edit"]).alias("f"))
    return found.select("doc_id", F.md5(F.col("f.text").cast("binary")).alias("visible"), F.get("f.calls", 0)["name"].alias("name"),
                        F.md5(F.get("f.calls", 0)["input"]["cmd"].cast("binary")).alias("cmd"), F.size("f.calls").alias("calls"))


def last_json(spark, d):
    n = F.col("doc_id").cast("string")
    text = _shape(
        "doc_id", F.concat(F.lit('{"draft": 1} so {\n "id": '), n, F.lit('\n "why": not quoted\n}\nbye')), F.concat(F.lit('{"a": {"b": '), n, F.lit("}} tail {")), F.concat(F.lit("no object "), n),
        F.concat(F.lit("{'id': "), n, F.lit(", 'ok': True}")), F.concat(F.lit('{"x": [1, 2,], "n": '), n, F.lit(",} ")), F.concat("text", F.lit('{"lang": "'), "lang", F.lit('"}')),
    )
    return _t(spark, d, "documents").select("doc_id", structured.last_json(text).alias("found"))


def boxed_grade(spark, d):
    a, b = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    box = lambda *parts: F.concat(F.lit("\\boxed{1} then \\boxed{"), *parts, F.lit("}."))
    said = _shape("doc_id", box(F.lit("\\dfrac{"), a, F.lit("}{"), b, F.lit("}")), box(F.lit("("), a, F.lit(", "), b, F.lit(")")), box(F.lit("x="), a, F.lit("\\%")), a, box(a, F.lit(".0")))
    truth = _shape("doc_id", F.concat(a, F.lit("/"), b), F.concat(F.lit("("), a, F.lit(","), b, F.lit(")")), a, a, a)
    wrong = F.concat((F.col("doc_id") + 1).cast("string"), F.lit("/"), b)
    return _t(spark, d, "documents").select(
        "doc_id", maths.grade(said, truth).alias("right"), maths.grade(said, wrong).alias("wrong"), maths.last_boxed(said).alias("boxed"),
    )


def plain_answers(spark, d):
    n = F.col("n_chars").cast("string")
    text = _shape("doc_id", F.concat(F.lit("x = $1,"), F.lpad(n, 6, "0"), F.lit(" \\text{cm}$")), F.concat(F.lit("y=\\frac12 + "), n), F.concat(F.lit("\\boxed{\\sqrt3} "), n, F.lit("^\\circ")), F.concat(F.lit("\\text{the }"), n, F.lit(" units")))
    return _t(spark, d, "documents").select("doc_id", maths.plain_form(text).alias("form"))


def chat_mask(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.struct("role", F.sequence(F.lit(1), F.length("text") % 7 + 1).alias("ids"), F.lit(1).alias("train")).alias("m"))
    chats = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda s: s["m"]).alias("ms"))
    out = chats.select("conv_id", structured.chat_mask(F.col("ms"), 1).alias("s"))
    return out.select("conv_id", F.size("s.tokens").cast("long").alias("tokens"), F.aggregate("s.mask", F.lit(0), lambda a, x: a + x).cast("long").alias("trained"))


def cursor_take(spark, d):
    events = _t(spark, d, "events").select("event_id", F.col("event_id").alias("rank"))
    size = events.count()
    out, _ = Cursor(offset=size - 2, groups=5, samples=10).take(events, "rank", size, 4, 2)
    return out.select("event_id", "epoch", "group_index", "sample_index")


def collapse_reason(spark, d):
    rows = _t(spark, d, "conversations").withColumn("commands", F.array().cast("array<string>"))
    return collapse.collapse_reason(rows, "conv_id", "turn", "role", "text", "commands")


QUERIES = {f.__name__: f for f in (
    card_decisions, filtered_bank, keyword_selection, score_weights, tool_calls, last_json, boxed_grade, plain_answers, chat_mask, cursor_take, collapse_reason,
)}

SQL = {
    "card_decisions": _DECISIONS + "SELECT * FROM dec",
    "filtered_bank": _DECISIONS + "SELECT scope, count(*) AS experience_count FROM dec WHERE keep GROUP BY scope",
    "keyword_selection": f"""WITH w AS (SELECT unnest({WORDS}) AS w, unnest(range({len(WORDS)})) AS i),
h AS (SELECT source, lang, w, i, avg((n_chars % 10) / 10) AS m FROM documents, w WHERE contains(lower(text), w) GROUP BY ALL),
k AS (SELECT source, lang, string_agg(w, ',' ORDER BY i) AS kept FROM h WHERE m >= {PHRASE_THRESHOLD} GROUP BY ALL)
SELECT DISTINCT source AS scope, lang AS experience_id, coalesce(kept, '{','.join(WORDS)}') AS selected_keywords,
  CASE WHEN kept IS NULL THEN 'conservative_union_when_no_keyword_is_attributable' ELSE 'positive_joint_replay_evidence' END AS policy
FROM documents LEFT JOIN k USING (source, lang)""",
    "score_weights": _WEIGHTS,
    "tool_calls": r"""SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN 'see <tool_call>' || chr(10) || '<function=none><parameter=cmd> ' || lang || ' </parameter></function>' || chr(10) || '</tool_call> end' WHEN 1 THEN 'and ' WHEN 2 THEN text WHEN 3 THEN '' ELSE '<tool_call><function=run>' || lang END) AS visible,
CASE doc_id % 5 WHEN 0 THEN 'run' WHEN 1 THEN 'edit' WHEN 3 THEN 'run' END AS name, md5(CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN lang WHEN 3 THEN source END) AS cmd, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS calls FROM documents""",
    "last_json": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"id":' || doc_id || ',"why":"not quoted"}' WHEN 1 THEN '{"a":{"b":' || doc_id || '}}' WHEN 3 THEN '{"id":' || doc_id || ',"ok":true}' WHEN 4 THEN '{"n":' || doc_id || ',"x":[1,2]}' WHEN 5 THEN '{"lang":"' || lang || '"}' END AS found FROM documents""",
    "boxed_grade": r"""SELECT doc_id, doc_id % 5 IN (0, 1, 2) AS right, false AS wrong, CASE doc_id % 5 WHEN 0 THEN '\dfrac{' || doc_id || '}{' || n_chars || '}' WHEN 1 THEN '(' || doc_id || ', ' || n_chars || ')' WHEN 2 THEN 'x=' || doc_id || '\%' WHEN 4 THEN doc_id || '.0' END AS boxed FROM documents""",
    "plain_answers": r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '1' || lpad(n_chars::VARCHAR, 6, '0') WHEN 1 THEN '\frac{1}{2}+' || n_chars WHEN 2 THEN '\sqrt{3}' || n_chars ELSE 'the' || n_chars END AS form FROM documents""",
    "chat_mask": """SELECT conv_id, sum(length(text) % 7 + 1)::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN length(text) % 7 ELSE 0 END)::BIGINT AS trained
FROM conversations GROUP BY conv_id""",
    "cursor_take": """WITH n AS (SELECT count(*) AS n FROM events), p AS (SELECT i, c, (n - 2 + i) % n AS r, (n - 2 + i) // n AS epoch
  FROM n, range(4) a(i), range(2) b(c))
SELECT event_id, epoch::INTEGER AS epoch, 5 + i AS group_index, 10 + 2 * i + c AS sample_index FROM p JOIN events ON event_id = r""",
}
