"""Rubric scores and search contexts over the lines of orders: an order is a group, a line a node."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import contexts as c
from ..operators import rubrics as r
from .groups_q import _SQL_LINES, _lines, _t

_C = F.col
_R9 = lambda name: F.round(name, 9).alias(name)


def _cells(spark, d):
    raw = F.array((_C("l_quantity").cast("int") % 5 + 1), (F.round(_C("l_discount") * 100).cast("int") % 5 + 1), (_C("pos") % 5 + 1).cast("int"))
    return _lines(spark, d).select(_C("l_orderkey").alias("g"), _C("pos").alias("node"), F.posexplode(raw).alias("k", "raw")).select("g", "node", (_C("k") + 1).alias("rubric"), "raw")


def _rubrics(spark, d):
    g = _t(spark, d, "lineitem").select(_C("l_orderkey").alias("g")).distinct()
    each = g.select("g", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rubric"))
    sign = F.when((_C("rubric") == 2) | ((_C("rubric") == 3) & (_C("g") % 4 == 0)), "negative").otherwise("positive")
    weight = F.when(_C("rubric") == 1, 1.5).when(_C("rubric") == 2, 1.0 + _C("g") % 3).otherwise(0.5)
    return each.select("g", "rubric", sign.alias("direction"), weight.alias("weight"))


def weighted_rubric_scores(spark, d):
    return r.weighted_scores(_cells(spark, d), _rubrics(spark, d))[0].select("g", "node", _R9("signed"), _R9("reward"))


def rubric_ranges(spark, d):
    out = r.weighted_scores(_cells(spark, d), _rubrics(spark, d))[1]
    f = _C("weighted_range")
    return out.select("g", _R9("weighted_range"), r.predicts_variance(f, 0.3137).alias("varies"), r.predicted_zero(_C("g") % 7 == 0, f, 0.3137).alias("zero"))


def rubric_weight_shares(spark, d):
    return r.weight_shares(_rubrics(spark, d)).select("g", "rubric", _R9("share"))


def _averages(relative, spark, d):
    cells = _cells(spark, d)
    scores = cells.where("raw < 5").withColumn("score", r.normalized_score(_C("raw")))
    return r.average_scores(cells.select("g", "node").distinct(), scores, _rubrics(spark, d).where("g % 9 > 0"), relative).select("g", "node", _R9("reward"))


average_rubric_scores = partial(_averages, False)
relative_rubric_scores = partial(_averages, True)


def rubric_score_records(spark, d):
    cells = _cells(spark, d).withColumn("raw", _C("raw") * 2 - 3).join(_rubrics(spark, d), ["g", "rubric"])
    cells = cells.select("g", "node", "rubric", r.score_record(_C("raw"), -_C("weight"), _C("direction")).alias("s"))
    return cells.select("g", "node", "rubric", "s.score_raw", "s.score_normalized", _C("s.weighted_score").alias("weighted"))


def distinct_rubrics(spark, d):
    rows = _lines(spark, d).select(_C("l_orderkey").alias("g"), F.floor("l_quantity").alias("rubric"), "pos", "l_discount")
    return r.distinct_rubrics(rows)


def _vectors(spark, d):
    cells = _cells(spark, d).groupBy("g", _C("rubric").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("node", "raw"))).alias("v"))
    return cells.select("g", "pos", F.transform("v", lambda x: r.normalized_score(x["raw"])).alias("vector"))


def redundancy(spark, d):
    return r.redundancy_rewards(_vectors(spark, d)).select("g", "pos", _R9("redundancy"))


def gap_correlations(spark, d):
    v = _vectors(spark, d)
    a, b = (v.where(f"pos = {k}").select("g", _C("vector").alias(n)) for k, n in ((1, "a"), (2, "b")))
    return a.join(b, "g").select("g", F.round(r.gap_correlation(_C("a"), _C("b")), 9).alias("correlation"), F.round(r.gap_redundancy(_C("a"), _C("b")), 9).alias("redundancy"))


def rubric_evaluations(spark, d):
    errors = _cells(spark, d).where("raw = 3 and g % 3 = 0").select("g", _C("rubric").alias("pos"))
    return r.rubric_evaluation(_vectors(spark, d), errors).select("g", "pos", *(F.round(c, 6).alias(c) for c in ("variance", "redundancy", "judge_error", "reward")))


def progress_rewards(spark, d):
    rows = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", (_C("l_discount") * 10).alias("t"), (_C("l_quantity") / 50).alias("p")))).alias("v"))
    return rows.select("l_orderkey", F.round(r.progress_reward(F.transform("v", lambda x: x["t"]), F.transform("v", lambda x: x["p"])), 9).alias("reward"))


def mixed_rubric_rewards(spark, d):
    part = lambda name, cut: F.when(_C(name) > cut, _C(name))
    value = r.mixed_reward(part("l_discount", 0.02), part("l_quantity", 9), _C("l_discount"), 0.5, 0.25, 1.0)
    return _lines(spark, d).select("l_orderkey", "pos", F.round(value, 9).alias("reward"), F.round(r.mixed_reward(_C("l_discount"), _C("l_quantity"), _C("l_discount"), 0, 0, 0), 9).alias("none"))


def rubric_turn_rewards(spark, d):
    rows = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "l_discount", "l_quantity"))).alias("v"))
    some = F.transform(F.filter("v", lambda x: x["l_discount"] > 0.03), lambda x: x["l_discount"])
    wrong = F.transform(F.filter("v", lambda x: x["l_quantity"] < 15), lambda x: x["pos"].cast("int"))
    out = rows.select("l_orderkey", F.posexplode(r.turn_rewards(F.size("v"), some, wrong)).alias("turn", "reward"))
    return out.withColumn("turn", _C("turn") + 1)


def collapse_overrides(spark, d):
    return r.collapse_overrides(_lines(spark, d), "l_orderkey", "l_quantity", _C("l_discount") < 0.02, 0.5).select("l_orderkey", "pos", "l_quantity", "overridden")


def metric_gate(spark, d):
    deltas = r.metric_deltas({"a": _C("l_discount"), "b": _C("l_quantity")}, {"a": F.lit(0.05), "b": F.lit(25)})
    return _lines(spark, d).select("l_orderkey", "pos", *(F.round(v, 9).alias(k) for k, v in deltas.items()), r.improved(deltas).alias("improved"))


def tie_break(spark, d):
    rows = _lines(spark, d).withColumn("score", F.floor(_C("l_discount") * 30)).withColumn("score", _C("score").cast("double"))
    return r.tie_break(rows, "l_orderkey", "pos", "score", "l_quantity").select("l_orderkey", "pos", F.round((_C("adjusted") - _C("score")) * 1234567.891, 3).alias("moved"))


def first_fitting_view(spark, d):
    return r.first_fitting(_lines(spark, d), "l_orderkey", "pos", "l_quantity", F.lit(20.0))


def best_branches(spark, d):
    return r.best_of(_lines(spark, d), "l_orderkey", "l_quantity", "pos", F.lit(2)).select("l_orderkey", "pos")


def weighted_branches(spark, d):
    return r.weighted_sample(_lines(spark, d), "l_orderkey", "l_quantity", "pos", F.lit(2), 7).select("l_orderkey", "pos")


def beam_branches(spark, d):
    rows = _lines(spark, d).withColumn("bad", _C("l_discount") < 0.04)
    return r.beam_branches(rows, "l_orderkey", "l_quantity", "pos", "bad", 2, 3).select("l_orderkey", "pos")


_JUDGED = ["3", " 3.0 ", "4/5", "4 / 5", "6", "2.5", "x", "", "5.0/5", "1"]


def judge_scores(spark, d):
    text = F.element_at(F.array(*map(F.lit, _JUDGED)), (_C("event_id") % 10 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("str", "float", "int", "bool"))), (F.floor(_C("value")) % 4 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", r.judge_score(text, kind).alias("score"))


# Contexts


def _nodes(spark, d):
    reward = F.when(_C("l_quantity") > 25, 2.0 + (_C("pos") % 2) * 1e-10).otherwise(_C("l_discount"))
    return _lines(spark, d).select(_C("l_orderkey").alias("round"), F.concat(F.lit("n"), _C("pos")).alias("node"), "pos", _C("l_discount").alias("score"), reward.alias("reward"),
                                   ((_C("pos") == 2) & (_C("l_orderkey") % 3 == 0)).alias("chosen"))


def _rounds(spark, d):
    return c.context_of_round(_nodes(spark, d).join(_nodes(spark, d).groupBy("round").count().where("count > 1"), "round", "left_semi"))


def round_contexts(spark, d):
    out = _rounds(spark, d)
    return out.select("round", F.array_join("node_ids", ",").alias("nodes"), "selected_node_id", "selection_source", "selection_success", F.round(F.element_at("judge_scores", _C("selected_node_id")), 9).alias("score"))


def reward_variance(spark, d):
    return _rounds(spark, d).select("round", c.has_variance(_C("node_ids"), _C("gt_rewards")).alias("varies"))


def variance_population(spark, d):
    rows = _rounds(spark, d).select(_C("round").alias("context_id"), (_C("round") % 5).alias("instance_id"), (_C("round") % 3).alias("round_index"), "node_ids", "gt_rewards")
    return c.variance_population(rows).select("context_id", "instance_id", "round_index")


def context_checks(spark, d):
    ids = F.when(_C("round") % 4 == 1, F.concat("node_ids", F.slice("node_ids", 1, 1))).otherwise(_C("node_ids"))
    rewards = F.when(_C("round") % 5 == 1, F.map_filter("gt_rewards", lambda k, v: k != "n1")).when(_C("round") % 5 != 2, _C("gt_rewards"))
    seen = F.when(_C("round") % 6 == 1, F.slice("node_ids", 2, 9)).otherwise(_C("node_ids"))
    return _rounds(spark, d).select("round", F.array_join(c.context_errors(ids, rewards, seen), "; ").alias("errors"))


def loaded_contexts(spark, d):
    rows = _rounds(spark, d).select(_C("round").alias("context_id"), "node_ids", "gt_rewards", _C("node_ids").alias("continuations"))
    return c.load_contexts(rows.unionByName(rows.where("context_id % 2 = 0"))).select("context_id", F.size("node_ids").alias("nodes"))


def selection_errors(spark, d):
    chosen = F.when(_C("round") % 3 > 0, _C("selected_node_id")).otherwise("")
    success = F.when(_C("round") % 2 + _C("round") % 3 == 0, _C("selection_success")).when(_C("round") % 3 == 0, F.lit(False))
    return _rounds(spark, d).select("round", c.selection_error(chosen, success, _C("gt_rewards")).alias("failed"))


def context_scopes(spark, d):
    return _rounds(spark, d).select("round", F.array_join(c.scopes(_C("selection_success"), _C("round") % 3 == 0), ",").alias("scopes"))


def selected_samples(spark, d):
    rows = _lines(spark, d).select(_C("l_orderkey").alias("round"), _C("pos").alias("sample_index"), ((_C("pos") == 3) & (_C("l_orderkey") % 2 == 0)).alias("selected"), (_C("l_orderkey") % 4).alias("round_index"))
    one, two = c.selected_sample(rows), c.selected_sample(rows, by_index=False)
    return one.join(two.withColumnRenamed("sample_index", "relative"), "round")


def landed_rewards(spark, d):
    nodes = _nodes(spark, d)
    records = nodes.where("round % 3 > 0").select(_C("round").alias("sample"), "node", "reward", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("rubric"))
    judged = nodes.select(_C("round").alias("sample"), "node", F.when(_C("pos") != 2, -_C("reward")).alias("reward"))
    return c.ground_truth_rewards(records, judged).select("sample", "node", _R9("reward"))


def _evaluations(spark, d):
    test = F.concat(F.lit("t"), _C("pos"))
    pick = lambda cond: F.collect_list(F.when(cond, test))
    rows = _lines(spark, d).groupBy("l_orderkey").agg(
        pick(_C("l_discount") > 0.03).alias("passed"), pick(_C("l_discount") <= 0.03).alias("failed"), pick(_C("pos") <= 2).alias("f2p"),
        pick((_C("pos") > 2) & (_C("l_orderkey") % 2 == 0)).alias("p2p"),
    )
    k = _C("l_orderkey") % 5
    status = F.when(k == 0, "empty").when(k == 1, "error").when(k == 2, "resolved").otherwise("unresolved")
    return rows.withColumn("status", status)


def evaluation_rewards(spark, d):
    args = (_C("status"), F.concat("passed", F.slice("passed", 1, 1)), _C("failed"), _C("f2p"), _C("p2p"), _C("l_orderkey") % 3 == 0)
    kinds = {kind: F.round(c.evaluation_reward(*args, kind=kind), 9).alias(kind) for kind in ("joint", "hard", "soft", "f2p_only")}
    return _evaluations(spark, d).select("l_orderkey", *kinds.values(), F.round(c.evaluation_reward(*args, alpha=0.5, fallback_penalty=0.5, no_action_penalty=-0.1), 9).alias("penalised"))


def report_tests(spark, d):
    rows = _lines(spark, d)
    name = F.concat(F.lit("t"), F.floor("l_quantity").cast("string"))
    groups = rows.select("l_orderkey", F.array(F.when(_C("l_discount") > 0.05, name).otherwise("")).alias("success"), F.array(F.when(_C("l_discount") <= 0.05, name).otherwise("")).alias("failure"))
    out = c.report_tests(groups, "l_orderkey")
    return out.select("l_orderkey", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed"))


def own_tests(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.when(_C("l_linenumber") != 3, F.concat(F.lit("t"), F.floor(_C("l_quantity") / 10).cast("string"))).alias("test"))
    return c.own_tests(rows, "l_orderkey", "l_returnflag", "test").select("l_orderkey", "l_returnflag", F.array_join("tests", ",").alias("tests"))


QUERIES = {k: v for k, v in list(globals().items()) if (isinstance(v, partial) or callable(v) and getattr(v, "__module__", "") == __name__) and not k.startswith("_")}

_SQL_CELLS = _SQL_LINES + """, c AS (SELECT l_orderkey AS g, pos AS node, k.rubric, CASE k.rubric WHEN 1 THEN l_quantity::INTEGER % 5 + 1 WHEN 2 THEN round(l_discount * 100)::INTEGER % 5 + 1 ELSE pos % 5 + 1 END AS raw FROM li, (VALUES (1), (2), (3)) k(rubric)),
ru AS (SELECT g, k.rubric, CASE WHEN k.rubric = 2 OR (k.rubric = 3 AND g % 4 = 0) THEN -1.0::DOUBLE ELSE 1.0 END AS sign, CASE k.rubric WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1 + g % 3 ELSE 0.5 END AS weight FROM (SELECT DISTINCT l_orderkey AS g FROM lineitem), (VALUES (1), (2), (3)) k(rubric)),
m AS (SELECT *, [1, 2, 4, 6, 8][raw]::DOUBLE AS mapped, (raw - 1) / 4.0::DOUBLE AS score FROM c JOIN ru USING (g, rubric))"""
_SQL_GAPS = _SQL_CELLS + """, e AS (SELECT x.g, x.rubric AS i, y.rubric AS j, avg(abs((x.score - x2.score) - (y.score - y2.score))) AS minus, avg(abs((x.score - x2.score) + (y.score - y2.score))) AS plus
 FROM m x JOIN m x2 ON x.g = x2.g AND x.rubric = x2.rubric AND x.node < x2.node JOIN m y ON y.g = x.g AND y.node = x.node AND y.rubric < x.rubric JOIN m y2 ON y2.g = x.g AND y2.node = x2.node AND y2.rubric = y.rubric GROUP BY 1, 2, 3),
rd AS (SELECT g, rubric AS pos, 1 - CASE WHEN rubric = 1 THEN 0 ELSE coalesce(max(1 - least(minus, plus)), 0) END AS redundancy FROM ru LEFT JOIN e USING (g) WHERE e.i IS NULL OR e.i = rubric OR rubric = 1 GROUP BY 1, 2)"""
_SQL_AVERAGE = _SQL_CELLS + """, w AS (SELECT g, rubric, sign, weight / sum(weight) OVER (PARTITION BY g) AS share FROM ru WHERE g % 9 > 0),
x AS (SELECT n.g, n.node, w.sign, w.share, coalesce(CASE WHEN c.raw < 5 THEN (c.raw - 1) / 4.0::DOUBLE END, 0) AS score FROM (SELECT DISTINCT g, node FROM c) n LEFT JOIN w USING (g) LEFT JOIN c ON c.g = n.g AND c.node = n.node AND c.rubric = w.rubric)"""
_SQL_NODES = _SQL_LINES + """, n AS (SELECT l_orderkey AS round, 'n' || pos AS node, pos, l_discount AS score, CASE WHEN l_quantity > 25 THEN 2 + (pos % 2) * 1e-10 ELSE l_discount END AS reward, pos = 2 AND l_orderkey % 3 = 0 AS chosen, count(*) OVER (PARTITION BY l_orderkey) AS size FROM li),
ro AS (SELECT round, list(node ORDER BY pos) AS nodes, coalesce(max(node) FILTER (chosen), arg_max(node, (score, node))) AS sel, max(node) FILTER (chosen) IS NOT NULL AS told, bool_or(abs(reward - 2) <= 2e-9) AND bool_or(abs(reward - 2) > 2e-9) AS varies FROM n WHERE size > 1 GROUP BY 1),
rs AS (SELECT ro.*, abs(reward - 2) <= 2e-9 AS success, score FROM ro JOIN n ON n.round = ro.round AND n.node = ro.sel)"""
_SQL_EVAL = _SQL_LINES + """, v AS (SELECT l_orderkey, count(*) FILTER (l_discount > 0.03) AS p, count(*) AS vis, count(*) FILTER (pos <= 2) AS f2p, count(*) FILTER (pos <= 2 AND l_discount > 0.03) AS f2pp, count(*) FILTER (pos > 2 AND l_orderkey % 2 = 0) AS p2p, count(*) FILTER (pos > 2 AND l_orderkey % 2 = 0 AND l_discount > 0.03) AS p2pp,
 CASE l_orderkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'error' WHEN 2 THEN 'resolved' ELSE 'unresolved' END AS status FROM li GROUP BY 1),
q AS (SELECT *, CASE WHEN f2p > 0 THEN f2pp::DOUBLE / f2p ELSE 1 END AS a, CASE WHEN p2p > 0 THEN p2pp::DOUBLE / p2p ELSE 1 END AS b, CASE status WHEN 'empty' THEN -0.2::DOUBLE WHEN 'error' THEN CASE WHEN l_orderkey % 3 = 0 THEN -0.5 ELSE 0 END END AS k, (status = 'resolved')::INTEGER::DOUBLE AS hard, CASE WHEN status = 'resolved' THEN 2.0::DOUBLE ELSE 1 END AS twice FROM v)"""
SQL = {
    "weighted_rubric_scores": _SQL_CELLS + " SELECT g, node, round(sum(mapped * weight * sign) / sum(weight), 9) AS signed, round(0.5 + sum(mapped * weight * sign) / sum(weight) / 16, 9) AS reward FROM m GROUP BY 1, 2",
    "rubric_ranges": _SQL_CELLS + ", s AS (SELECT g, rubric, (max(mapped) - min(mapped)) / 7 AS span, max(weight) AS weight FROM m GROUP BY 1, 2), f AS (SELECT g, sum(span * weight) / sum(weight) AS f FROM s GROUP BY 1) SELECT g, round(f, 9) AS weighted_range, f >= 0.3137::DOUBLE AS varies, g % 7 = 0 OR f < 0.3137::DOUBLE AS zero FROM f",
    "rubric_weight_shares": _SQL_CELLS + " SELECT g, rubric, round(weight / sum(weight) OVER (PARTITION BY g), 9) AS share FROM ru",
    "average_rubric_scores": _SQL_AVERAGE + " SELECT g, node, round(coalesce(sum(share * score * sign), 0), 9) AS reward FROM x GROUP BY 1, 2",
    "relative_rubric_scores": _SQL_AVERAGE + " SELECT g, node, round(coalesce(sum(share * CASE WHEN sign < 0 THEN 0.5 * (1 - score) ELSE score END), 0.5), 9) AS reward FROM x GROUP BY 1, 2",
    "rubric_score_records": _SQL_CELLS + ", s AS (SELECT *, raw * 2 - 3 AS r2 FROM m) SELECT g, node, rubric, r2::INTEGER AS score_raw, greatest(0, least(1, (r2 - 1) / 4.0::DOUBLE)) AS score_normalized, weight * greatest(0, least(1, (r2 - 1) / 4.0::DOUBLE)) * sign AS weighted FROM s",
    "distinct_rubrics": _SQL_LINES + " SELECT l_orderkey AS g, floor(l_quantity)::BIGINT AS rubric, min(pos) AS pos, arg_min(l_discount, pos) AS l_discount FROM li GROUP BY 1, 2",
    "redundancy": _SQL_GAPS + " SELECT g, pos, round(redundancy, 9) AS redundancy FROM rd",
    "gap_correlations": _SQL_GAPS + " SELECT q.g, round(coalesce(1 - minus, 0), 9) AS correlation, round(coalesce(1 - least(minus, plus), 0), 9) AS redundancy FROM (SELECT DISTINCT g FROM ru) q LEFT JOIN e ON e.g = q.g AND i = 2 AND j = 1",
    "rubric_evaluations": _SQL_GAPS + ", v AS (SELECT g, rubric AS pos, var_pop(score) AS variance, -0.2::DOUBLE * count(*) FILTER (raw = 3 AND g % 3 = 0) AS judge_error FROM m GROUP BY 1, 2) SELECT g, pos, round(variance, 6) AS variance, round(redundancy, 6) AS redundancy, round(judge_error, 6) AS judge_error, round(variance + redundancy + judge_error, 6) AS reward FROM v JOIN rd USING (g, pos)",
    "progress_rewards": _SQL_LINES + " SELECT l_orderkey, round(coalesce(avg(CASE WHEN l_discount * 10 > 0.5 THEN l_quantity / 50 - 0.5::DOUBLE WHEN l_discount * 10 < 0.5 THEN 0.5::DOUBLE - l_quantity / 50 END), 0), 9) AS reward FROM li GROUP BY 1",
    "mixed_rubric_rewards": _SQL_LINES + " SELECT l_orderkey, pos, round((CASE WHEN l_discount > 0.02 THEN 0.5 * l_discount ELSE 0 END + CASE WHEN l_quantity > 9 THEN 0.25 * l_quantity ELSE 0 END + l_discount) / 1.75::DOUBLE, 9) AS reward, 0.0::DOUBLE AS none FROM li",
    "rubric_turn_rewards": _SQL_LINES + """, w AS (SELECT l_orderkey, pos, l_quantity < 15 AS wrong, pos - count(*) FILTER (l_quantity < 15) OVER (PARTITION BY l_orderkey ORDER BY pos) AS k FROM li),
s AS (SELECT l_orderkey, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS k FROM li WHERE l_discount > 0.03)
SELECT w.l_orderkey, pos::INTEGER AS turn, CASE WHEN wrong THEN -1.0::DOUBLE ELSE coalesce(l_discount, 0) END AS reward FROM w LEFT JOIN s ON s.l_orderkey = w.l_orderkey AND s.k = w.k""",
    "collapse_overrides": _SQL_LINES + " SELECT l_orderkey, pos, CASE WHEN l_discount < 0.02 THEN min(l_quantity) OVER (PARTITION BY l_orderkey) - 0.5 ELSE l_quantity END AS l_quantity, l_discount < 0.02 AS overridden FROM li",
    "metric_gate": _SQL_LINES + " SELECT l_orderkey, pos, round(l_discount - 0.05, 9) AS a, round(l_quantity - 25, 9) AS b, l_discount - 0.05::DOUBLE > 1e-12 OR l_quantity - 25 > 1e-12 AS improved FROM li",
    "tie_break": _SQL_LINES + """, s AS (SELECT *, floor(l_discount * 30) AS score FROM li), t AS (SELECT *, score = max(score) OVER (PARTITION BY l_orderkey) AS top FROM s),
u AS (SELECT *, min(l_quantity) FILTER (top) OVER w AS lo, max(l_quantity) FILTER (top) OVER w AS hi FROM t WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, pos, round((CASE WHEN top AND hi > lo THEN score + 1e-6 * (l_quantity - lo) / (hi - lo) ELSE score END - score) * 1234567.891::DOUBLE, 3) AS moved FROM u""",
    "first_fitting_view": _SQL_LINES + " SELECT l_orderkey, min(pos) FILTER (l_quantity <= 20) AS pos FROM li GROUP BY 1",
    "best_branches": _SQL_LINES + " SELECT l_orderkey, pos FROM li QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, pos) <= 2",
    "beam_branches": _SQL_LINES + """, b AS (SELECT *, l_discount < 0.04 AS bad, row_number() OVER (PARTITION BY l_orderkey, l_discount < 0.04 ORDER BY l_quantity DESC, pos) AS k, count(*) FILTER (l_discount >= 0.04) OVER (PARTITION BY l_orderkey) AS good FROM li),
s AS (SELECT *, CASE WHEN least(3, good) >= 2 THEN least(3, good) - least(3, good) % 2 ELSE least(3, good) END AS keep FROM b WHERE good > 0)
SELECT l_orderkey, pos FROM s WHERE k <= CASE WHEN bad THEN greatest(0, 2 - keep) ELSE keep END""",
    "judge_scores": "WITH t AS (SELECT event_id, [" + ", ".join(f"'{v}'" for v in _JUDGED) + """][event_id % 10 + 1] AS t, ['str', 'float', 'int', 'bool'][floor(value)::INTEGER % 4 + 1] AS k FROM events),
v AS (SELECT event_id, CASE k WHEN 'str' THEN TRY_CAST(nullif(regexp_extract(trim(t, ' '), '^([1-5])(?:\\.0)?(?:\\s*/\\s*5)?$', 1), '') AS INTEGER) WHEN 'bool' THEN NULL ELSE CASE WHEN TRY_CAST(t AS DOUBLE) = floor(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE)::INTEGER END END AS s FROM t)
SELECT event_id, CASE WHEN s BETWEEN 1 AND 5 THEN s END AS score FROM v""",
    "round_contexts": _SQL_NODES + " SELECT round, array_to_string(nodes, ',') AS nodes, sel AS selected_node_id, CASE WHEN told THEN 'async_terminal_eval' ELSE 'max_siblings_score_fallback' END AS selection_source, success AS selection_success, round(score, 9) AS score FROM rs",
    "reward_variance": _SQL_NODES + " SELECT round, varies FROM ro",
    "variance_population": _SQL_NODES + " SELECT round AS context_id, round % 5 AS instance_id, round % 3 AS round_index FROM ro WHERE varies",
    "context_checks": _SQL_NODES + """ SELECT round, array_to_string(list_filter([CASE WHEN round % 5 = 2 THEN 'missing gt_rewards' END, CASE WHEN round % 4 = 1 THEN 'node_ids must be unique and contain >=2 nodes' END,
CASE WHEN round % 5 IN (1, 2) THEN 'gt_rewards do not cover every node' END, CASE WHEN round % 6 = 1 THEN 'visible continuations do not cover every node' END], lambda e: e IS NOT NULL), '; ') AS errors FROM ro""",
    "loaded_contexts": _SQL_NODES + " SELECT round AS context_id, len(nodes)::INTEGER AS nodes FROM ro WHERE varies",
    "selection_errors": _SQL_NODES + " SELECT round, CASE WHEN round % 3 > 0 THEN NOT success ELSE NOT (CASE WHEN round % 2 = 0 THEN success ELSE false END) END AS failed FROM rs",
    "context_scopes": _SQL_NODES + " SELECT round, array_to_string(list_filter([CASE WHEN success THEN 'siblings' END, CASE WHEN round % 3 = 0 THEN 'pc' END], lambda e: e IS NOT NULL), ',') AS scopes FROM rs",
    "selected_samples": _SQL_LINES + """, s AS (SELECT l_orderkey AS round, count(*) AS n, max(pos) AS last, max(pos) FILTER (pos = 3 AND l_orderkey % 2 = 0) AS flagged, max(pos) FILTER (pos = l_orderkey % 4) AS named FROM li GROUP BY 1)
SELECT round, coalesce(flagged, named, CASE WHEN n = 1 THEN last END) AS sample_index, coalesce(flagged, CASE WHEN n = 1 THEN last END) AS relative FROM s""",
    "landed_rewards": _SQL_NODES + " SELECT round AS sample, node, round(reward, 9) AS reward FROM n WHERE round % 3 > 0 UNION ALL SELECT round, node, round(-reward, 9) FROM n WHERE round % 3 = 0 AND pos <> 2",
    "evaluation_rewards": _SQL_EVAL + " SELECT l_orderkey, round(coalesce(k, (a - (1 - b)) * twice), 9) AS joint, round(coalesce(k, hard * twice), 9) AS hard, round(coalesce(k, p::DOUBLE / vis * twice), 9) AS soft, round(coalesce(k, a * twice), 9) AS f2p_only, round(coalesce(k, (a - 0.5 * (1 - b)) * twice * 0.5 - 0.1), 9) AS penalised FROM q",
    "report_tests": _SQL_LINES + " SELECT l_orderkey, coalesce(string_agg(DISTINCT 't' || floor(l_quantity)::BIGINT, ',' ORDER BY 't' || floor(l_quantity)::BIGINT) FILTER (l_discount > 0.05), '') AS passed, coalesce(string_agg(DISTINCT 't' || floor(l_quantity)::BIGINT, ',' ORDER BY 't' || floor(l_quantity)::BIGINT) FILTER (l_discount <= 0.05), '') AS failed FROM li GROUP BY 1",
    "own_tests": """WITH t AS (SELECT DISTINCT l_orderkey, l_returnflag, CASE WHEN l_linenumber <> 3 THEN 't' || floor(l_quantity / 10)::BIGINT END AS test FROM lineitem),
b AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM t GROUP BY 1), h AS (SELECT l_orderkey, test, count(*) AS held FROM t WHERE test IS NOT NULL GROUP BY 1, 2)
SELECT t.l_orderkey, t.l_returnflag, coalesce(string_agg(h.test, ',' ORDER BY h.test), '') AS tests FROM t JOIN b USING (l_orderkey) LEFT JOIN h ON h.l_orderkey = t.l_orderkey AND h.test = t.test AND h.held < b.n GROUP BY 1, 2""",
}
