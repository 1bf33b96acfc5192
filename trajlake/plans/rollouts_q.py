"""Rollout metrics, conversions and invariants: a user is a group, an event a sample, an order's lines a token sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as k
from ..operators import rollouts as o
from .groups_q import _SQL_LINES, _lines, _t
from .tokens_q import _MM, _W, _Z, _seq

_C = F.col
_R6 = lambda df, *keep: df.select(*keep, *(F.round(c, 6).alias(c) for c, t in df.dtypes if t == "double" and c not in keep), *(c for c, t in df.dtypes if t != "double" and c not in keep))


def _samples(spark, d):
    n = F.floor("value").cast("long")
    return _t(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", n.alias("length"), (n % 7).alias("cached"), (n % 5 + n % 7).alias("prompt_tokens"),
        (n % 3).alias("accepted"), (n % 4).alias("drafted"), (n % 6).alias("steps"), F.when(_C("event_type") == "click", _C("value") % 3).otherwise(0.0).alias("waiting"),
    )


def sample_metrics(spark, d):
    return _R6(o.sample_metrics(_samples(spark, d), _C("event_type") == "error", _C("length") > 150))


def speed_metrics(spark, d):
    rows = _samples(spark, d).withColumn("length", F.least("length", F.lit(120)))
    return _R6(o.speed_metrics(rows, 30.0, 8))


def kept_vocabulary(spark, d):
    v = F.array_sort(F.collect_list(F.struct("pos", _C("l_quantity").cast("int").alias("q"))))
    rows = _lines(spark, d).groupBy("l_orderkey").agg(v.alias("v"))
    running = F.transform(F.sequence(F.lit(0), F.size("v")), lambda i: F.aggregate(F.slice("v", 1, i), F.lit(0), lambda s, x: s + x["q"]))
    mask = F.when(_C("l_orderkey") % 3 > 0, F.transform("v", lambda x: (x["q"] % 2).cast("int")))
    rows = rows.select(F.when(_C("l_orderkey") % 7 > 0, running).alias("offsets"), mask.alias("mask"), (_C("l_orderkey") % 5 == 0).alias("removed"))
    return _R6(o.kept_vocabulary(rows))


def request_metrics(spark, d):
    rows = _samples(spark, d).select("value", F.when(_C("length") % 5 == 0, F.lit(float("nan"))).when(_C("length") % 5 == 1, F.lit(float("inf"))).when(_C("length") % 5 > 2, _C("value") / 3).alias("prefill"), "waiting")
    return _R6(o.request_metrics(rows, ["value", "prefill", "waiting"]), "metric")


def eval_metrics(spark, d):
    return _R6(o.eval_metrics(_samples(spark, d), "event_type", "value", _C("length") > 100), "event_type")


def turn_metrics(spark, d):
    rows = _seq(spark, d).select("m", (_C("user_id") % 4).alias("rounds"))
    return _R6(o.turn_metrics(rows, "m", "rounds", 60))


def step_metrics(spark, d):
    a = o.step_metrics(_samples(spark, d), "event_type", "value", "length", True, 64, 2)
    b = o.step_metrics(_samples(spark, d), "event_type", "value", "length", False, 64)
    return _R6(a.join(b.withColumnRenamed("mean", "by_batch"), "event_type"), "event_type")


def rank_contributions(spark, d):
    by = _samples(spark, d).groupBy("user_id").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return by.select("user_id", o.rank_contribution(_C("v"), 2, _C("n"), 4).alias("c")).select("user_id", F.round("c.sum", 6).alias("total"), F.round("c.count", 6).alias("count"))


def group_meta(spark, d):
    return _R6(o.group_meta(_samples(spark, d), "user_id", "value"))


def usage_fractions(spark, d):
    by = _samples(spark, d).groupBy("user_id").agg(F.count_if(_C("event_type") != "view").alias("r"), F.count_if(_C("event_type") == "click").alias("m"), F.count_if(_C("event_type") == "error").alias("f"))
    by = by.select("user_id", o.usage_fractions(_C("r"), _C("m"), _C("f")).alias("u"), o.training_progress(_C("r"), _C("m"), _C("f")).alias("p"))
    return by.select("user_id", F.round("u.exact", 6).alias("exact"), F.round("u.failed", 6).alias("failed"), F.round("p.epoch", 6).alias("epoch"))


def train_speed(spark, d):
    n = lambda c, m: (_C(c) % m).cast("double")
    rows = _samples(spark, d).select("event_id", n("length", 5).alias("log_probs_time"), n("length", 3).alias("actor_train_time"), n("length", 4).alias("train_time"), n("length", 2).alias("train_wait_time"), "length",
                                     F.round(k.flops(_C("length"), 64, 8, 2, 1000, 256, 3) / 1e6, 6).alias("flops"))
    return _R6(o.train_speed(rows, "flops", "length"), "event_id")


def head_and_tail(spark, d):
    from ..operators.order import with_rank

    rows = with_rank(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return o.head_and_tail(rows, "rank", rows.count(), 0.013).select("o_orderkey")


def filled_ids(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.when(_C("o_orderkey") % 4 > 0, _C("o_custkey") * 2).alias("rollout_id"))
    return o.fill_ids(rows, "o_orderkey", "rollout_id")


def _mask_rows(spark, d):
    v = F.array_sort(F.collect_list(F.struct("pos", (_C("l_quantity") % 2).cast("int").alias("m"))))
    rows = _lines(spark, d).groupBy("l_orderkey").agg(v.alias("v"))
    return rows.select("l_orderkey", (_C("l_orderkey") % 40).alias("rollout"), F.size("v").alias("response_length"), F.transform("v", lambda x: x["m"]).alias("loss_mask"))


def rollout_mask_sums(spark, d):
    return o.mask_sums(_mask_rows(spark, d), "rollout", "loss_mask").select("l_orderkey", _C("rollout_mask_sum").cast("long").alias("rollout_mask_sum"))


def training_rows(spark, d):
    key = _C("l_orderkey")
    rows = _mask_rows(spark, d).select("l_orderkey", "response_length", F.when(key % 3 > 0, _C("loss_mask")).alias("loss_mask"), (key % 5 == 0).alias("removed"), F.when(key % 4 == 0, "truncated").when(key % 4 == 1, "completed").alias("status"))
    return o.training_rows(rows).select("l_orderkey", F.array_join(_C("loss_mask").cast("array<string>"), "").alias("mask"), "truncated")


def compact_errors(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", F.when(_C("l_linenumber") != 4, _C("l_orderkey") % 50 + F.when(_C("l_discount") > 0.09, 1).otherwise(0)).alias("rollout"))
    return o.compact_errors(rows, "l_orderkey", "rollout")


def exact_token_errors(spark, d):
    m = _t(spark, d, "conversations")
    ids = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: i)
    n = F.coalesce(F.length("text"), F.lit(0)) % 5
    messages = m.select("conv_id", "turn", "role", F.when(n > 0, ids).alias("prompt_token_ids"), ids.alias("token_ids"), F.when(n == 1, F.array(F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.when(n == 2, F.lit(float("nan"))).otherwise(0.2), F.lit(0.3))).alias("logprobs"), F.when(_C("turn") % 3 == 0, "stop").when(_C("turn") % 3 == 1, "").alias("finish_reason"))
    return o.exact_token_errors(messages, "conv_id", "turn")


def length_errors(spark, d):
    rows = _mask_rows(spark, d)
    key, n = _C("l_orderkey"), _C("response_length")
    mask = F.when(key % 3 == 0, F.slice("loss_mask", 1, F.greatest(n - 1, F.lit(0)))).otherwise(_C("loss_mask"))
    logprobs = F.when(key % 4 > 0, F.transform("loss_mask", lambda m: m + 0.5))
    ids = F.when(key % 5 != 1, F.sequence(F.lit(1), n + 1))
    offsets = F.when(key % 5 != 2, F.sequence(F.lit(0), F.when(key % 7 == 0, n + 1).otherwise(n)))
    return rows.select("l_orderkey", F.array_join(o.length_errors(n, mask, logprobs, ids, offsets), ",").alias("errors"))


def appended_tokens(spark, d):
    key, n = _C("l_orderkey"), _C("response_length")
    trained = key % 2 == 0
    new = F.sequence(F.lit(1), n)
    out = o.append_tokens(F.array(F.lit(9), F.lit(8)), F.lit(1), F.when(key % 3 == 0, F.array(F.lit(0))), F.array(F.lit(-1.0)), new, F.when(trained, F.transform(new, lambda i: i / 4)), trained)
    rows = _mask_rows(spark, d).select("l_orderkey", out.alias("a"))
    return rows.select("l_orderkey", F.size("a.tokens").alias("tokens"), "a.response_length", F.array_join(_C("a.loss_mask").cast("array<string>"), "").alias("mask"), F.round(k.total(_C("a.logprobs")), 6).alias("logprobs"))


def cut_samples(spark, d):
    n = _C("response_length")
    tokens = F.concat(F.array(F.lit(7), F.lit(7)), F.transform("loss_mask", lambda m: m + 1))
    rows = _mask_rows(spark, d).select("l_orderkey", o.cut_sample(tokens, F.concat(F.array(F.lit(0), F.lit(0)), "loss_mask"), n, F.transform("loss_mask", lambda m: m / 2), 5).alias("c"))
    return rows.select("l_orderkey", F.array_join(_C("c.tokens").cast("array<string>"), "").alias("tokens"), F.array_join(_C("c.loss_mask").cast("array<string>"), "").alias("mask"), "c.response_length", "c.status", "c.cut", F.round(k.total(_C("c.logprobs")), 6).alias("logprobs"))


def parsed_messages(spark, d):
    m = _t(spark, d, "conversations")
    k3 = _C("turn") % 3
    text = F.when(k3 == 0, F.concat(F.lit("a</think>\n\n"), "text")).when(k3 == 1, _C("text"))
    role = F.when(_C("turn") % 7 == 6, "exit").otherwise(_C("role"))
    out = o.parsed_message(role, text, F.lit("fallback"), F.when(_C("turn") % 5 == 0, "raw"), F.when(_C("conv_id") % 2 == 0, "").otherwise("boom"))
    return m.select("conv_id", "turn", out.alias("p")).where("p is not null").select("conv_id", "turn", "p.role", F.md5(_C("p.text").cast("binary")).alias("text"), F.md5(_C("p.plain").cast("binary")).alias("plain"))


def normalized_usages(spark, d):
    n = _C("length")
    pick = lambda m, c: F.when(n % m > 0, c)
    out = o.normalized_usage(pick(2, n - 5), pick(3, n), pick(4, n % 9), pick(5, n % 8), pick(7, n % 50 - 3), pick(2, n + 1), pick(3, n + 2), n % 11 > 2)
    return _samples(spark, d).select("event_id", out.alias("u")).select("event_id", "u.*")


def first_completed_groups(spark, d):
    groups = _samples(spark, d).groupBy("user_id").agg(F.max("event_id").alias("done"), F.min("event_id").alias("index"), F.stddev_samp("value").alias("sd"))
    return o.first_completed(groups, "done", F.when(_C("user_id") % 3 > 0, _C("sd") > 40), 5, "index").select("user_id", "index")


def run_health(spark, d):
    n = _C("length")
    rows = _samples(spark, d).select(_C("event_type").alias("run"), n.alias("turns"), (n % 6).alias("loop_turns"), (n % 5).alias("empty_outputs"), (n % 3).alias("timeouts"), (n % 2 == 0).alias("submitted"), (n % 9 == 0).alias("invalid"), F.when(n % 4 > 0, _C("user_id")).alias("group"))
    return o.run_health(rows, "run")


def rank_summaries(spark, d):
    rows = _t(spark, d, "part").select((_C("p_partkey") % 8).alias("rank"), F.when(_C("p_size") % 3 == 0, "NvJet GEMM").when(_C("p_size") % 3 == 1, "NCCL Communication").otherwise("Other Compute").alias("kind"), "p_retailprice", _C("p_size").cast("double").alias("busy"))
    return _R6(o.rank_summary(rows, "rank", "kind", "p_retailprice", "busy", 0.5), "rank")


def sequence_objectives(spark, d):
    out = k.policy_objective(_C("p"), _C("o"), _C("a"), _C("m"), 0.2, 0.3, F.transform("m", lambda m: m * 0.5 + 0.25), 0.1, _C("o"))
    rows = _seq(spark, d).select("user_id", out.alias("v"), k.distilled(_C("a"), _C("p"), _C("o"), 0.5).alias("w"))
    return rows.select("user_id", *(F.round(f"v.{c}", 6).alias(c) for c in ("pg_loss", "clip_fraction", "kl", "kl_loss", "loss")), F.round(k.total(_C("w")), 6).alias("distilled"))


def sequence_perplexities(spark, d):
    rows = _seq(spark, d).select("user_id", k.perplexities(_C("p"), _C("o"), _C("m")).alias("v"))
    # Means of few decimals often end in exact halves; the factor keeps both sides off them.
    off = {c: _C(c) * 0.98765 for c in ("training_log_ppl", "rollout_log_ppl", "kl", "log_ppl_diff", "log_ppl_abs_diff")}
    return _R6(rows.select("user_id", "v.*").withColumns(off | {"chi2_seq": F.least("chi2_seq", F.lit(1000.0))}), "user_id")


def estimators(spark, d):
    kinds = ("grpo", "ppo", "reinforce_plus_plus", "reinforce_plus_plus_baseline")
    make = lambda kind: F.round(k.total(k.advantages(kind, F.lit(2.0), _C("y"), _C("a"), _C("m"), 0.9, 0.8, 0.1)), 6).alias(kind)
    return _seq(spark, d).select("user_id", *map(make, kinds))


def pooled_vectors(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", _C("embedding").cast("array<double>").alias("v"))
    vectors = F.array("v", F.transform("v", lambda x: -2.0 * x), F.reverse("v"))
    mask = F.array(F.lit(1.0), (_C("vec_id") % 2).cast("double"), F.lit(1.0))
    dot = lambda x: F.aggregate(F.zip_with(x, "v", lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    return e.select("vec_id", F.round(dot(k.pooled(vectors, mask)), 6).alias("mean"), F.round(dot(k.pooled(vectors, mask, "cls")), 6).alias("cls"))


def weight_fractions(spark, d):
    w = F.transform("x", lambda v: v)
    out = k.truncated_importance(_C("a"), _C("p"), _C("o"), 0.9, 1.05)
    rows = _seq(spark, d).select("user_id", "m", k.weight_fractions(w, _C("m"), 0.2, 0.9).alias("f"), out.alias("t"), k.value_clip_fraction(_C("x"), _C("y"), _C("m"), 0.05).alias("v"))
    return rows.select("user_id", F.round("f.high", 6).alias("high"), F.round("f.low", 6).alias("low"), F.round(k.total(_C("t.loss")), 6).alias("loss"), F.round(k.masked_mean(_C("t.clipped"), _C("m")), 6).alias("clipped"),
                       F.round(k.masked_mean(_C("t.distance"), _C("m")), 6).alias("distance"), F.round("v", 6).alias("moved"))


def group_diagnostics(spark, d):
    from ..operators import groups

    key = _C("l_orderkey")
    rows = _lines(spark, d).select("l_orderkey", "pos", F.when((key % 11 > 0) | (_C("pos") > 1), F.floor(_C("l_quantity") / 20)).alias("truth"), F.when((key % 13 > 0) | (_C("pos") > 1), _C("l_discount")).alias("judged"), (key % 3 == 0).alias("zero"), (key % 6 == 0).alias("quiet"))
    return groups.group_diagnostics(rows, "l_orderkey", "pos", "truth", "judged", "zero", "quiet")


def length_quartiles(spark, d):
    from ..operators import groups

    return _R6(groups.length_quartiles(_t(spark, d, "events").where("event_type = 'click'"), "value", 120))


def top_gaps(spark, d):
    from ..operators import events

    ev = _t(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(_C("ts").cast("timestamp")).alias("s"), (F.unix_micros(_C("ts").cast("timestamp")) + (_C("value") * 1e7).cast("long")).alias("t"))
    return events.top_gaps(ev.where("event_type <> 'error'"), "user_id", "s", "t", ev.where("event_type = 'error'"), "event_id", "event_type", 15)


def response_tails(spark, d):
    return _seq(spark, d).select("user_id", F.round(k.total(k.tail(_C("x"), (_C("user_id") % 9).cast("int"))), 6).alias("value"))


def span_samples(spark, d):
    """An order's lines are turns: each prompt holds all tokens so far and one more."""
    v = F.array_sort(F.collect_list(F.struct("pos", _C("l_quantity").cast("int").alias("q"))))
    rows = _lines(spark, d).groupBy("l_orderkey").agg(v.alias("v"))
    told = lambda i: F.flatten(F.transform(F.slice("v", 1, i), lambda x: F.array(F.lit(0), x["q"], x["q"] + 1)))
    turns = F.transform("v", lambda x, i: F.struct(F.concat(told(i), F.array(F.lit(0))).alias("prompt"), F.array(x["q"], x["q"] + 1).alias("ids"), F.array(x["q"] / 2, F.when(x["q"] == 7, F.lit(float("nan"))).otherwise(0.5)).alias("logprobs")))
    out = rows.select("l_orderkey", o.span_sample(turns).alias("s"))
    join = lambda c: F.array_join(_C(c).cast("array<string>"), ",")
    return out.select("l_orderkey", F.size("s.tokens").alias("tokens"), join("s.loss_mask").alias("mask"), "s.response_length", F.round(k.total(_C("s.logprobs")), 6).alias("logprobs"))


def message_cards(spark, d):
    return o.message_cards(_t(spark, d, "conversations"), "conv_id", "turn").select("conv_id", _C("step").cast("long").alias("step"), "assistant_pos", F.md5(_C("observation").cast("binary")).alias("observation"))


def budgeted_rows(spark, d):
    return o.within_budget(_lines(spark, d), "l_orderkey", "pos", "l_quantity", 60).select("l_orderkey", "pos")


def epoch_orders(spark, d):
    rows = o.epoch_order(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42, 3)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("places"), F.count_if(_C("place") == F.xxhash64("o_orderkey", F.lit(45))).alias("same"))


QUERIES = {q: v for q, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not q.startswith("_")}

_S = """WITH s AS (SELECT event_id, user_id, event_type, value, n AS length, n % 7 AS cached, n % 5 + n % 7 AS prompt_tokens, n % 3 AS accepted, n % 4 AS drafted, n % 6 AS steps, CASE WHEN event_type = 'click' THEN value % 3 ELSE 0 END AS waiting
FROM (SELECT *, floor(value)::BIGINT AS n FROM events))"""
_STAT = lambda c, p: ", ".join(f"round({f}({c}), 6) AS {p}_{n}" for n, f in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min")))
_MASKS = _SQL_LINES + ", mr AS (SELECT l_orderkey, l_orderkey % 40 AS rollout, count(*)::INTEGER AS n, list((l_quantity % 2)::INTEGER ORDER BY pos) AS m FROM li GROUP BY 1)"
_RR = lambda c: f"round({c}, 6) AS {c}"
SQL = {
    "sample_metrics": _S + " SELECT " + _STAT("length", "response_len").replace("round(max(length), 6)", "max(length)").replace("round(min(length), 6)", "min(length)") + """, round(avg((length > 150)::INTEGER), 6) AS repetition_frac, round(avg((event_type = 'error')::INTEGER), 6) AS truncated_ratio,
round(sum(cached)::DOUBLE / sum(prompt_tokens), 6) AS prefix_cache_hit_rate, round(sum(cached)::DOUBLE / count(*), 6) AS avg_cached_tokens_per_sample, round(avg(CASE WHEN drafted > 0 THEN accepted::DOUBLE / drafted ELSE 0 END), 6) AS spec_accept_rate, round(avg(CASE WHEN steps > 0 THEN accepted::DOUBLE / steps ELSE 0 END), 6) AS spec_accept_length FROM s""",
    "speed_metrics": _S + """, t AS (SELECT least(length, 120) AS n, waiting FROM s), m AS (SELECT max(n) AS top, sum(n) AS total, max(waiting) AS w FROM t), g AS (SELECT top, total, CASE WHEN w > 0 THEN avg(waiting) END AS r FROM t JOIN m ON n = top GROUP BY top, total, w)
SELECT round(total / 30.0::DOUBLE / 8, 6) AS tokens_per_gpu_per_sec, round(top / 30.0::DOUBLE, 6) AS longest_tokens_per_sec, round(r, 6) AS longest_non_generation_time, round(top / (30 - r), 6) AS longest_tokens_per_sec_without_waiting FROM g""",
    "kept_vocabulary": _SQL_LINES + ", x AS (SELECT l_quantity::INTEGER AS q, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity::INTEGER % 2 ELSE 1 END AS m FROM li WHERE l_orderkey % 7 > 0 AND l_orderkey % 5 > 0) SELECT round(sum(q * m)::DOUBLE / sum(m), 6) AS top_p_kept_vocab_per_token FROM x",
    "request_metrics": _S + """, l AS (SELECT 'value' AS metric, value AS v FROM s UNION ALL SELECT 'prefill', value / 3 FROM s WHERE length % 5 > 2 UNION ALL SELECT 'waiting', waiting FROM s)
SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS max, round(min(v), 6) AS min FROM l GROUP BY 1""",
    "eval_metrics": _S + " SELECT event_type, round(avg(value), 6) AS reward, round(avg((length > 100)::INTEGER), 6) AS truncated_ratio FROM s GROUP BY 1",
    "turn_metrics": _W + """SELECT round(avg(n), 6) AS raw_mean, max(n)::INTEGER AS raw_max, min(n)::INTEGER AS raw_min, round(avg((n >= 60)::INTEGER), 6) AS clip_ratio, round(avg(ms), 6) AS wo_obs_mean, max(ms)::INTEGER AS wo_obs_max, min(ms)::INTEGER AS wo_obs_min,
round(avg(user_id % 4), 6) AS round_number_mean, max(user_id % 4) AS round_number_max, min(user_id % 4) AS round_number_min FROM q""",
    "step_metrics": _S + " SELECT event_type, round(sum(value) * 2 / sum(length), 6) AS mean, round(sum(value) / 64, 6) AS by_batch FROM s GROUP BY 1",
    "rank_contributions": _S + " SELECT user_id, round(sum(value) * 2, 6) AS total, round(count(*) / 4.0::DOUBLE, 6) AS count FROM s GROUP BY 1",
    "group_meta": _S + " SELECT count(*) AS total_samples, count(DISTINCT user_id) AS num_groups, round(count(*)::DOUBLE / count(DISTINCT user_id), 6) AS avg_group_size, round(avg(value), 6) AS avg_reward FROM s",
    "usage_fractions": _S + """, b AS (SELECT user_id, count(*) FILTER (event_type <> 'view')::DOUBLE AS r, count(*) FILTER (event_type = 'click') AS m, count(*) FILTER (event_type = 'error') AS f FROM s GROUP BY 1)
SELECT user_id, round(CASE WHEN r > 0 THEN (r - m) / r ELSE 1 END, 6) AS exact, round(CASE WHEN r > 0 THEN f / r ELSE 0 END, 6) AS failed, round(CASE WHEN f > 0 THEN r / f ELSE 0 END, 6) AS epoch FROM b""",
    "train_speed": _S + """, t AS (SELECT event_id, length, (length % 5)::DOUBLE AS log_probs_time, (length % 3)::DOUBLE AS actor_train_time, (length % 4)::DOUBLE AS train_time, (length % 2)::DOUBLE AS train_wait_time,
 round((3 * (2.0::DOUBLE * length * 64 * 64 + 4.0::DOUBLE * length * 64 * 2 * 8 + 2.0::DOUBLE * length * length * 64 + 2.0::DOUBLE * length * 64 * 64 + 6.0::DOUBLE * length * 64 * 256) + 2.0::DOUBLE * length * 64 * 1000) / 1e6, 6) AS flops FROM s)
SELECT event_id, log_probs_time, actor_train_time, train_time, train_wait_time, length, flops, round(flops / nullif(log_probs_time, 0), 6) AS log_probs_tflops, round(3 * flops / nullif(actor_train_time, 0), 6) AS actor_train_tflops,
round(length / nullif(actor_train_time, 0), 6) AS actor_train_tok_per_s, CASE WHEN train_wait_time + train_time > 0 THEN train_wait_time + train_time END AS step_time, round(train_wait_time / nullif(train_wait_time + train_time, 0), 6) AS wait_time_ratio FROM t""",
    "head_and_tail": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders), t AS (SELECT *, floor(n * 0.013::DOUBLE)::BIGINT AS k FROM r) SELECT o_orderkey FROM t WHERE r < k // 2 OR r >= n - (k - k // 2)",
    "filled_ids": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 2 END AS id FROM orders),
f AS (SELECT r, row_number() OVER (ORDER BY r) AS k FROM range((SELECT 2 * count(*) FROM orders)) t(r) WHERE r NOT IN (SELECT id FROM o WHERE id IS NOT NULL)),
m AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM o WHERE id IS NULL)
SELECT o_orderkey, id AS rollout_id FROM o WHERE id IS NOT NULL UNION ALL SELECT o_orderkey, r FROM m JOIN f USING (k)""",
    "rollout_mask_sums": _MASKS + " SELECT l_orderkey, sum(list_sum(m)) OVER (PARTITION BY rollout)::BIGINT AS rollout_mask_sum FROM mr",
    "training_rows": _MASKS + " SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN repeat('0', n) WHEN l_orderkey % 3 > 0 THEN array_to_string(m, '') ELSE repeat('1', n) END AS mask, (l_orderkey % 4 = 0)::INTEGER AS truncated FROM mr",
    "compact_errors": """WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber <> 4 THEN l_orderkey % 50 + CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END END AS r FROM lineitem),
b AS (SELECT l_orderkey, CASE WHEN count(r) < count(*) THEN 'rollout_id is unset' WHEN count(DISTINCT r) > 1 THEN 'siblings must share rollout_id' END AS error FROM r GROUP BY 1 HAVING count(*) > 1) SELECT * FROM b WHERE error IS NOT NULL""",
    "exact_token_errors": """WITH m AS (SELECT conv_id, turn, role, coalesce(length(text), 0) % 5 AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i, CASE turn % 3 WHEN 0 THEN 'stop' ELSE 'unknown' END AS why FROM conversations),
b AS (SELECT conv_id, arg_min('invalid_policy_completion:assistant_index=' || i || ':finish_reason=' || why || ':prompt_tokens=' || CASE WHEN n > 0 THEN 3 ELSE 0 END || ':output_tokens=3:logprobs=' || CASE WHEN n = 1 THEN 1 ELSE 3 END, i) AS e FROM m WHERE role = 'assistant' AND n IN (0, 1, 2) GROUP BY 1)
SELECT conv_id, CASE WHEN NOT bool_or(role = 'assistant') THEN 'invalid_policy_completion:no_assistant_turns' ELSE any_value(e) END AS error FROM m LEFT JOIN b USING (conv_id) GROUP BY 1""",
    "length_errors": _MASKS + """, e AS (SELECT l_orderkey, l_orderkey AS k, n FROM mr) SELECT l_orderkey, array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'loss_mask length' END, CASE WHEN k % 5 IN (1, 2) THEN 'top-p replay needs ids and offsets' END,
CASE WHEN k % 5 NOT IN (1, 2) AND k % 7 = 0 THEN 'offsets length' END, CASE WHEN k % 5 NOT IN (1, 2) AND k % 7 <> 0 THEN 'offsets and ids differ' END], lambda x: x IS NOT NULL), ',') AS errors FROM e""",
    "appended_tokens": _MASKS + " SELECT l_orderkey, (2 + n)::INTEGER AS tokens, (1 + n)::INTEGER AS response_length, CASE WHEN l_orderkey % 3 = 0 THEN '0' ELSE '1' END || repeat(CASE WHEN l_orderkey % 2 = 0 THEN '1' ELSE '0' END, n) AS mask, round(-1 + CASE WHEN l_orderkey % 2 = 0 THEN n * (n + 1) / 8.0::DOUBLE ELSE 0 END, 6) AS logprobs FROM mr",
    "cut_samples": _MASKS + " SELECT l_orderkey, '77' || array_to_string(list_transform(m[:3], lambda x: x + 1), '') AS tokens, array_to_string(m[:3], '') AS mask, least(n, 3)::INTEGER AS response_length, CASE WHEN n > 3 THEN 'truncated' ELSE 'completed' END AS status, greatest(0, n - 3)::INTEGER AS cut, round(list_sum(m[:3]) / 2.0::DOUBLE, 6) AS logprobs FROM mr",
    "parsed_messages": """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN 'exit' ELSE role END AS role, coalesce(CASE turn % 3 WHEN 0 THEN 'a</think>' || chr(10) || chr(10) || text WHEN 1 THEN text END, 'fallback') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, md5(CASE role WHEN 'assistant' THEN t WHEN 'exit' THEN CASE WHEN conv_id % 2 = 0 THEN t ELSE 'boom' END ELSE CASE WHEN turn % 5 = 0 THEN 'raw' ELSE t END END) AS text,
md5(CASE WHEN role = 'assistant' AND contains(t, '</think>') THEN ltrim(string_split(t, '</think>')[-1], chr(10) || chr(13)) END) AS plain FROM m WHERE role IN ('assistant', 'user', 'exit')""",
    "normalized_usages": _S + """, c AS (SELECT event_id, length AS n, CASE WHEN length % 2 > 0 AND length >= 5 THEN length - 5 END AS a, CASE WHEN length % 3 > 0 THEN length END AS b, CASE WHEN length % 4 > 0 THEN length % 9 END AS c, CASE WHEN length % 5 > 0 THEN length % 8 END AS d,
 CASE WHEN length % 7 > 0 AND length % 50 >= 3 THEN length % 50 - 3 END AS h, CASE WHEN length % 2 > 0 THEN length + 1 END AS ki, CASE WHEN length % 3 > 0 THEN length + 2 END AS ko, length % 11 > 2 AS p FROM s),
t AS (SELECT *, coalesce(a, b) AS i, coalesce(c, d) AS o FROM c), u AS (SELECT *, (i IS NULL AND ki IS NOT NULL) OR (o IS NULL AND ko IS NOT NULL) AS r, coalesce(i, ki) AS ii, coalesce(o, ko) AS oo FROM t)
SELECT event_id, coalesce(ii, 0) AS input_tokens, least(coalesce(ii, 0), coalesce(h, 0)) AS cached_input_tokens, coalesce(oo, 0) AS output_tokens, coalesce(ii, 0) + coalesce(oo, 0) AS total_tokens, ii IS NOT NULL AND oo IS NOT NULL AS exact_usage,
CASE WHEN r AND p THEN 'provider_and_token_ids' WHEN r THEN 'token_ids' WHEN p AND ii IS NOT NULL AND oo IS NOT NULL THEN 'provider' WHEN p THEN 'provider_partial' ELSE 'missing' END AS usage_source FROM u""",
    "first_completed_groups": _S + ", g AS (SELECT user_id, max(event_id) AS done, min(event_id) AS index, stddev_samp(value) AS sd FROM s GROUP BY 1) SELECT user_id, index FROM g WHERE user_id % 3 = 0 OR sd > 40 OR sd IS NULL ORDER BY done LIMIT 5",
    "run_health": _S + """, r AS (SELECT event_type AS run, length AS n, list_sort(list(length) OVER (PARTITION BY event_type)) AS v, CASE WHEN length % 4 > 0 THEN user_id END AS g FROM s),
g AS (SELECT run, count(*) FILTER (bad) AS dropped, round(count(*) FILTER (bad)::DOUBLE / count(*), 3) AS rate FROM (SELECT run, g, bool_or(n % 9 = 0) AS bad FROM r WHERE g IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT run, count(*) AS n, round(avg((n % 6 >= 4)::INTEGER), 3) AS looped_traj_rate, round(avg((n % 5 >= 3)::INTEGER), 3) AS empty_heavy_rate, round(avg((n % 3 > 0)::INTEGER), 3) AS timeout_rate, round(avg((n % 2 = 0)::INTEGER), 3) AS submitted_rate, round(avg((n % 9 = 0)::INTEGER), 3) AS invalid_rate,
""" + ", ".join(f"any_value(v[round_even((len(v) - 1) * {q}, 0)::INTEGER + 1]) AS turns_p{p}" for q, p in ((0.5, 50), (0.9, 90), (0.99, 99))) + ", max(n) AS turns_max, coalesce(any_value(dropped), 0) AS groups_dropped, coalesce(any_value(rate), 0) AS group_drop_rate FROM r LEFT JOIN g USING (run) GROUP BY run",
    "rank_summaries": """WITH b AS (SELECT p_partkey % 8 AS rank, sum(CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE 0 END) AS gemm, sum(CASE WHEN p_size % 3 = 1 THEN p_retailprice ELSE 0 END) AS nccl, avg(p_size) AS utilization FROM part GROUP BY 1),
s AS (SELECT *, max(utilization) OVER () - min(utilization) OVER () AS spread FROM b) SELECT rank, round(gemm, 6) AS gemm, round(nccl, 6) AS nccl, round(utilization, 6) AS utilization, round(spread, 6) AS spread, spread > 0.5 AS imbalance FROM s""",
    "sequence_objectives": _W + """, z AS (SELECT *, """ + _Z("greatest(-exp(p[i] - o[i]) * a[i], -greatest(least(exp(p[i] - o[i]), 1.3::DOUBLE), 0.8::DOUBLE) * a[i]) * (m[i] * 0.5 + 0.25) * m[i]") + " AS l, " + _Z("CASE WHEN -greatest(least(exp(p[i] - o[i]), 1.3::DOUBLE), 0.8::DOUBLE) * a[i] > -exp(p[i] - o[i]) * a[i] THEN m[i] ELSE 0 END") + " AS c, " + _Z("greatest(least(exp(o[i] - p[i]) - 1 + p[i] - o[i], 10), -10) * m[i]") + " AS r, " + _Z("(o[i] - p[i]) * m[i]") + " AS e, " + _Z("a[i] - 0.5::DOUBLE * (p[i] - o[i])") + """ AS w FROM q)
SELECT user_id, round(list_sum(l) / greatest(ms, 1), 6) AS pg_loss, round(list_sum(c) / greatest(ms, 1), 6) AS clip_fraction, round(list_sum(e) / greatest(ms, 1), 6) AS kl, round(list_sum(r) / greatest(ms, 1), 6) AS kl_loss, round((list_sum(l) + 0.1::DOUBLE * list_sum(r)) / greatest(ms, 1), 6) AS loss, round(list_sum(w), 6) AS distilled FROM z""",
    "sequence_perplexities": _W + ", z AS (SELECT user_id, greatest(ms, 1) AS d, " + ", ".join(f"list_sum({_Z(e)}) AS {n}" for n, e in (
        ("tp", "p[i] * m[i]"), ("rp", "o[i] * m[i]"), ("k3", "(exp(p[i] - o[i]) - (p[i] - o[i]) - 1) * m[i]"), ("x2", "exp(2 * greatest(least(p[i] - o[i], 20), -20)) * m[i]"), ("rs", "(p[i] - o[i]) * m[i]"))) + """ FROM q)
SELECT user_id, round(-tp / d * 0.98765::DOUBLE, 6) AS training_log_ppl, round(exp(-tp / d), 6) AS training_ppl, round(-rp / d * 0.98765::DOUBLE, 6) AS rollout_log_ppl, round(exp(-rp / d), 6) AS rollout_ppl, round((rp - tp) / d * 0.98765::DOUBLE, 6) AS kl, round(k3 / d, 6) AS k3_kl, round((rp - tp) / d * 0.98765::DOUBLE, 6) AS log_ppl_diff,
round(abs((rp - tp) / d) * 0.98765::DOUBLE, 6) AS log_ppl_abs_diff, round(exp((rp - tp) / d), 6) AS ppl_ratio, round(x2 / d - 1, 6) AS chi2_token, round(least(exp(2 * greatest(least(rs, 20), -20)) - 1, 1000), 6) AS chi2_seq FROM z""",
    "estimators": _W + ", z AS (SELECT *, " + _Z("-0.1::DOUBLE * a[i] + CASE WHEN i = n THEN 2 ELSE 0 END + 0.9::DOUBLE * coalesce(y[i + 1], 0) - y[i]") + " AS dl, " + _Z("-0.1::DOUBLE * a[i] * m[i] + CASE WHEN i = n - list_position(list_reverse(m), 1.0::DOUBLE) + 1 THEN 2 ELSE 0 END") + """ AS rw FROM q)
SELECT user_id, round(2.0::DOUBLE * n, 6) AS grpo, round(list_sum(list_transform(range(1, n + 1), lambda t: list_sum(list_transform(range(t, n + 1), lambda i: dl[i] * power(0.72::DOUBLE, i - t))))), 6) AS ppo,
round(list_sum(list_transform(range(1, n + 1), lambda t: list_sum(list_transform(range(t, n + 1), lambda i: rw[i] * power(0.9::DOUBLE, i - t))))), 6) AS reinforce_plus_plus, round(list_sum(list_transform(a, lambda v: 2 - 0.1::DOUBLE * v)), 6) AS reinforce_plus_plus_baseline FROM z""",
    "pooled_vectors": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT vec_id, list_sum(list_transform(v, lambda x: x * x)) AS s, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * v[len(v) + 1 - i])) AS r FROM e)
SELECT vec_id, round((s - 2 * s * (vec_id % 2) + r) / (2 + vec_id % 2), 6) AS mean, round(s, 6) AS cls FROM d""",
    "weight_fractions": _W + ", z AS (SELECT *, " + ", ".join(f"{_Z(e)} AS {n}" for n, e in (
        ("hi", "(x[i] > 0.9)::INTEGER * m[i]"), ("lo", "(x[i] < 0.2)::INTEGER * m[i]"), ("ls", "a[i] * greatest(least(exp(p[i] - o[i]), 1.05::DOUBLE), 0.9::DOUBLE)"),
        ("cl", "(exp(p[i] - o[i]) NOT BETWEEN 0.9::DOUBLE AND 1.05::DOUBLE)::INTEGER * m[i]"), ("ds", "abs(exp(p[i] - o[i]) - 1) * m[i]"), ("mv", "(abs(x[i] - y[i]) > 0.05::DOUBLE)::INTEGER * m[i]"))) + """ FROM q)
SELECT user_id, round(list_sum(hi) / greatest(ms, 1), 6) AS high, round(list_sum(lo) / greatest(ms, 1), 6) AS low, round(list_sum(ls), 6) AS loss, round(list_sum(cl) / greatest(ms, 1), 6) AS clipped, round(list_sum(ds) / greatest(ms, 1), 6) AS distance, round(list_sum(mv) / greatest(ms, 1), 6) AS moved FROM z""",
    "group_diagnostics": _SQL_LINES + """, r AS (SELECT l_orderkey AS g, pos, CASE WHEN l_orderkey % 11 > 0 OR pos > 1 THEN floor(l_quantity / 20) END AS t, CASE WHEN l_orderkey % 13 > 0 OR pos > 1 THEN l_discount END AS j FROM li),
w AS (SELECT g, count(*) AS n, count(*) FILTER (t IS NULL) AS nt, max(t) - min(t) > 1e-12 AS v, g % 3 = 0 AS z, g % 6 = 0 AS q FROM r GROUP BY 1 HAVING count(*) FILTER (j IS NULL) = 0),
p AS (SELECT count(*) AS gt_pairs, count(*) FILTER ((a.t > b.t AND a.j - b.j > 1e-12) OR (a.t < b.t AND b.j - a.j > 1e-12)) AS gt_correct FROM r a JOIN r b ON a.g = b.g AND a.pos < b.pos JOIN w ON w.g = a.g AND w.nt = 0 WHERE a.t <> b.t)
SELECT count(*) AS groups, sum(n)::BIGINT AS rollouts, count(*) FILTER (z) AS predicted_zero_groups, count(*) FILTER (q) AS explicit_abstain_groups, """ + ", ".join(
        f"count(*) FILTER (nt = 0 AND {s} AND {a}) AS {p}_{n}" for p, c in (("variance", "z"), ("stage1", "q")) for n, s, a in (("tp", f"NOT {c}", "v"), ("fp", f"NOT {c}", "NOT v"), ("fn", c, "v"), ("tn", c, "NOT v"))) + ", any_value(gt_pairs) AS gt_pairs, any_value(gt_correct) AS gt_correct FROM w, p",
    "length_quartiles": "WITH b AS (SELECT greatest(1, ceil(value * 4 / 120)) AS b FROM events WHERE event_type = 'click' AND value <= 120) SELECT " + ", ".join(f"round(count(*) FILTER (b = {i})::DOUBLE / count(*), 6) AS p{25 * i}" for i in (1, 2, 3, 4)) + " FROM b",
    "top_gaps": """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + trunc(value * 1e7)::BIGINT AS t FROM events), b AS (SELECT user_id, s, max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e WHERE event_type <> 'error'),
g AS (SELECT user_id, b AS begin, s AS finish, s - b AS gap, row_number() OVER (PARTITION BY user_id ORDER BY s - b DESC, b DESC)::INTEGER AS rank FROM b WHERE s > b QUALIFY rank <= 15)
SELECT g.user_id, rank, gap, begin, finish, coalesce(arg_min(e.event_type, e.event_id), 'unknown') AS cause FROM g LEFT JOIN e ON e.event_type = 'error' AND e.user_id = g.user_id AND e.s < finish AND e.t > begin GROUP BY 1, 2, 3, 4, 5""",
    "span_samples": _SQL_LINES + """, h AS (SELECT l_orderkey, count(*) AS n, bool_or(l_quantity::INTEGER = 7) AS bad, sum(l_quantity::INTEGER / 2 + 0.5::DOUBLE) AS lp FROM li GROUP BY 1)
SELECT l_orderkey, CASE WHEN bad THEN NULL ELSE (3 * n)::INTEGER END AS tokens, CASE WHEN NOT bad THEN repeat('0,1,1,', n - 1) || '0,1,1' END AS mask, CASE WHEN NOT bad THEN (3 * n - 1)::INTEGER END AS response_length, CASE WHEN NOT bad THEN round(lp, 6) END AS logprobs FROM h""",
    "message_cards": """WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role IN ('assistant', 'user') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, turn AS assistant_pos, md5(coalesce(nt, '')) AS observation FROM t WHERE role = 'assistant' AND coalesce(nr, 'user') = 'user'""",
    "budgeted_rows": _SQL_LINES + " SELECT l_orderkey, pos FROM li QUALIFY sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY pos) <= 60",
    "epoch_orders": "SELECT count(*) AS n, count(*) AS places, count(*) AS same FROM orders",
    "response_tails": _W + "SELECT user_id, round(coalesce(list_sum(x[greatest(1, n - user_id % 9 + 1):]), 0), 6) AS value FROM q",
}
