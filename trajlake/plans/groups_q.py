"""Group operators over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import groups as g


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE, "l_returnflag", "l_linestatus", "l_shipdate")
    rows = _t(spark, d, "lineitem").withColumn("pos", F.row_number().over(w).cast("long"))
    return rows.select("l_orderkey", "pos", "l_discount", "l_quantity")


_SQL_LINES = f"""WITH li AS (SELECT l_orderkey, l_discount, l_quantity, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY {', '.join(_LINE)}, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem),
pr AS (SELECT a.l_orderkey, a.pos AS lp, b.pos AS rp, a.l_discount AS ls, b.l_discount AS rs, a.l_quantity AS lr, b.l_quantity AS rr,
  CASE WHEN a.l_discount > b.l_discount + 1e-12 THEN 1 WHEN b.l_discount > a.l_discount + 1e-12 THEN -1 ELSE 0 END AS s,
  CASE WHEN a.l_quantity > b.l_quantity + 1e-12 THEN 1 WHEN b.l_quantity > a.l_quantity + 1e-12 THEN -1 ELSE 0 END AS r
  FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos)"""


def ranking_metrics(spark, d):
    out = g.ranking_metrics(_lines(spark, d), "l_orderkey", "pos", "l_discount", "l_quantity")
    return out.select("l_orderkey", "n", F.round("tie_aware", 9).alias("tie_aware"), F.round("pairwise", 9).alias("pairwise"))


def strict_pairs(spark, d):
    out = g.strict_pairs(_lines(spark, d), "l_orderkey", "pos", "l_quantity")
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("gt_sign").alias("sign_sum"))


def strict_pair_accuracy(spark, d):
    return g.strict_pair_accuracy(_lines(spark, d), "l_orderkey", "pos", "l_discount", "l_quantity")


def pass_at_k(spark, d):
    out = g.pass_at_k(_t(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", 8)
    return out.select("k", F.round("pass_rate", 9).alias("pass_rate"), "groups")


def compute_statistics(spark, d):
    out = g.statistics(_t(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "median", "max", "min")))


def nearest_rank(spark, d):
    return g.nearest_ranks(_t(spark, d, "events"), "user_id", "value", [0.5, 0.9, 0.99])


def nonzero_std(spark, d):
    return g.nonzero_std(_lines(spark, d), "l_orderkey", "l_quantity")


def judge_variance(spark, d):
    rows = _lines(spark, d).withColumn("zero", F.col("l_discount") < 0.02)
    return g.judge_variance(rows, "l_orderkey", "l_quantity", "zero")


def drop_reasons(spark, d):
    return judge_variance(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _adv(spark, d, mode, scale=True):
    rows = _t(spark, d, "events").select("event_id", "user_id", (F.col("value") / 100).alias("reward"))
    return g.centre(rows, "user_id", "reward", mode, scale)


def advantage_unbiased(spark, d):
    return _adv(spark, d, "unbiased").select("event_id", F.round("advantage", 6).alias("advantage"))


def advantage_population(spark, d):
    return _adv(spark, d, "population").select("event_id", "masked", F.round("advantage", 6).alias("advantage"))


def advantage_unit(spark, d):
    return _adv(spark, d, "unit").select("event_id", F.round("advantage", 6).alias("advantage"))


def advantage_centred(spark, d):
    return _adv(spark, d, "unbiased", False).select("event_id", F.round("advantage", 6).alias("advantage"))


def whiten(spark, d):
    out = g.whiten(_t(spark, d, "events"), "value", F.col("event_type") != "view")
    return out.select("event_id", F.round("whitened", 6).alias("whitened"))


def whole_groups(spark, d):
    out = g.whole_groups(_t(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 3)
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def sized_groups(spark, d):
    out = g.whole_groups(_t(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 3, 4)
    return out.select("l_orderkey").distinct()


def newest_groups(spark, d):
    return g.newest_groups(_t(spark, d, "events"), "user_id", "event_id", 50)


def zero_std_histogram(spark, d):
    by = _lines(spark, d).groupBy("l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return by.where("lo = hi").groupBy(F.col("lo").cast("long").alias("reward")).agg(F.count(F.lit(1)).alias("n"))


def category_share(spark, d):
    n = _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


def weighted_batch_mean(spark, d):
    by = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.ratio_of_sums(by, ["l_suppkey"], F.col("m") * F.col("n"), F.col("n")).select("l_suppkey", F.round("ratio", 6).alias("ratio"))


def sum_of_sample_means(spark, d):
    m = (F.col("l_returnflag") != "N").cast("double")
    by = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum(F.col("l_tax") * m).alias("x"), F.sum(m).alias("c"))
    return by.groupBy("l_suppkey").agg(F.round(F.sum(F.col("x") / F.greatest("c", F.lit(1.0))), 6).alias("value"))


def fresh_rows(spark, d):
    rows = _t(spark, d, "orders").withColumn("version", F.col("o_orderkey") % 5)
    return g.fresh(rows, "version", 4).select("o_orderkey", "lag")


def policy_version_lag(spark, d):
    rows = _t(spark, d, "orders")
    label = lambda c: F.concat(F.lit("policy-"), c.cast("string"))
    return rows.select("o_orderkey", g.version_lag(label(F.col("o_custkey") % 7), label(F.col("o_orderkey") % 5 + 7)).alias("lag"))


def upsert_predictions(spark, d):
    base = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    change = base.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return g.upsert(base, change, "o_orderkey")


def delete_predictions(spark, d):
    base = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return base.join(base.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti")


def latest_state(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("event_id"))


def group_outcomes(spark, d):
    rate = lambda c: F.round(F.try_divide(F.count_if(c), F.count(F.lit(1))), 9)
    s = F.col("o_orderstatus")
    return _t(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("attempted"), rate(s == "F").alias("accepted"), rate(s == "P").alias("invalid"), rate(s == "O").alias("filtered"))


def group_mean_variance(spark, d):
    by = _t(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    return by.agg(F.round(F.sum("m"), 4).alias("mean_sum"), F.round(F.sum("v"), 2).alias("variance_sum"), F.count_if(F.coalesce(F.col("v"), F.lit(0.0)) <= 1e-12).alias("zero"))


def first_gate(spark, d):
    by = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("resolved"), F.count(F.lit(1)).alias("n"))
    return by.select("l_orderkey", ((F.col("resolved") > 0) & (F.col("resolved") < F.col("n"))).alias("go_on"))


def offset_slice(spark, d):
    return _t(spark, d, "orders").orderBy("o_orderkey").offset(100).limit(250).select("o_orderkey", "o_custkey")


def strided_shard(spark, d):
    """Every eighth order by rank of key, from the third: ranks by range, without one task for all rows."""
    from ..operators.order import with_rank

    return with_rank(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey").where("rank % 8 = 3")


def request_order_join(spark, d):
    """Every event asks for an order, in its place; orders that aren't there are told."""
    want = _t(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 37 % 20011).alias("o_orderkey"))
    return g.by_request(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), want, "o_orderkey", "pos")


def sample_expansion(spark, d):
    rows = _t(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample"))
    return rows.select("n_nationkey", "sample", (F.col("n_nationkey") * 4 + F.col("sample")).cast("long").alias("index"))


def fold_membership(spark, d):
    fold = F.pmod(F.col("doc_id"), F.lit(3)).cast("int").alias("fold")
    docs = _t(spark, d, "documents").select("doc_id", fold, "n_chars")
    good = _t(spark, d, "labels").where("quality = 1").select("doc_id")
    base = docs.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).withColumn("variant", F.lit("baseline"))
    only = docs.join(good, "doc_id", "left_semi").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return base.unionByName(only.withColumn("variant", F.lit("eligible")))


def reusable_attempts(spark, d):
    best = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_shipdate", "l_returnflag")).alias("flag"), F.max("l_linenumber").alias("attempt"))
    return best.select("l_orderkey", "flag", (F.col("attempt") + 1).alias("attempts"))


_E = "(SELECT event_id, user_id, value / 100 AS reward FROM events)"
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
SQL = {
    "ranking_metrics": _SQL_LINES + """, b AS (SELECT l_orderkey, max(l_discount) AS ms, max(l_quantity) AS mr, count(*) AS n FROM li GROUP BY 1),
t AS (SELECT l_orderkey, max(n) AS n, avg(CASE WHEN l_quantity >= mr - 1e-12 THEN 1.0::DOUBLE ELSE 0 END) AS tie_aware FROM li JOIN b USING (l_orderkey) WHERE l_discount >= ms - 1e-12 GROUP BY 1),
a AS (SELECT l_orderkey, avg(CASE WHEN s = 0 OR r = 0 THEN 0.5::DOUBLE WHEN s = r THEN 1 ELSE 0 END) AS pairwise FROM pr GROUP BY 1)
SELECT l_orderkey, n, round(tie_aware, 9) AS tie_aware, round(pairwise, 9) AS pairwise FROM t JOIN a USING (l_orderkey)""",
    "strict_pairs": _SQL_LINES + " SELECT l_orderkey, count(*) AS pairs, sum(r)::BIGINT AS sign_sum FROM pr WHERE r <> 0 GROUP BY 1",
    "strict_pair_accuracy": _SQL_LINES + " SELECT l_orderkey, count(*) FILTER (s = r) AS correct, count(*) AS total FROM pr WHERE r <> 0 GROUP BY 1",
    "pass_at_k": """WITH b AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY 1),
e AS (SELECT n, c, k FROM b, (VALUES (1), (2), (4), (8)) v(k) WHERE n >= k)
SELECT k, round(avg(CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN n - c < k THEN 1.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k::DOUBLE / i), lambda a, x: a * x) END), 9) AS pass_rate, count(*) AS groups FROM e GROUP BY k""",
    "compute_statistics": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS max, round(min(value), 6) AS min FROM events GROUP BY 1",
    "nearest_rank": """WITH v AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT user_id, """ + ", ".join(f"v[round_even((len(v) - 1) * {q}, 0)::INTEGER + 1] AS p{p}" for q, p in ((0.5, 50), (0.9, 90), (0.99, 99))) + " FROM v",
    "nonzero_std": "SELECT l_orderkey, coalesce(stddev_samp(l_quantity) > 1e-6, false) AS keep FROM lineitem GROUP BY 1",
    "judge_variance": """SELECT l_orderkey, CASE WHEN bool_or(l_discount < 0.02) AND NOT bool_and(l_discount < 0.02) THEN 'inconsistent' WHEN bool_and(l_discount < 0.02) THEN 'predicted_zero'
WHEN coalesce(stddev_samp(l_quantity) > 1e-6, false) THEN 'keep' ELSE 'zero_std' END AS reason FROM lineitem GROUP BY 1""",
    "advantage_unbiased": f"SELECT event_id, round((reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-6), 6) AS advantage FROM {_E} WINDOW w AS (PARTITION BY user_id)",
    "advantage_population": f"""SELECT event_id, count(*) OVER w < 2 OR stddev_pop(reward) OVER w <= 1e-9 AS masked,
round(CASE WHEN count(*) OVER w < 2 OR stddev_pop(reward) OVER w <= 1e-9 THEN 0 ELSE (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) END, 6) AS advantage FROM {_E} WINDOW w AS (PARTITION BY user_id)""",
    "advantage_unit": f"""WITH y AS (SELECT *, CASE WHEN reward BETWEEN 0 AND 1 THEN reward END AS y FROM {_E})
SELECT event_id, round(CASE WHEN y IS NULL OR max(abs(y)) OVER w = 0 THEN reward WHEN stddev_pop(y) OVER w < 1e-8 THEN 0 ELSE (reward - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-8) END, 6) AS advantage FROM y WINDOW w AS (PARTITION BY user_id)""",
    "advantage_centred": f"SELECT event_id, round(reward - avg(reward) OVER (PARTITION BY user_id), 6) AS advantage FROM {_E}",
    "whiten": """WITH s AS (SELECT avg(value) AS m, avg(value * value) AS q, count(*) AS n FROM events WHERE event_type <> 'view')
SELECT event_id, round((value - m) / sqrt((q - m * m) * n / (n - 1) + 1e-8), 6) AS whitened FROM events, s""",
    "whole_groups": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 3)",
    "sized_groups": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 3) AND count(*) = 4",
    "newest_groups": "SELECT user_id, max(event_id) AS latest FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "zero_std_histogram": "SELECT lo::BIGINT AS reward, count(*) AS n FROM (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_orderkey) WHERE lo = hi GROUP BY 1",
    "category_share": "SELECT event_type, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1",
    "weighted_batch_mean": "SELECT l_suppkey, round(avg(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1",
    "sum_of_sample_means": "SELECT l_suppkey, round(sum(x / greatest(c, 1)), 6) AS value FROM (SELECT l_suppkey, l_orderkey, sum(CASE WHEN l_returnflag <> 'N' THEN l_tax ELSE 0 END) AS x, count(*) FILTER (l_returnflag <> 'N')::DOUBLE AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "fresh_rows": "SELECT o_orderkey, 4 - o_orderkey % 5 AS lag FROM orders WHERE 4 - o_orderkey % 5 <= 1",
    "policy_version_lag": "SELECT o_orderkey, o_orderkey % 5 + 7 - o_custkey % 7 AS lag FROM orders",
    "upsert_predictions": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders",
    "delete_predictions": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "latest_state": "SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS event_id FROM events GROUP BY 1",
    "group_outcomes": "SELECT o_orderpriority, count(*) AS attempted, " + ", ".join(f"round(count(*) FILTER (o_orderstatus = '{s}')::DOUBLE / count(*), 9) AS {n}" for s, n in (("F", "accepted"), ("P", "invalid"), ("O", "filtered"))) + " FROM orders GROUP BY 1",
    "group_mean_variance": "SELECT round(sum(m), 4) AS mean_sum, round(sum(v), 2) AS variance_sum, count(*) FILTER (coalesce(v, 0) <= 1e-12) AS zero FROM (SELECT avg(value) AS m, var_samp(value) AS v FROM events GROUP BY user_id)",
    "first_gate": "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'R') < count(*) AS go_on FROM lineitem GROUP BY 1",
    "offset_slice": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 100",
    "strided_shard": "SELECT o_orderkey, r AS rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 8 = 3",
    "request_order_join": "SELECT pos, w.o_orderkey, o_orderstatus, o.o_orderkey IS NOT NULL AS found FROM (SELECT event_id AS pos, event_id * 37 % 20011 AS o_orderkey FROM events) w LEFT JOIN orders o USING (o_orderkey)",
    "sample_expansion": "SELECT n_nationkey, s::INTEGER AS sample, (n_nationkey * 4 + s)::BIGINT AS index FROM nation, range(4) r(s)",
    "fold_membership": """WITH f AS (SELECT doc_id, (doc_id % 3)::INTEGER AS fold, n_chars FROM documents)
SELECT fold, count(*) AS n, sum(n_chars)::BIGINT AS chars, 'baseline' AS variant FROM f GROUP BY 1 UNION ALL SELECT fold, count(*), sum(n_chars)::BIGINT, 'eligible' FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1""",
    "reusable_attempts": "SELECT l_orderkey, arg_max(l_returnflag, {'a': l_linenumber, 'b': l_shipdate, 'c': l_returnflag}) AS flag, max(l_linenumber) + 1 AS attempts FROM lineitem GROUP BY 1",
}
SQL["drop_reasons"] = f"SELECT reason, count(*) AS n FROM ({SQL['judge_variance']}) GROUP BY 1"
