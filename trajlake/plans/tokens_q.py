"""Token-array functions; a sequence is an order's lines or a user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as k
from .groups_q import _t

_C = F.col


def _seq(spark, d):
    e = F.array_sort(F.collect_list(F.struct("event_id", (_C("value") / 100).alias("v"))))
    rows = _t(spark, d, "events").groupBy("user_id").agg(e.alias("e"))
    x = F.transform("e", lambda s: s["v"])
    rows = rows.select(
        "user_id", x.alias("x"), F.transform(x, lambda v, i: v * 0.9 + i * 0.001).alias("y"),
        F.transform(x, lambda v, i: F.when(i % 3 == 0, 0.0).otherwise(1.0)).alias("m"), F.transform(x, lambda v: v - 0.5).alias("a"),
    )
    lp = lambda c: F.transform(c, lambda v: -F.abs(v) - 0.01)
    return rows.select("*", lp("x").alias("p"), lp("y").alias("o"))


_W = """WITH r AS (SELECT user_id, list(value / 100 ORDER BY event_id) AS x FROM events GROUP BY 1),
s AS (SELECT user_id, x, list_transform(x, lambda v, i: v * 0.9::DOUBLE + (i - 1) * 0.001::DOUBLE) AS y, list_transform(x, lambda v, i: CASE WHEN (i - 1) % 3 = 0 THEN 0.0::DOUBLE ELSE 1 END) AS m, list_transform(x, lambda v: v - 0.5::DOUBLE) AS a FROM r),
q AS (SELECT *, list_transform(x, lambda v: -abs(v) - 0.01::DOUBLE) AS p, list_transform(y, lambda v: -abs(v) - 0.01::DOUBLE) AS o, len(x) AS n, list_sum(m) AS ms FROM s) """
_SUM = lambda e, name="value": f"round(list_sum({e}), 6) AS {name}"
_Z = lambda body: f"list_transform(range(1, n + 1), lambda i: {body})"
_CLAMP = lambda e, lo, hi: f"greatest(least({e}, {hi}::DOUBLE), {lo}::DOUBLE)"
_MM = "(list_sum(" + _Z("(o[i] - p[i]) * m[i]") + ") / greatest(ms, 1))"
QUERIES, SQL = {}, {}


def _add(name, expr, sql, other=None, other_sql=None):
    def query(spark, d):
        return _seq(spark, d).select("user_id", expr().alias("value"), *([other().alias("other")] if other else []))

    query.__name__ = name
    QUERIES[name] = query
    SQL[name] = _W + f"SELECT user_id, {sql}" + (f", {other_sql}" if other_sql else "") + " FROM q"


def _sum(make):
    return lambda: F.round(k.total(make()), 6)


def _scan_sql(delta, decay):
    # y[t] as a sum of decayed later terms
    return f"list_transform(range(1, n + 1), lambda t: list_sum(list_transform(range(t, n + 1), lambda i: ({delta}) * power({decay}::DOUBLE, i - t))))"


_add("gae", _sum(lambda: k.gae(_C("x"), _C("y"), 0.9, 0.8)), _SUM(_scan_sql("x[i] + 0.9::DOUBLE * coalesce(y[i + 1], 0) - y[i]", 0.72)))
_add("discounted_returns", _sum(lambda: k.discounted(_C("x"), 0.95)), _SUM(_scan_sql("x[i]", 0.95)))
_add("reinforce_returns", _sum(lambda: k.reinforce_returns(F.lit(2.0), _C("a"), _C("m"), 0.1, 0.9)),
     _SUM(_scan_sql("-0.1::DOUBLE * a[i] * m[i] + CASE WHEN i = n - list_position(list_reverse(m), 1.0::DOUBLE) + 1 THEN 2 ELSE 0 END", 0.9)))
_add("reinforce_baseline", _sum(lambda: F.transform(_C("a"), lambda v: 2.0 - 0.1 * v)), _SUM("list_transform(a, lambda v: 2 - 0.1::DOUBLE * v)"))
_add("grpo_returns", _sum(lambda: k.advantages("grpo", F.get("x", 0), _C("y"), _C("a"), _C("m"))), "round(x[1] * n, 6) AS value")
for _kind, _body in (("k1", "p[i] - o[i]"), ("k2", "(p[i] - o[i]) * (p[i] - o[i]) / 2"), ("k3", "exp(o[i] - p[i]) - 1 + p[i] - o[i]"),
                     ("low_var", _CLAMP("exp(o[i] - p[i]) - 1 + p[i] - o[i]", -10, 10))):
    _add(f"kl_{_kind}", _sum(lambda kind=_kind: k.approx_kl(_C("p"), _C("o"), kind)), _SUM(_Z(_body)))
_R = "exp(o[i] - p[i])"
_PPO = f"greatest(-{_R} * a[i], -{_CLAMP(_R, 0.8, 1.28)} * a[i])"
_kl = lambda: k.minus(_C("p"), _C("o"))
_add("policy_loss", _sum(lambda: k.policy_loss(_kl(), _C("a"), 0.2, 0.28)), _SUM(_Z(_PPO)),
     lambda: F.round(k.clip_fraction(_kl(), _C("a"), 0.2, 0.28), 9), f"round(list_sum({_Z(f'CASE WHEN -{_CLAMP(_R, 0.8, 1.28)} * a[i] > -{_R} * a[i] THEN 1.0::DOUBLE ELSE 0 END')}) / n, 9) AS other")
_add("policy_loss_dual", _sum(lambda: k.policy_loss(_kl(), _C("a"), 0.2, 0.28, 3.0)), _SUM(_Z(f"CASE WHEN a[i] < 0 THEN least({_PPO}, -3.0::DOUBLE * a[i]) ELSE {_PPO} END")))
_add("cispo_loss", _sum(lambda: k.cispo_loss(_kl(), _C("p"), _C("a"), 0.2, 0.28)), _SUM(_Z(f"-({_CLAMP(_R, 0.8, 1.28)} * a[i] * p[i])")))
_P = lambda c: _CLAMP(f"exp({_CLAMP(f'{c}[i]', -30, 0)})", 1e-9, "(1 - 1e-9)")
_TV = f"abs({_P('o')} - {_P('p')})"
_add("divergence_tv", _sum(lambda: k.binary_divergence(_C("o"), _C("p"))), _SUM(_Z(_TV)))
_add("divergence_kl", _sum(lambda: k.binary_divergence(_C("o"), _C("p"), "kl")), _SUM(_Z(f"{_P('o')} * ln({_P('o')} / {_P('p')}) + (1 - {_P('o')}) * ln((1 - {_P('o')}) / (1 - {_P('p')}))")))
_add("trust_region", _sum(lambda: k.trust_region(_C("o"), _C("p"), _C("a"), 0.02)), _SUM(_Z(f"CASE WHEN {_TV} > 0.02 AND (p[i] - o[i]) * a[i] > 0 THEN 0.0::DOUBLE ELSE 1 END")))
_add("off_policy_mask", _sum(lambda: k.off_policy_mask(_C("p"), _C("o"), _C("a"), _C("m"), 0.01)), _SUM(_Z(f"CASE WHEN a[i] < 0 AND {_MM} > 0.01 THEN 0.0::DOUBLE ELSE 1 END")))
_add("sequence_kl", _sum(lambda: k.sequence_kl(_C("p"), _C("o"), _C("m"))), f"round({_MM} * n, 6) AS value")
_D = "(p[i] - o[i])"
_TW = f"exp({_CLAMP(_D, -20, 20)})"
_w = lambda level="token": k.importance_weights(_C("p"), _C("o"), _C("m"), level)
_add("weights_token", _sum(_w), _SUM(_Z(_TW)))
_SEQ = "list_sum(" + _Z(f"{_D} * m[i]") + ")"
_add("weights_sequence", lambda: F.round(F.get(_w("sequence"), 0), 6), f"round(exp({_CLAMP(_SEQ, -20, 20)}), 6) AS value")
_add("weights_geometric", lambda: F.round(F.get(_w("geometric"), 0), 6), f"round(exp({_CLAMP(f'{_SEQ} / greatest(ms, 1)', -20, 20)}), 6) AS value")
_add("weights_truncated", _sum(lambda: k.truncate(_w(), _C("m"), 1.05)), _SUM(_Z(f"{_CLAMP(_TW, 0, 1.05)} * m[i]")))
_add("weights_clipped", _sum(lambda: k.clip(_w(), _C("m"), 0.97, 1.05)), _SUM(_Z(f"{_CLAMP(_TW, 0.97, 1.05)} * m[i]")))
_add("weights_rejected", _sum(lambda: k.reject(_w(), _C("m"), 0.97, 1.05)), _SUM(_Z(f"CASE WHEN {_TW} BETWEEN 0.97 AND 1.05 THEN m[i] ELSE 0 END")))
_add("icepop", _sum(lambda: k.icepop(_w(), 0.97, 1.05)), _SUM(_Z(f"CASE WHEN {_TW} BETWEEN 0.97 AND 1.05 THEN {_TW} ELSE 0 END")))
_add("veto", lambda: k.vetoed(_kl(), _C("m"), 0.9), f"len(list_filter({_Z(f'm[i] > 0 AND {_D} < ln(0.9::DOUBLE)')}, lambda b: b)) > 0 AS value")
_add("value_loss", _sum(lambda: k.value_loss(_C("x"), _C("y"), _C("a"), 0.05)), _SUM(_Z(f"greatest((x[i] - a[i]) * (x[i] - a[i]), power(y[i] + {_CLAMP('x[i] - y[i]', -0.05, 0.05)} - a[i], 2))")))
_add("sft_loss", lambda: F.round(-k.masked_mean(_C("p"), _C("m")), 9), f"round(-list_sum({_Z('p[i] * m[i]')}) / greatest(ms, 1), 9) AS value")
_add("response_lengths", lambda: k.response_length(F.transform(_C("x"), lambda v: (v > 0.9).cast("double"))), "coalesce(n - list_position(list_transform(x, lambda v: v > 0.9), true) + 1, 0)::BIGINT AS value")
_IX = "list_transform(x, lambda v: floor(v * 3)::INTEGER)"
_ix = lambda: F.transform(_C("x"), lambda v: F.floor(v * 3).cast("int"))
_ON = "list_filter(range(1, n + 1), lambda i: m[i] = 1 AND {})"
_FROM, _TO = _ON.format("(i = 1 OR m[i - 1] <> 1)"), _ON.format("(i = n OR m[i + 1] <> 1)")
_SPANS = lambda: k.masked_spans(_C("x"), _C("m"))
_add("masked_spans", lambda: F.size(_SPANS()).cast("long"), f"len({_FROM}) AS value",
     lambda: F.round(F.aggregate(_SPANS(), F.lit(0.0), lambda a, s: a + F.size(s) * F.element_at(s, -1)), 6),
     f"round(coalesce(list_sum(list_transform(range(1, len({_FROM}) + 1), lambda j: (({_TO})[j] - ({_FROM})[j] + 1) * x[({_TO})[j]])), 0), 6) AS other")
_add("sublist_positions", lambda: F.size(k.positions_of(_ix(), F.array(F.lit(0), F.lit(0)))).cast("long"), f"len(list_filter(range(1, n), lambda i: {_IX}[i] = 0 AND {_IX}[i + 1] = 0)) AS value")
_add("common_prefix", lambda: k.common_prefix(_ix(), F.transform(_C("y"), lambda v: F.floor(v * 3).cast("int"))),
     f"coalesce(list_position({_Z('floor(x[i] * 3) = floor(y[i] * 3)')}, false) - 1, n)::BIGINT AS value")
_HIT = "list_filter(range(n), lambda i: x[i + 1] > 0.5)"
_hit = lambda: F.filter(F.transform(_C("x"), lambda v, i: F.when(v > 0.5, i)), lambda i: i.isNotNull())
_add("gap_encoding", lambda: F.array_join(k.gaps(_hit()), ","), f"array_to_string(list_transform({_HIT}, lambda p, i: p - coalesce({_HIT}[i - 1], -1) - 1), ',') AS value")
_add("ragged_offsets", lambda: F.array_join(k.pad_offsets(k.merge_offsets(F.array(F.lit(0), F.lit(2), F.size("x")), F.array(F.lit(0), F.lit(3))), 2), ","),
     "'0,2,' || n || ',' || (n + 3) || ',' || (n + 3) || ',' || (n + 3) AS value")
