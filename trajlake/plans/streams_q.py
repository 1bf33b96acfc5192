"""Ledgers read by byte offsets, buffered groups and hooks over events and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import plugins
from ..sources import ledger_source as ledger
from ..sources.scratch import folder
from ..streaming import buffer
from .groups_q import _t

_C = F.col
_HOOKS = "trajlake.hooks.words."


def _place(spark, name):
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _ledger(spark, d):
    """Events as ledger lines, each twice, with a broken line for every seventh."""
    value = F.to_json(F.struct("value"))
    event = F.to_json(F.struct(_C("event_id").cast("string").alias("event_id"), "event_type", _C("user_id").cast("string").alias("group_id"), value.alias("payload")))
    rows = _t(spark, d, "events")
    lines = rows.select(event.alias("line")).union(rows.where("event_id % 7 = 0").select(F.substring(event, 1, 20))).union(rows.select(event))
    path = _place(spark, "ledger")
    lines.write.text(path)
    return path


def _totals(events):
    value = F.get_json_object("payload", "$.value").cast("double")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("users"), F.round(F.sum(value), 4).alias("value"))


def ledger_batch(spark, d):
    return _totals(ledger.first_events(ledger.events_of(ledger.ledger_lines(spark, _ledger(spark, d), split_bytes=200_000))))


def ledger_streamed(spark, d):
    """The same by a stream, from the ledger as it is now."""
    events = ledger.first_events(ledger.events_of(ledger.ledger_stream(spark, _ledger(spark, d))))
    return _totals(buffer.run_once(events, _place(spark, "events"), _place(spark, "offsets")))


def ledger_ends(spark, d):
    """Whole lines up to the offsets that a checkpoint keeps."""
    path = _ledger(spark, d)
    return ledger.ledger_lines(spark, path, end=ledger.ledger_offsets(path)).agg(F.count("*").alias("n"), F.count_if(F.get_json_object("line", "$.event_id").isNull()).alias("broken"))


def _buffered(spark, d):
    rows = _t(spark, d, "events")
    samples = spark.readStream.schema(rows.schema).parquet(f"{d}/events.parque[t]").select("event_id", "user_id", "event_type", "value")
    place = _place(spark, "held")
    return buffer.run_once(buffer.buffered_groups(samples, "user_id", buffer.of_size(64)), _place(spark, "complete"), place), place


def buffer_complete(spark, d):
    """Users of 64 events or more, with all of them."""
    rows, _ = _buffered(spark, d)
    return rows.groupBy("user_id", "status").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("value"))


def buffer_waiting(spark, d):
    """What the others hold when the stream stops."""
    _, place = _buffered(spark, d)
    meta = buffer.interval_meta(buffer.held_items(spark, place), "user_id", "value")
    return meta.select("total_samples", "num_groups", F.round("avg_group_size", 6).alias("avg_group_size"), F.round("avg_reward", 6).alias("avg_reward"))


def hook_rollouts(spark, d):
    """A table function by name, through a lateral join."""
    plugins.register(spark, "rollout", "word_spans", _HOOKS + "run_rollout")
    return spark.sql(
        "SELECT d.doc_id, s.sample, md5(s.response) AS response, s.n_words FROM {docs} d, LATERAL word_spans(d.text, 6) s", docs=_t(spark, d, "documents")
    )


def hook_rewards(spark, d):
    """Rollouts, rewards, filter and advantages, each by a hook."""
    samples = plugins.roll_out(_t(spark, d, "documents").select(_C("doc_id").alias("group"), "text", "source"), _HOOKS + "run_rollout", "text", F.lit(6))
    scored = samples.withColumn("reward", plugins.apply_column("reward", _HOOKS + "long_share", _C("response"), _C("source"), size=4)).drop("text")
    kept = plugins.apply_frame(scored, "filter", _HOOKS + "varied")
    return kept.select("group", "sample", F.round(plugins.apply_column("advantage", _HOOKS + "centred", _C("reward")), 6).alias("advantage"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
_SPANS = r"""WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, source, CAST(k AS INTEGER) AS sample, list_slice(w, 8 * k + 1, 8 * k + 8) AS p FROM w, unnest(range(0, 6)) AS t(k) WHERE len(w) > 8 * k)
"""
_TOTALS = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY 1"
SQL = {
    "ledger_batch": _TOTALS,
    "ledger_streamed": _TOTALS,
    "ledger_ends": "SELECT 2 * count(*) + count(*) FILTER (event_id % 7 = 0) AS n, count(*) FILTER (event_id % 7 = 0) AS broken FROM events",
    "buffer_complete": "SELECT user_id, 'complete' AS status, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 4) AS value FROM events GROUP BY 1 HAVING count(*) >= 64",
    "buffer_waiting": """SELECT CAST(sum(n) AS BIGINT) AS total_samples, count(*) AS num_groups, round(coalesce(sum(n) / count(*), 0), 6) AS avg_group_size, round(coalesce(sum(v) / sum(n), 0), 6) AS avg_reward
FROM (SELECT user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY 1 HAVING count(*) < 64)""",
    "hook_rollouts": _SPANS + "SELECT doc_id, sample, md5(array_to_string(p, ' ')) AS response, CAST(len(p) AS INTEGER) AS n_words FROM s",
    "hook_rewards": _SPANS + """, r AS (SELECT doc_id, sample, len(list_filter(p, lambda x: length(x) > length(source))) / greatest(len(p), 4)::DOUBLE AS reward FROM s)
SELECT doc_id AS "group", sample, round(reward - avg(reward) OVER (PARTITION BY doc_id), 6) AS advantage FROM r QUALIFY max(reward) OVER (PARTITION BY doc_id) > min(reward) OVER (PARTITION BY doc_id)""",
}
