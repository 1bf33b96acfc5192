"""Buffers, batches, updates and small tables of a training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drain_first(buffer: DataFrame, source: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows, those of the buffer before those of the source; ``buffered`` tells them apart. A top-n, not a global sort."""
    both = buffer.withColumn("buffered", F.lit(True)).unionByName(source.withColumn("buffered", F.lit(False)))
    return both.orderBy(F.desc("buffered"), order).limit(n)


def drop_stale(groups: DataFrame, group: str, rollout: str, version: str, current: int) -> DataFrame:
    """(group, rollout, lag, disposition) of buffered samples' groups: kept, or dropped as stale.

    Before update r the checkpoint r - 1 is current; groups stay with a lag of
    1 at most and a rollout not older than the one before. A group of several
    versions, or from the future, raises. Versions end in their checkpoint's number.
    """
    by = groups.groupBy(group).agg(F.max(rollout).alias(rollout), F.min(version).alias("_low"), F.max(version).alias("_high"))
    lag = F.lit(current - 1) - F.regexp_extract("_low", r"(\d+)$", 1).try_cast("int")
    fail = lambda text: F.raise_error(F.lit(text)).cast("int")
    checked = F.when(F.col("_low") != F.col("_high"), fail("a buffered group mixes policy versions")).when(lag < 0, fail("a buffered group has weights from the future")).otherwise(lag)
    fresh = (F.col(rollout) >= current - 1) & (F.col("lag") <= 1)
    out = by.withColumn("lag", checked)
    return out.select(group, rollout, "lag", F.when(F.coalesce(fresh, F.lit(False)), "kept").otherwise("dropped:stale").alias("disposition"))


def checked_lag(lag: Column, most: int, stage: str) -> Column:
    """The lag, between 0 and ``most``; others raise."""
    message = F.concat(F.lit(f"policy staleness at {stage}: "), lag.cast("string"))
    return F.when(lag.between(0, most), lag).otherwise(F.raise_error(message).cast("int"))


def excess(rows: DataFrame, rank: str, quota: int) -> DataFrame:
    """Rows beyond the quota by ``rank`` (from 0), with the reason they are dropped for."""
    return rows.where(F.col(rank) >= quota).withColumn("reason", F.lit("excess_after_quota"))


def usage_prefix(phase: Column, nonce: Column, rollout: Column, instance: Column, task: Column, dataset: Column) -> Column:
    """phase/attempt-nonce/r0000[/dataset]/instance/t000000."""
    named = F.when(F.coalesce(dataset, F.lit("")) != "", F.concat(F.lit("/"), dataset)).otherwise("")
    return F.concat(phase, F.lit("/attempt-"), nonce, F.format_string("/r%04d", rollout), named, F.lit("/"), instance, F.format_string("/t%06d", task))


def endpoint_batches(tasks: DataFrame, endpoint: str, order: str, workers: int) -> DataFrame:
    """(endpoint, order, slot): tasks dealt in turn to the slots of their endpoint.

    Each endpoint has one slot, and further ones go round the endpoints in
    alphabetical order until there are ``workers``; none has more slots than tasks.
    """
    ends = tasks.groupBy(endpoint).agg(F.count(F.lit(1)).alias("_n"))
    ends = ends.withColumn("_i", F.row_number().over(Window.orderBy(endpoint)) - 1).withColumn("_e", F.count(F.lit(1)).over(Window.partitionBy()))  # one row an endpoint
    spare = F.greatest(F.lit(0), F.lit(workers) - F.col("_e"))
    share = 1 + F.floor(spare / F.col("_e")) + (F.col("_i") < spare % F.col("_e")).cast("int")
    slots = ends.select(endpoint, F.least(share, "_n").cast("int").alias("_slots"))
    k = F.row_number().over(Window.partitionBy(endpoint).orderBy(order)) - 1
    return tasks.select(endpoint, order).withColumn("_k", k).join(F.broadcast(slots), endpoint).select(endpoint, order, (F.col("_k") % F.col("_slots")).cast("int").alias("slot"))


def inverse_permutation(rows: DataFrame, group: str, pos: str, target: str) -> DataFrame:
    """(group, pos, source): where each place of the permutation comes from."""
    return rows.select(group, F.col(target).alias(pos), F.col(pos).alias("source"))


def changed_rows(current: DataFrame, snapshot: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose 64 bits of value differ, or that one side lacks; NaNs of one form are equal, 0.0 and -0.0 aren't."""
    bits = lambda c: F.hex(F.encode(F.col(c).cast("string"), "utf-8"))
    a = current.select(key, bits(value).alias("_a"), F.lit(1).alias("_x"))
    b = snapshot.select(key, bits(value).alias("_b"), F.lit(1).alias("_y"))
    return a.join(b, key, "full").where(~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_x").eqNullSafe(F.col("_y")))).select(key)


def first_seen_groups(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, n, first): groups with the place they are first seen at."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))


def bank_update(previous: DataFrame, generated: DataFrame, group: str, title: str, pos: str, value: str, most: int) -> DataFrame:
    """(group, title, value, pos, active): a bank after an update.

    Of generated rows with one title (without case) the last counts and keeps the
    first one's place; the first ``most`` are active. Earlier rows whose title
    isn't generated again are inactive.
    """
    key = F.lower(F.trim(title))
    new = generated.groupBy(group, key.alias("_k")).agg(F.max_by(F.struct(title, value), pos).alias("_v"), F.min(pos).alias(pos))
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(pos)))
    new = new.where(F.col("_r") <= most).select(group, "_k", f"_v.{title}", f"_v.{value}", pos, F.lit(True).alias("active"))
    old = previous.groupBy(group, key.alias("_k")).agg(F.min_by(F.struct(title, value), pos).alias("_v"), F.min(pos).alias(pos))
    old = old.join(new.select(group, "_k"), [group, "_k"], "left_anti").select(group, "_k", f"_v.{title}", f"_v.{value}", pos, F.lit(False).alias("active"))
    return new.unionByName(old).drop("_k")


def replaced(rows: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the updated value where there is one."""
    return rows.join(updates.select(key, F.col(value).alias("_new")), key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def improving_candidates(candidates: DataFrame, evaluations: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Candidates whose evaluation got better; one without the other raises."""
    both = candidates.withColumn("_a", F.lit(1)).join(evaluations.withColumn("_b", F.lit(1)), key, "full")
    whole = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("candidates and evaluations don't cover each other")).cast("boolean"))
    return both.where(whole).where(F.col(after) > F.col(before)).drop("_a", "_b")


def pair_matrix(scores: DataFrame, group: str, node: str, candidate: str, raw: str, reward: str) -> DataFrame:
    """(group, left, right, sign, deltas): strict pairs of nodes with the score differences of all candidates, in their order.

    scores: one row a node and candidate; equal rows are one, unequal scores of one cell raise.
    """
    cell = scores.groupBy(group, node, candidate).agg(F.min(raw).alias("_s"), F.max(raw).alias("_t"), F.max(reward).alias("_r"))
    fine = F.when(F.col("_s") == F.col("_t"), F.col("_s")).otherwise(F.raise_error(F.lit("conflicting scores of one contract")).cast(scores.schema[raw].dataType))
    rows = cell.withColumn("_s", fine).groupBy(group, node).agg(F.array_sort(F.collect_list(F.struct(candidate, "_s"))).alias("_v"), F.max("_r").alias("_r"))
    rows = rows.select(group, node, F.transform("_v", lambda x: x["_s"]).alias("_v"), "_r")
    other = rows.select(group, F.col(node).alias("right"), F.col("_v").alias("_w"), F.col("_r").alias("_q"))
    pairs = rows.withColumnRenamed(node, "left").join(other, group).where("left < right and _r <> _q")
    return pairs.select(group, "left", "right", F.when(F.col("_r") > F.col("_q"), 1).otherwise(-1).alias("sign"), F.zip_with("_v", "_w", lambda a, b: a - b).alias("deltas"))


def first_accepted(attempts: DataFrame, keys: list[str], attempt: str, accepted: str) -> DataFrame:
    """(keys, attempt): the first accepted attempt, null where none is."""
    return attempts.groupBy(*keys).agg(F.min(F.when(F.col(accepted), F.col(attempt))).alias(attempt))


def outcome_rewards(rows: DataFrame, group: str, reward: str, chosen: Column, right: float, wrong: float) -> DataFrame:
    """``rows`` whose reward is multiplied by how the group's chosen answer came out: ``right`` where it has a reward, ``wrong`` where not."""
    good = F.max(F.when(chosen, F.col(reward))).over(Window.partitionBy(group)) > 0
    return rows.withColumn("scaled", F.col(reward) * F.when(F.coalesce(good, F.lit(False)), right).otherwise(wrong))


def child_spans(parts: DataFrame, span: str, order: str, start: str, duration: str) -> DataFrame:
    """(span, order, begin, end): parts laid one behind the other from their span's start; those of no duration are left out."""
    some = parts.where(F.col(duration) > 0)
    upto = F.sum(duration).over(Window.partitionBy(span).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return some.select(span, order, (F.col(start) + upto - F.col(duration)).alias("begin"), (F.col(start) + upto).alias("end"))


def paired_spans(events: DataFrame, trace: str, span: str, ts: str, kind: str, last: str) -> DataFrame:
    """(trace, span, begin, end, open): spans from their starts to their ends; open ones end at their trace's last time, orphan ends begin there.

    events: kind span_start or span_end; ``last``: the time the trace was read at.
    """
    by = events.where(F.col(span).isNotNull() & F.col(ts).isNotNull()).groupBy(trace, span).agg(
        F.min(F.when(F.col(kind) == "span_start", F.col(ts))).alias("_s"), F.max(F.when(F.col(kind) == "span_end", F.col(ts))).alias("_e"), F.max(last).alias("_l"))
    end = F.coalesce("_e", "_l")
    return by.where("_s is not null or _e is not null").select(trace, span, F.coalesce("_s", "_e").alias("begin"), F.greatest(end, F.coalesce("_s", "_e")).alias("end"), F.col("_e").isNull().alias("open"))


def inferred_source(source: Column, metadata: Column) -> Column:
    """The source of a sample: its own, its metadata's source or source_name, else any value whose key holds "source"."""
    filled = lambda c: F.nullif(c, F.lit(""))
    others = F.map_values(F.map_filter(metadata, lambda k, v: F.contains(F.lower(k), F.lit("source")) & v.isNotNull() & (v != "")))
    return F.coalesce(filled(source), *(filled(F.try_element_at(metadata, F.lit(k))) for k in ("source", "source_name")), F.get(others, 0))


def merged_metadata(sample: Column, kind: Column, overrides: Column) -> Column:
    """The sample's metadata with its grader's kind, both overruled by ``overrides``."""
    own = F.when(kind.isNull(), F.map_filter(sample, lambda k, v: F.lit(True))).otherwise(_put(sample, F.map_from_arrays(F.array(F.lit("rm_type")), F.array(kind))))
    return _put(own, overrides)


def _put(base: Column, over: Column) -> Column:
    rest = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return F.map_concat(rest, over)


def resolved(dataset: Column, default: Column, argument: Column) -> Column:
    """A setting from the dataset, the defaults or the arguments, in this order."""
    return F.coalesce(dataset, default, argument)


def patch_text(patch: Column, warning: str) -> Column:
    """The patch without leading lines of ``warning``, ending in a line end; blank: empty."""
    lines = F.regexp_replace(F.coalesce(patch, F.lit("")), r"^(?:\Q" + warning + r"\E(?:\r\n|\n|\r|$))+", "")
    return F.when(~lines.rlike(r"\S"), "").when(lines.endswith("\n"), lines).otherwise(F.concat(lines, F.lit("\n")))


def known_roles(role: Column) -> Column:
    """The role, one of user, assistant and system; others raise."""
    return F.when(role.isin("user", "assistant", "system"), role).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))))


def group_normalized(rows: DataFrame, group: str, reward: str, scale: bool = True) -> DataFrame:
    """``rows`` with ``normalized``: reward less its group's mean, over the sample deviation + 1e-6; single rows are null with the deviation."""
    w = Window.partitionBy(group)
    centred = F.col(reward) - F.avg(reward).over(w)
    return rows.withColumn("normalized", centred / (F.stddev_samp(reward).over(w) + 1e-6) if scale else centred)


def metric_columns(row_names: list[str], allowed: list[str], step: str) -> list[str]:
    """Names of metrics that may be logged, the step first."""
    return [step, *(n for n in row_names if n in allowed and n != step)]


def short_prompts(rows: DataFrame, tokens: str, most: int | None) -> DataFrame:
    """Rows of at most ``most`` tokens (none: all); rows without tokens stay."""
    return rows if most is None else rows.where(F.coalesce(F.size(tokens) <= most, F.lit(True)))


def chosen_instances(rows: DataFrame, name: str, pattern: str, begin: int, end: int, seed: int | None = None) -> DataFrame:
    """Rows whose name starts with the pattern, a slice of them by name or, with a seed, by hash."""
    found = rows.where(F.col(name).rlike(f"^(?:{pattern})"))
    order = [F.col(name)] if seed is None else [F.xxhash64(name, F.lit(seed)), F.col(name)]
    return found.orderBy(*order).offset(begin).limit(max(0, end - begin))
