"""Rollout samples: metrics, conversion to training rows, token invariants and run health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import after_think, let
from .groups import nearest_ranks

_INT = "array<int>"


def _summary(value: str, prefix: str) -> list[Column]:
    return [f(value).alias(f"{prefix}_{n}") for n, f in (("mean", F.avg), ("median", F.median), ("max", F.max), ("min", F.min))]


def sample_metrics(samples: DataFrame, truncated: Column, repeated: Column) -> DataFrame:
    """One row: statistics of ``length``, shares of repetition and truncation, cache hits, draft acceptance.

    samples: (length, cached, prompt_tokens, accepted, drafted, steps); ratios of sums for the
    cache, means of each sample's ratios (0 without a draft) for the drafts.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    each = lambda a, b: F.avg(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return samples.agg(
        *_summary("length", "response_len"), share(repeated).alias("repetition_frac"), share(truncated).alias("truncated_ratio"),
        F.coalesce(F.try_divide(F.sum("cached"), F.sum("prompt_tokens")), F.lit(0.0)).alias("prefix_cache_hit_rate"),
        (F.sum("cached") / F.count(F.lit(1))).alias("avg_cached_tokens_per_sample"),
        each("accepted", "drafted").alias("spec_accept_rate"), each("accepted", "steps").alias("spec_accept_length"),
    )


def speed_metrics(samples: DataFrame, seconds: float, gpus: int, length: str = "length", waiting: str = "waiting") -> DataFrame:
    """One row: tokens a GPU and second, and the longest sample's rate, with and without the time it waited.

    The waiting of all samples tied at the greatest length is averaged; without
    any waiting these columns are null.
    """
    top = samples.agg(F.max(length).alias("_top"), F.sum(length).alias("_sum"), F.max(waiting).alias("_wait"))
    tied = samples.join(F.broadcast(top), F.col(length) == F.col("_top")).groupBy("_top", "_sum", "_wait").agg(F.avg(waiting).alias("_mean"))
    rest = F.when(F.col("_wait") > 0, F.col("_mean"))
    return tied.select(
        (F.col("_sum") / seconds / gpus).alias("tokens_per_gpu_per_sec"), (F.col("_top") / seconds).alias("longest_tokens_per_sec"),
        rest.alias("longest_non_generation_time"), F.try_divide(F.col("_top"), seconds - rest).alias("longest_tokens_per_sec_without_waiting"),
    )


def kept_vocabulary(samples: DataFrame) -> DataFrame:
    """One row (top_p_kept_vocab_per_token) of samples (offsets, mask, removed): tokens kept under the mask over masked tokens.

    A null mask keeps all; null or empty offsets and removed samples don't
    count. Offsets are one more than the mask, or it raises. Null without tokens.
    """
    widths = let(F.col("offsets"), lambda o: F.zip_with(F.slice(o, 2, F.size(o)), F.slice(o, 1, F.greatest(F.size(o) - 1, F.lit(0))), lambda b, a: b - a))
    mask = F.coalesce(F.col("mask"), F.array_repeat(F.lit(1), F.size("offsets") - 1))
    fits = F.when(F.size(mask) == F.size("offsets") - 1, mask).otherwise(F.raise_error(F.lit("loss mask and offsets differ in length")).cast(_INT))
    used = samples.where(F.col("offsets").isNotNull() & (F.size("offsets") > 1) & ~F.coalesce("removed", F.lit(False)))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    each = used.select(total(F.zip_with(widths, fits, lambda w, m: w * m)).alias("kept"), total(fits).alias("tokens"))
    return each.agg(F.try_divide(F.sum("kept"), F.sum("tokens")).alias("top_p_kept_vocab_per_token"))


def request_metrics(events: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, median, max, min) over the finite values of events' metric columns."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = events.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")
    fine = long.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return fine.groupBy("metric").agg(*(f("value").alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("max", F.max), ("min", F.min))))


def eval_metrics(samples: DataFrame, dataset: str, reward: str, truncated: Column) -> DataFrame:
    return samples.groupBy(dataset).agg(F.avg(reward).alias("reward"), F.avg(truncated.cast("int")).alias("truncated_ratio"))


def turn_metrics(samples: DataFrame, mask: str, rounds: str, longest: int) -> DataFrame:
    """One row: lengths with and without observations (masked out), share at the limit, rounds."""
    rows = samples.select(F.size(mask).alias("raw"), F.aggregate(mask, F.lit(0), lambda s, v: s + v.cast("int")).alias("own"), F.col(rounds).alias("rounds"))
    three = lambda c, n: [f(c).alias(f"{n}_{k}") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return rows.agg(*three("raw", "raw"), F.avg((F.col("raw") >= longest).cast("int")).alias("clip_ratio"), *three("own", "wo_obs"), *three("rounds", "round_number"))


def step_metrics(batches: DataFrame, key: str, value: str, tokens: str, per_token: bool, batch_size: int, copies: int = 1) -> DataFrame:
    """(key, mean) of micro-batches (key, value, tokens): sums over all tokens (copies cancel), or over the constant batch size."""
    total = F.sum(F.col(value).cast("double"))
    return batches.groupBy(key).agg((total * copies / F.sum(tokens) if per_token else total / batch_size).alias("mean"))


def rank_contribution(total: Column, copies: int, rollouts: Column, width: int) -> Column:
    """struct(sum, count) that a rank hands over, so that the sum of sums over that of counts is the mean a rollout."""
    return F.struct((total * copies).alias("sum"), (rollouts / width).alias("count"))


def group_meta(samples: DataFrame, group: str, reward: str) -> DataFrame:
    """One row: samples, groups, mean group size and reward; zeros without any."""
    by = samples.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(reward).alias("r"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"), F.count(F.lit(1)).alias("num_groups"),
        zero(F.try_divide(F.sum("n"), F.count(F.lit(1)))).alias("avg_group_size"), zero(F.try_divide(F.sum("r"), F.sum("n"))).alias("avg_reward"),
    )


def usage_fractions(requests: Column, missing: Column, failed: Column) -> Column:
    """struct(exact, failed): 1 and 0 where there was no request."""
    return F.struct(F.coalesce(F.try_divide(requests - missing, requests), F.lit(1.0)).alias("exact"), F.coalesce(F.try_divide(failed, requests), F.lit(0.0)).alias("failed"))


def training_progress(attempts: Column, budget: Column, size: Column) -> Column:
    """struct(attempts, budget, epoch)."""
    return F.struct(attempts.alias("attempts"), budget.alias("budget"), F.coalesce(F.try_divide(attempts, size), F.lit(0.0)).alias("epoch"))


def train_speed(times: DataFrame, flops: str, tokens: str) -> DataFrame:
    """Rates of steps (log_probs_time, actor_train_time, train_time, train_wait_time, flops, tokens); training counts three passes.

    Null where a time is missing or zero.
    """
    per = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    whole = F.col("train_wait_time") + F.col("train_time")
    return times.withColumns({
        "log_probs_tflops": per(F.col(flops), F.col("log_probs_time")), "actor_train_tflops": per(3 * F.col(flops), F.col("actor_train_time")),
        "actor_train_tok_per_s": per(F.col(tokens), F.col("actor_train_time")), "step_time": F.when(whole > 0, whole), "wait_time_ratio": per(F.col("train_wait_time"), whole),
    })


def head_and_tail(rows: DataFrame, rank: str, total: int, ratio: float) -> DataFrame:
    """The first and the last rows by ``rank`` (from 0), about ``ratio`` of ``total`` together: half rounded down, half up."""
    some = int(total * ratio)
    head, tail = some // 2, -(-some // 2)
    return rows.where((F.col(rank) < head) | (F.col(rank) >= total - tail)) if tail else rows.where(F.lit(total >= 0))


def fill_ids(rows: DataFrame, pos: str, ident: str) -> DataFrame:
    """``rows`` where null ids are the smallest whole numbers not in use, in order of position.

    The unused numbers wanted are below nulls + known ids; both lists are numbered by
    ranges (``with_rank``), so no task holds them all.
    """
    from .order import with_rank

    known = rows.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("_id")).distinct()
    lacking = rows.where(F.col(ident).isNull())
    n, most = known.count(), lacking.count()
    free = rows.sparkSession.range(n + most).withColumnRenamed("id", "_id").join(known, "_id", "left_anti")
    free = with_rank(free, "_id").select(F.col("_id").alias("_new"), F.col("rank").alias("_k"))
    filled = with_rank(lacking, pos).withColumnRenamed("rank", "_k").join(free, "_k").withColumn(ident, F.col("_new").cast(rows.schema[ident].dataType))
    return rows.where(F.col(ident).isNotNull()).unionByName(filled.select(*rows.columns))


def mask_sums(samples: DataFrame, rollout: str, mask: str) -> DataFrame:
    """``samples`` with ``rollout_mask_sum``, the masked tokens of all samples of their rollout."""
    own = F.aggregate(mask, F.lit(0), lambda s, v: s + v.cast("int"))
    return samples.withColumn("rollout_mask_sum", F.sum(own).over(Window.partitionBy(rollout)))


def training_rows(samples: DataFrame) -> DataFrame:
    """Samples (index, response_length, loss_mask, removed, status) as training rows: full masks for null ones, zeros for removed samples; a wrong length raises."""
    mask = F.coalesce(F.col("loss_mask"), F.array_repeat(F.lit(1), F.col("response_length")))
    fits = F.when(F.size(mask) == F.col("response_length"), mask).otherwise(F.raise_error(F.lit("loss mask length differs from response length")).cast(_INT))
    out = F.when(F.coalesce("removed", F.lit(False)), F.transform(fits, lambda _: F.lit(0))).otherwise(fits)
    return samples.withColumn("loss_mask", out).withColumn("truncated", F.coalesce(F.col("status") == "truncated", F.lit(False)).cast("int"))


def compact_errors(samples: DataFrame, branch: str, rollout: str) -> DataFrame:
    """(branch, error) of branches of several samples whose rollout id is missing or not one."""
    by = samples.groupBy(branch).agg(F.count(F.lit(1)).alias("n"), F.count(rollout).alias("known"), F.count_distinct(rollout).alias("ids"))
    error = F.when(F.col("known") < F.col("n"), "rollout_id is unset").when(F.col("ids") > 1, "siblings must share rollout_id")
    return by.where("n > 1").select(branch, error.alias("error")).where("error is not null")


def has_exact_tokens(prompt: Column, tokens: Column, logprobs: Column) -> Column:
    """All three are there and not empty, as many log-probabilities as tokens, each finite."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    known = lambda c: F.forall(c, lambda v: v.isNotNull())
    finite = F.forall(logprobs, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(some(prompt) & some(tokens) & (F.size(logprobs) == F.size(tokens)) & known(prompt) & known(tokens) & finite, F.lit(False))


def exact_token_errors(messages: DataFrame, trajectory: str, pos: str) -> DataFrame:
    """(trajectory, error): the first assistant message without exact tokens, as a code; null where all have them.

    messages: (trajectory, pos, role, prompt_token_ids, token_ids, logprobs, finish_reason).
    """
    own = messages.where("role = 'assistant'")
    index = F.row_number().over(Window.partitionBy(trajectory).orderBy(pos)) - 1
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("string")
    code = F.concat(
        F.lit("invalid_policy_completion:assistant_index="), F.col("_i").cast("string"), F.lit(":finish_reason="), F.coalesce(F.nullif("finish_reason", F.lit("")), F.lit("unknown")),
        F.lit(":prompt_tokens="), size("prompt_token_ids"), F.lit(":output_tokens="), size("token_ids"), F.lit(":logprobs="), size("logprobs"),
    )
    bad = ~has_exact_tokens(F.col("prompt_token_ids"), F.col("token_ids"), F.col("logprobs"))
    first = own.withColumn("_i", index).where(bad).groupBy(trajectory).agg(F.min_by(code, "_i").alias("_e"))
    some = own.select(trajectory).distinct().withColumn("_some", F.lit(True))
    every = messages.select(trajectory).distinct().join(some, trajectory, "left").join(first, trajectory, "left")
    return every.select(trajectory, F.when(F.col("_some").isNull(), "invalid_policy_completion:no_assistant_turns").otherwise(F.col("_e")).alias("error"))


def length_errors(response_length: Column, mask: Column, logprobs: Column, ids: Column, offsets: Column) -> Column:
    """Array of what doesn't fit a sample's response length; null arrays aren't there."""
    lone = ids.isNull() != offsets.isNull()
    return F.array_compact(F.array(
        F.when(F.size(mask) != response_length, "loss_mask length"), F.when(F.size(logprobs) != response_length, "rollout_log_probs length"),
        F.when(lone, "top-p replay needs ids and offsets"), F.when(~lone & (F.size(offsets) != response_length + 1), "offsets length"),
        F.when(~lone & (F.size(offsets) == response_length + 1) & (F.get(offsets, F.size(offsets) - 1) != F.size(ids)), "offsets and ids differ"),
    ))


def append_tokens(tokens: Column, response_length: Column, mask: Column, logprobs: Column, new: Column, new_logprobs: Column, trainable: Column) -> Column:
    """struct(tokens, response_length, loss_mask, logprobs) with a response part appended, training data kept in line.

    Trained tokens need as many log-probabilities, others none (they get 0). A
    null mask so far counts as ones; log-probabilities may only start with a
    trained part where the response is empty so far.
    """
    n = F.size(new)
    zeros = F.array_repeat(F.lit(0.0), n)
    error = (
        F.when(trainable & (n > 0) & new_logprobs.isNull(), "trainable response tokens require log probabilities")
        .when(new_logprobs.isNotNull() & (F.size(new_logprobs) != n), "log_probs length differs from tokens")
        .when(~trainable & (n > 0) & new_logprobs.isNotNull(), "non-trainable tokens take no log probabilities")
        .when(trainable & (n > 0) & logprobs.isNull() & (response_length > 0), "existing response tokens have no log probabilities")
    )
    before = F.coalesce(mask, F.array_repeat(F.lit(1), response_length))
    added = F.when(trainable, new_logprobs).otherwise(zeros)
    known = F.coalesce(logprobs, F.array_repeat(F.lit(0.0), response_length))
    out = F.struct(
        F.concat(tokens, new).alias("tokens"), (response_length + n).alias("response_length"),
        F.concat(before, F.array_repeat(F.when(trainable, 1).otherwise(0), n)).alias("loss_mask"), F.concat(known, F.coalesce(added, zeros)).alias("logprobs"),
    )
    return F.when(error.isNull(), out).otherwise(F.raise_error(error).cast("struct<tokens:array<int>,response_length:int,loss_mask:array<int>,logprobs:array<double>>"))


def cut_sample(tokens: Column, mask: Column, response_length: Column, logprobs: Column, longest: int) -> Column:
    """struct(tokens, loss_mask, logprobs, response_length, status, cut): the first ``longest`` tokens, the mask of the response part alone.

    Lengths that don't agree, or no response token left, raise.
    """
    if longest <= 0:
        raise ValueError("the longest sample must be positive")
    n = F.size(tokens)
    kept = F.greatest(F.lit(0), F.least(response_length, longest - n + response_length))
    error = (
        F.when(F.size(mask) != n, "token_ids and loss_mask differ in length").when((response_length <= 0) | (response_length > n), "invalid response_length")
        .when(F.size(logprobs) != response_length, "rollout_logprobs and response_length differ").when(kept <= 0, "no response tokens after truncation")
    )
    short = F.slice(mask, 1, longest)
    out = F.struct(
        F.slice(tokens, 1, longest).alias("tokens"), F.slice(short, F.size(short) - kept + 1, kept).alias("loss_mask"), F.slice(logprobs, 1, kept).alias("logprobs"),
        kept.alias("response_length"), F.when(n > longest, "truncated").otherwise("completed").alias("status"), F.greatest(F.lit(0), n - longest).alias("cut"),
    )
    shape = "struct<tokens:array<int>,loss_mask:array<int>,logprobs:array<double>,response_length:int,status:string,cut:int>"
    return F.when(error.isNull(), out).otherwise(F.raise_error(error).cast(shape))


def parsed_message(role: Column, content: Column, message: Column, raw_output: Column, exception: Column) -> Column:
    """struct(role, text, plain) of a saved message; null for roles other than assistant, user and exit.

    A user's raw output counts before its content; an exit is an assistant's
    message, its exception first. ``plain``: an assistant's text after its thoughts.
    """
    text = F.coalesce(content, message, F.lit(""))
    said = F.when(role == "assistant", text).when(role == "exit", F.coalesce(F.nullif(exception, F.lit("")), text)).otherwise(F.coalesce(raw_output, text))
    thought = F.contains(text, F.lit("</think>"))
    plain = F.when((role == "assistant") & thought, F.regexp_replace(after_think(text), r"^[\r\n]+", ""))
    out = F.struct(F.when(role == "user", "user").otherwise("assistant").alias("role"), said.alias("text"), plain.alias("plain"))
    return F.when(role.isin("assistant", "user", "exit"), out)


def normalized_usage(prompt: Column, input_: Column, completion: Column, output: Column, cached: Column, known_input: Column, known_output: Column, payload: Column) -> Column:
    """struct of token counts: prompt before input before what the request knows; cached ones are part of the input.

    ``payload``: the provider told anything. Negative counts are unknown.
    """
    count = lambda c: F.when(c >= 0, c)
    told_in, told_out = F.coalesce(count(prompt), count(input_)), F.coalesce(count(completion), count(output))
    from_request = (told_in.isNull() & known_input.isNotNull()) | (told_out.isNull() & known_output.isNotNull())
    all_in, all_out = F.coalesce(told_in, count(known_input)), F.coalesce(told_out, count(known_output))
    exact = all_in.isNotNull() & all_out.isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    source = (
        F.when(from_request & payload, "provider_and_token_ids").when(from_request, "token_ids").when(payload & exact, "provider")
        .when(payload, "provider_partial").otherwise("missing")
    )
    return F.struct(
        zero(all_in).alias("input_tokens"), F.least(zero(all_in), zero(count(cached))).alias("cached_input_tokens"), zero(all_out).alias("output_tokens"),
        (zero(all_in) + zero(all_out)).alias("total_tokens"), exact.alias("exact_usage"), source.alias("usage_source"),
    )


def first_completed(groups: DataFrame, order: str, keep: Column, n: int, index: str) -> DataFrame:
    """The first ``n`` groups by arrival that pass the filter (null: no filter), by sample index. A top-n, not a global sort."""
    return groups.where(F.coalesce(keep, F.lit(True))).orderBy(order).limit(n).orderBy(index)


def run_health(trajectories: DataFrame, run: str) -> DataFrame:
    """(run, n, turns_p50, turns_p90, turns_p99, turns_max, rates, groups_dropped, group_drop_rate) of trajectories.

    trajectories: (run, turns, loop_turns, empty_outputs, timeouts, submitted, invalid, group).
    Percentiles are nearest ranks of sorted values, by counts of distinct
    values: a run of any size takes as much memory as it has distinct ones.
    """
    ranks = nearest_ranks(trajectories, run, "turns", [0.5, 0.9, 0.99])
    most = trajectories.groupBy(run).agg(F.max("turns").alias("turns_max"))
    percentiles = ranks.select(run, *(F.col(f"p{q}").alias(f"turns_p{q}") for q in (50, 90, 99))).join(most, run)
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 3)
    rates = trajectories.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("loop_turns") >= 4).alias("looped_traj_rate"), rate(F.col("empty_outputs") >= 3).alias("empty_heavy_rate"),
        rate(F.col("timeouts") > 0).alias("timeout_rate"), rate(F.col("submitted")).alias("submitted_rate"), rate(F.col("invalid")).alias("invalid_rate"),
    )
    groups = trajectories.where(F.col("group").isNotNull()).groupBy(run, "group").agg(F.bool_or("invalid").alias("bad"))
    groups = groups.groupBy(run).agg(F.count_if("bad").alias("groups_dropped"), F.round(F.count_if("bad") / F.count(F.lit(1)), 3).alias("group_drop_rate"))
    out = rates.join(percentiles, run).join(groups, run, "left")
    return out.withColumns({"groups_dropped": F.coalesce("groups_dropped", F.lit(0)), "group_drop_rate": F.coalesce("group_drop_rate", F.lit(0.0))})


def rank_summary(kernels: DataFrame, rank: str, kind: str, spent: str, busy: str, limit: float = 5.0) -> DataFrame:
    """(rank, gemm, nccl, utilization, spread, imbalance): sums a rank, and whether the utilisations lie more than ``limit`` apart."""
    part = lambda text: F.sum(F.when(F.contains(F.col(kind), F.lit(text)), F.col(spent)).otherwise(0.0))
    by = kernels.groupBy(rank).agg((part("GEMM") + part("MatMul")).alias("gemm"), part("NCCL").alias("nccl"), F.avg(busy).alias("utilization"))
    spread = by.agg((F.max("utilization") - F.min("utilization")).alias("spread"), F.lit(1).alias("_one"))
    return by.withColumn("_one", F.lit(1)).join(F.broadcast(spread), "_one").drop("_one").withColumn("imbalance", F.col("spread") > limit)


def span_sample(turns: Column) -> Column:
    """struct(tokens, loss_mask, logprobs, response_length) of a rollout's assistant turns, array<struct<prompt, ids, logprobs>>.

    The sequence is the last turn's prompt and output; each turn's output is
    trained where its own prompt ends. Log-probabilities cover the response, from
    the first prompt's end, with 0 outside the outputs. Null if there is no turn
    or one lacks exact tokens; a prompt that isn't a prefix of the last one raises.
    """
    exact = F.forall(turns, lambda t: has_exact_tokens(t["prompt"], t["ids"], t["logprobs"]))

    def build(ts: Column) -> Column:
        last = F.get(ts, F.size(ts) - 1)
        begin = lambda t: F.size(t["prompt"])
        prefix = F.forall(ts, lambda t: F.slice(last["prompt"], 1, begin(t)) == t["prompt"])
        # Zeros up to each output, counted from the output before it.
        gap = lambda t, k: begin(t) - F.coalesce(begin(F.get(ts, k - 1)) + F.size(F.get(ts, k - 1)["ids"]), F.lit(0))
        mask = F.flatten(F.transform(ts, lambda t, k: F.concat(F.array_repeat(F.lit(0), gap(t, k)), F.transform(t["ids"], lambda _: F.lit(1)))))
        dense = F.flatten(F.transform(ts, lambda t, k: F.concat(F.array_repeat(F.lit(0.0), gap(t, k)), t["logprobs"])))
        lead = begin(F.get(ts, 0))
        n = F.size(mask) - lead
        out = F.struct(F.concat(last["prompt"], last["ids"]).alias("tokens"), mask.alias("loss_mask"), F.slice(dense, lead + 1, n).alias("logprobs"), n.alias("response_length"))
        fail = F.raise_error(F.lit("a turn's prompt is no prefix of the last one")).cast("struct<tokens:array<int>,loss_mask:array<int>,logprobs:array<double>,response_length:int>")
        return F.when(prefix, out).otherwise(fail)

    return F.when((F.size(turns) > 0) & exact, let(turns, build))


def message_cards(messages: DataFrame, trajectory: str, pos: str) -> DataFrame:
    """(trajectory, step, assistant_pos, observation): assistant messages with the user message right behind; the last one may lack it.

    Of assistant messages in a row only the last one has a card; other roles are passed over.
    """
    w = Window.partitionBy(trajectory).orderBy(pos)
    turns = messages.where(F.col("role").isin("assistant", "user"))
    turns = turns.withColumn("_next", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    cards = turns.where("role = 'assistant' and coalesce(_next, 'user') = 'user'")
    step = F.row_number().over(w) - 1
    return cards.select(trajectory, step.alias("step"), F.col(pos).alias("assistant_pos"), F.coalesce("_text", F.lit("")).alias("observation"))


def within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The first rows of each group by order whose sizes together stay within the budget."""
    upto = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_upto", upto).where(F.col("_upto") <= budget).drop("_upto")


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """``rows`` with ``place``, a number whose order is the epoch's: a hash of key, seed and epoch (ties by key). Sorting is left to the reader."""
    return rows.withColumn("place", F.xxhash64(key, F.lit(seed + epoch)))


def prefixed(metrics: DataFrame, prefix: str) -> DataFrame:
    return metrics.select(*(F.col(c).alias(f"{prefix}/{c}") for c in metrics.columns))
