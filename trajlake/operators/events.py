"""Event logs: usage ledgers, intervals, runs, steps and span trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import remove, written
from .groups import nearest_ranks

DROPPED = ["dropped", "filtered", "invalid", "rejected", "excess", "partial_dropped"]


def usage_totals(requests: DataFrame, dispositions: DataFrame, by: list[str]) -> DataFrame:
    """Tokens by key, and those of groups whose last disposition is a drop; the first row of an event id counts.

    requests: (event_id, ord, group_id, tokens, failed, *by); dispositions: (group_id, ord, disposition).
    """
    first = requests.groupBy("event_id").agg(F.min_by(F.struct("group_id", "tokens", "failed", *by), "ord").alias("r")).select("r.*")
    last = dispositions.groupBy("group_id").agg(F.max_by("disposition", "ord").alias("disposition"))
    gone = F.coalesce(F.col("disposition").isin(DROPPED), F.lit(False))
    return first.join(last, "group_id", "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.count_if("failed").alias("failed"),
        F.coalesce(F.sum(F.when(gone, F.col("tokens"))), F.lit(0)).alias("dropped_tokens"),
    )


def busy_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, busy, idle, islands): union length of intervals and the gaps between its islands."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_b", before)
    new = F.col("_b").isNull() | (F.col(start) > F.col("_b"))
    rows = rows.withColumn("_gap", F.when(F.col(start) > F.col("_b"), F.col(start) - F.col("_b")).otherwise(0))
    own = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("_b", start)), F.lit(0))
    return rows.groupBy(key).agg(F.sum(own).alias("busy"), F.sum("_gap").alias("idle"), F.count_if(new).alias("islands"))


def longest_run(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, length, end): the first longest run of equal values; nulls break runs."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_j", F.row_number().over(Window.partitionBy(key, value).orderBy(order)))
    runs = rows.where(F.col(value).isNotNull()).groupBy(key, value, (F.col("_i") - F.col("_j")).alias("_k"))
    runs = runs.agg(F.count(F.lit(1)).alias("length"), F.max("_i").alias("end"))
    best = F.max(F.struct("length", (-F.col("end")).alias("e"))).alias("b")
    return runs.groupBy(key).agg(best).select(key, "b.length", (-F.col("b.e")).alias("end"))


def step_cards(df: DataFrame, key: str, order: str, closes: Column, kind: Column, value: str) -> DataFrame:
    """Events folded to steps: one that closes ends its step; the last value of a kind wins."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    step = F.coalesce(F.sum(closes.cast("int")).over(w), F.lit(0))
    rows = df.withColumn("step", step)
    return rows.groupBy(key, "step").agg(F.count(F.lit(1)).alias("events"), F.max_by(F.when(kind, F.col(value)), F.when(kind, F.col(order))).alias("last"))


def span_depths(spans: DataFrame, span: str, parent: str) -> DataFrame:
    """(span, depth) by pointer doubling; a missing parent or a root is 0, and so is a span on a cycle."""
    ids = spans.select(F.col(span).alias("s"), F.col(parent).alias("up")).dropDuplicates(["s"])
    there = ids.select(F.col("s").alias("up"), F.lit(True).alias("ok"))
    jump = ids.join(there, "up", "left").select("s", F.when(F.col("ok"), F.col("up")).alias("up"), F.coalesce("ok", F.lit(False)).cast("long").alias("d"))
    spark, old = spans.sparkSession, []
    for _ in range(int(spans.count()).bit_length() + 1):
        jump, path = written(jump, "jump")
        remove(spark, *old[:-1])
        old = [*old[-1:], path]
        if jump.where("up is not null").isEmpty():
            break
        more = jump.select(F.col("s").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        # Spans at their root aren't looked up: their null keys would meet in one task.
        rest = jump.where("up is not null").join(more, "up").select("s", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"))
        jump = rest.unionByName(jump.where("up is null"))
    return jump.select(F.col("s").alias(span), F.when(F.col("up").isNull(), F.col("d")).otherwise(0).alias("depth"))


def deltas(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """What a cumulative value gained since the row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("delta", F.col(value) - F.coalesce(before, F.lit(0)))


def periodic(step: Column, every: int, epoch: int, last: int) -> Column:
    return ((step + 1) % every == 0) | ((step + 1) % epoch == 0) | (step == last - 1)


def stack_parents(events: DataFrame, trace: str, order: str, kind: str, span: str) -> DataFrame:
    """``events`` (trace, order, kind, span) with ``parent``: the span that was open last before the event.

    A start opens its span, an end closes the latest of its name. Rows of one
    trace are held in memory.
    """
    slim = events.select(trace, order, kind, span)

    def run(rows):
        open_, parents = [], []
        rows = rows.sort_values(order, kind="stable")
        for what, name in zip(rows[kind], rows[span], strict=True):
            parents.append(open_[-1] if open_ else None)
            if what == "span_start" and name:
                open_.append(name)
            elif what == "span_end" and name in open_:
                del open_[len(open_) - 1 - open_[::-1].index(name)]
        return rows.assign(parent=parents)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return slim.groupBy(trace).applyInPandas(run, f"{shape}, parent string")


def top_gaps(df: DataFrame, key: str, start: str, end: str, ops: DataFrame, order: str, name: str, k: int = 15) -> DataFrame:
    """(key, rank, gap, begin, finish, cause): the ``k`` longest gaps between islands of intervals, each with the first operation by order that overlaps it.

    Only gaps of the top k meet operations, so the join is k times a key's operations. Without one the cause is unknown.
    """
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    gaps = df.withColumn("begin", before).where(F.col(start) > F.col("begin")).select(key, "begin", F.col(start).alias("finish"), (F.col(start) - F.col("begin")).alias("gap"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("gap"), F.desc("begin")))
    top = gaps.withColumn("rank", rank).where(F.col("rank") <= k)
    own = ops.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(order).alias("_o"), F.col(name).alias("_n"))
    hit = top.join(own, (F.col(key) == F.col("_k")) & (F.col("_s") < F.col("finish")) & (F.col("_e") > F.col("begin")), "left")
    return hit.groupBy(key, "rank", "gap", "begin", "finish").agg(F.coalesce(F.min_by("_n", "_o"), F.lit("unknown")).alias("cause"))


#: Characters from which on a turn may loop, of its head that is compared, and a token's share of a character.
LOOP_CHARS, LOOP_HEAD, TOKENS_A_CHAR = 1500, 400, 1 / 3.5


def trajectory_counters(messages: DataFrame, key: str, order: str, empty_marks: list[str], death: str, timeout: str) -> DataFrame:
    """One row of health counters a trajectory of messages (key, order, role, text).

    Loops: long assistant turns whose trimmed heads repeat. Empty outputs: user
    messages of return code 0 that hold a mark of ``empty_marks``, blanks left
    out. Deaths and timeouts: user messages that hold their mark; the first
    death is told by its place among the messages. Percentiles are nearest ranks.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = messages.select(key, F.col("role"), F.coalesce("text", F.lit("")).alias("text"), place.alias("_i"))
    bare = lambda c: F.translate(c, " \n", "")
    own, told = F.col("role") == "assistant", F.col("role") == "user"
    empty = F.lit(False)
    for mark in empty_marks:
        empty = empty | F.contains(bare(F.col("text")), bare(F.lit(mark)))
    empty = told & F.contains("text", F.lit("<returncode>0</returncode>")) & empty
    dead = told & F.contains("text", F.lit(death))
    size = F.when(own, F.length("text"))
    by = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_msgs"), F.count_if(own).alias("n_assistant_turns"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("asst_chars_total"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("asst_per_turn_max"), F.count_if(empty).alias("empty_bash_outputs"), F.count_if(dead).alias("docker_death_msgs"),
        F.coalesce(F.min(F.when(dead, F.col("_i"))), F.lit(-1)).cast("long").alias("first_docker_death_msg"), F.count_if(told & F.contains("text", F.lit(timeout))).alias("litellm_timeout_msgs"),
    )
    head = F.md5(F.left(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit(LOOP_HEAD)).cast("binary"))
    loops = rows.where(own & (F.length("text") >= LOOP_CHARS)).groupBy(key, head.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    loops = loops.groupBy(key).agg(F.sum("_n").alias("loop_turns"), F.count(F.lit(1)).alias("loop_signatures_repeated"))
    sizes = rows.where(own).select(key, F.length("text").cast("long").alias("_s"))
    p90 = nearest_ranks(sizes, key, "_s", [0.9]).withColumnRenamed("p90", "asst_per_turn_p90")
    out = by.join(loops, key, "left").join(p90, key, "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("loop_turns", "loop_signatures_repeated", "asst_per_turn_p90")}
    return out.withColumns(zero | {"asst_tokens_est": F.floor(F.col("asst_chars_total") * TOKENS_A_CHAR).cast("long")})
