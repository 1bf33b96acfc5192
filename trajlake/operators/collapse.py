"""Unrecovered mode collapse of trajectories, with one shuffle by trajectory.

A step counts as recovered when a long enough run of clean command steps, or a command before the final submission,
comes after it. Both are known from three numbers of a trajectory, so that no rule needs a scan of its own:
the last step that ends a clean run of three, that of four, and the last command before the last submission.
All windows, and the aggregates that follow them, keep the partitioning by trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_counters, let, squeeze

#: Limits of the rules.
LONG_RESPONSE, RUN_PATTERN = 8_000, r"(?s)(.)\1{2047}"
STREAM_CHARS, STREAM_BLOCKS, BLOCK = 40_000, 4, "```mswea_bash_command"
WINDOW, LEAST_WORDS, REPEATED_SHARE, PEAK = 24, 800, 0.35, 4
SUBMIT, PATCH, FORMAT_ERROR = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT", "diff --git ", "Format error:"
CHECKOUT = r"(?:^|&&|;)\s*git\s+checkout(?:\s+--)?\s+([^\s;&|]+)"
RUN, PERIODS = 6, (2, 3, 4)


def cycles(messages: DataFrame, key: str, order: str, role: str, content: str, commands: str, limit: int | None = None) -> DataFrame:
    """(key, step, response, commands, format_error, terminal, repetition): a row for each assistant turn up to ``limit``.

    Null texts count as empty, null commands as none. The first user turn before the next assistant turn tells format errors.
    """
    mine = F.col(role) == "assistant"
    turn = F.sum(F.coalesce(mine, F.lit(False)).cast("int")).over(Window.partitionBy(key).orderBy(order))
    rows = messages.select(
        F.col(key), F.col(order).alias("_o"), F.col(role).alias("_r"), F.coalesce(content, F.lit("")).alias("_c"),
        F.filter(F.transform(F.coalesce(commands, F.array().cast("array<string>")), squeeze), lambda c: c != "").alias("_m"),
        (turn - 1).alias("step"),
    ).where(F.col("step") >= 0)
    if limit is not None:
        rows = rows.where(F.col("step") < limit)
    said = F.col("_r") == "assistant"
    # a turn's own row comes first, so that only it says "assistant" within the step
    steps = rows.groupBy(key, "step").agg(
        F.max(F.when(said, F.struct("_c", "_m"))).alias("a"),
        F.min_by("_c", F.when(F.col("_r") == "user", F.col("_o"))).alias("_u"),
    ).select(key, "step", "a.*", "_u")
    submits = F.exists("_m", lambda c: c.contains(SUBMIT))
    steps = steps.select(
        key, "step", F.col("_c").alias("content"), F.col("_m").alias("commands"),
        F.coalesce(F.ltrim(F.col("_u")).startswith(FORMAT_ERROR), F.lit(False)).alias("format_error"),
        (F.ltrim("_c").startswith(PATCH) | submits).alias("terminal"),
    )
    return _repetition(steps, key)


def _repeated_windows(words: Column) -> Column:
    """struct(prev, run, repeated, peak) of windows of words: those that occur again, and how often the commonest does."""
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    hashes = F.array_sort(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    zero = F.lit(0)
    start = F.struct(F.lit(None).cast("long").alias("prev"), zero.alias("run"), zero.alias("repeated"), zero.alias("peak"))

    def step(s: Column, h: Column) -> Column:
        run = F.when(s["prev"] == h, s["run"] + 1).otherwise(1)
        more = F.when(run == 2, 2).when(run > 2, 1).otherwise(0)
        return F.struct(h.alias("prev"), run.alias("run"), (s["repeated"] + more).alias("repeated"), F.greatest(s["peak"], run).alias("peak"))

    return F.aggregate(hashes, start, step)


def _repetition(steps: DataFrame, key: str) -> DataFrame:
    """Adds ``repetition``: why a single response counts as repeating itself, or null. Short responses aren't searched."""
    content = F.col("content")
    prose = F.lower(F.regexp_replace(content, r"(?s)```.*?```", " "))
    words = F.regexp_extract_all(prose, F.lit(r"([a-z_][a-z0-9_'-]*|[0-9]+)"), 1)
    peaks = let(words, lambda ws: F.when(F.size(ws) >= LEAST_WORDS, F.struct(_repeated_windows(ws).alias("r"), (F.size(ws) - WINDOW + 1).alias("n"))))
    share = lambda p: p["r"]["repeated"] / p["n"]
    repeats = let(peaks, lambda p: F.when(
        (share(p) >= REPEATED_SHARE) & (p["r"]["peak"] >= PEAK),
        F.format_string("intra_response_repetition:ratio=%.3f:peak=%d", share(p), p["r"]["peak"])))
    blocks = (F.length(content) - F.length(F.replace(content, F.lit(BLOCK), F.lit("")))) / len(BLOCK)
    stream = (F.length(content) >= STREAM_CHARS) & (F.size("commands") == 0) & (blocks >= STREAM_BLOCKS)
    run = F.format_string("intra_response_character_run:character='%s':minimum_run=2048", F.regexp_extract(content, RUN_PATTERN, 1))
    counts = F.format_string("intra_response_unparsed_action_stream:chars=%d:action_blocks=%d", F.length(content), blocks.cast("int"))
    why = F.when(F.length(content) >= LONG_RESPONSE, F.when(content.rlike(RUN_PATTERN), run).when(stream, counts).otherwise(repeats))
    return steps.select(
        key, "step", collapse_counters(content).alias("response"), "commands",
        F.transform("commands", collapse_counters).alias("normalized"), "format_error", "terminal", why.alias("repetition"),
    )


def _recovered(at: Column, run: int = 4) -> Column:
    no = F.lit(False)
    return F.coalesce(F.col(f"s{run}") >= at + run, no) | F.coalesce(F.col("c") > at, no)


def _with_runs(steps: DataFrame, key: str) -> DataFrame:
    """Steps with lengths of the runs that end at them, and the three numbers of their trajectory."""
    w, whole = Window.partitionBy(key).orderBy("step"), Window.partitionBy(key)

    def run(holds: Column) -> Column:
        return F.col("step") - F.coalesce(F.max(F.when(~holds, F.col("step"))).over(w), F.lit(-1))

    acts = F.size("commands") > 0
    values = {"r": F.when(F.col("response") != "", F.col("response")), "c": F.when(F.size("normalized") > 0, F.to_json("normalized"))}
    same = {f"{v}{p}": F.coalesce(F.col(f"v{v}") == F.lag(f"v{v}", p).over(w), F.lit(False)) for v in values for p in (1, *PERIODS)}
    rows = steps.withColumns({f"v{v}": c for v, c in values.items()} | {"t": F.max(F.when(F.col("terminal"), F.col("step"))).over(whole)})
    rows = rows.withColumns({f"m{k}": c for k, c in same.items()}).drop("vr", "vc", "response", "normalized")
    rows = rows.withColumns({
        "clean": run(acts & ~F.col("format_error") & F.col("repetition").isNull()), "errors": run(F.col("format_error")),
        **{f"n{k}": run(F.col(f"m{k}")) for k in same},
    })
    return rows.withColumns({
        **{f"s{n}": F.max(F.when(F.col("clean") >= n, F.col("step"))).over(whole) for n in (3, 4)},
        "c": F.max(F.when(acts & (F.col("step") < F.col("t")), F.col("step"))).over(whole),
        **{f"x{k}": F.coalesce(F.lead(f"n{k}").over(w), F.lit(0)) for k in same},
    })


def collapse_reason(
    messages: DataFrame, key: str, order: str, role: str, content: str, commands: str, limit: int | None = None
) -> DataFrame:
    """(key, reason): one row per trajectory that has an assistant turn; the first rule that holds, else null.

    Rules in order: format errors, a response that repeats itself, runs of equal responses or commands, repeated
    checkouts, loops of two to four steps. ``limit`` cuts each trajectory after so many assistant turns and then uses
    the rules for cut trajectories.
    """
    rows = _with_runs(cycles(messages, key, order, role, content, commands, limit), key)
    step, open_end = F.col("step"), ~_recovered(F.col("step"))
    paths = F.filter(F.transform("commands", lambda c: F.regexp_extract(c, CHECKOUT, 1)), lambda p: p != "")

    def loop(k: str, period: int) -> Column:
        # a whole run ends where the next step doesn't go on; the earliest one that stays open counts
        n = F.col(f"n{k}")
        return F.min(F.when((n >= 3 * period) & (F.col(f"x{k}") == 0) & open_end, F.struct((step - n).alias("first"), n.alias("n"))))["n"]

    facts = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("steps"), *(F.first(c).alias(c) for c in ("s3", "s4", "c")),
        F.count_if("format_error").alias("errors"), F.max("errors").alias("streak"), F.max(F.when(F.col("format_error"), step)).alias("error_at"),
        F.max(F.when(F.col("repetition").isNotNull(), step)).alias("own_at"), F.max_by("repetition", F.when(F.col("repetition").isNotNull(), step)).alias("own"),
        *(F.max(F.struct(F.col(f"n{v}1").alias("n"), (-step).alias("e"))).alias(f"run_{v}") for v in "rc"),
        F.array_sort(F.flatten(F.collect_list(F.transform(paths, lambda p, i: F.struct(step.alias("step"), i.alias("i"), p.alias("path")))))).alias("outs"),
        *(loop(f"{v}{p}", p).alias(f"loop_{v}{p}") for v in "rc" for p in PERIODS),
    )

    n, streak = F.col("errors"), F.col("streak")
    if limit is None:
        parser = (n >= 30) | (streak >= 15) | (~_recovered(F.col("error_at")) & ((streak >= 7) | (n >= 10)))
    else:
        parser = ~_recovered(F.col("error_at"), 3) & ((streak >= 8) | ((n >= 10) & (n / F.col("steps") >= 0.3)))
    reasons = [
        F.when(parser & (n > 0), F.format_string("format_error_parser_loop:total=%d:streak=%d", n, streak)),
        F.when(F.col("own").isNotNull() & ~_recovered(F.col("own_at")), F.col("own")),
    ]
    for v, name in (("r", "response"), ("c", "command")):
        length, last = F.col(f"run_{v}.n") + 1, -F.col(f"run_{v}.e")
        reasons.append(F.when((length >= RUN) & ~_recovered(last), F.format_string(f"repeated_counter_normalized_{name}:%d", length)))
    reasons.append(_checkouts(F.col("outs"), limit is None))
    for v, label in (("r", "periodic_assistant_response_loop"), ("c", "periodic_tool_command_loop")):
        for p in PERIODS:
            reasons.append(F.format_string(f"{label}:period={p}:length=%d", F.col(f"loop_{v}{p}") + p))
            reasons[-1] = F.when(F.col(f"loop_{v}{p}").isNotNull(), reasons[-1])
    return facts.select(key, F.coalesce(*reasons).alias("reason"))


def _checkouts(outs: Column, whole: bool) -> Column:
    """Many checkouts: of one path in a whole trajectory (of equals, that seen first), of all paths in a cut one."""
    paths = F.array_distinct(F.transform(outs, lambda o: o["path"]))
    if not whole:
        last = F.element_at(outs, -1)["step"]
        reason = F.format_string("repeated_edit_revert_cycle:paths=%d:checkouts=%d", F.size(paths), F.size(outs))
        return F.when(F.size(outs) >= 12, F.when(~_recovered(last), reason))

    def one(path: Column, i: Column) -> Column:
        mine = F.filter(outs, lambda o: o["path"] == path)
        return F.struct(F.size(mine).alias("n"), (-i).alias("i"), path.alias("path"), F.element_at(mine, -1)["step"].alias("last"))

    top = F.when(F.size(outs) >= 20, F.array_max(F.transform(paths, one)))
    return let(top, lambda t: F.when(
        (t["n"] >= 20) & ~_recovered(t["last"]), F.format_string("repeated_edit_revert_cycle:path=%s:checkouts=%d", t["path"], t["n"])))
