"""Search rounds as contexts: ground-truth rewards, gates, checks, selections and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reward of a solved task and the constants of the ground-truth reward.
SOLVED = 2.0
EMPTY_REWARD, ERROR_REWARD = -0.2, -0.5


def is_solved(reward: Column, epsilon: float = 1e-9) -> Column:
    """Close to 2, by 1e-9 of the greater value or by ``epsilon``."""
    return F.abs(reward - SOLVED) <= F.greatest(F.lit(epsilon), F.lit(1e-9) * F.greatest(F.abs(reward), F.lit(SOLVED)))


def has_variance(node_ids: Column, rewards: Column) -> Column:
    """At least two of the nodes have a reward, one of them is solved and one isn't."""
    values = F.array_compact(F.transform(node_ids, lambda n: F.try_element_at(rewards, n)))
    return (F.size(values) >= 2) & F.exists(values, lambda v: is_solved(v)) & F.exists(values, lambda v: ~is_solved(v))


def context_errors(node_ids: Column, rewards: Column, continuations: Column) -> Column:
    """Array of what is wrong with a context; a null column is a missing field."""
    none = F.array().cast("array<string>")
    nodes, known, seen = F.coalesce(node_ids, none), F.coalesce(F.map_keys(rewards), none), F.coalesce(continuations, none)
    found = [
        F.when(node_ids.isNull(), "missing node_ids"), F.when(rewards.isNull(), "missing gt_rewards"),
        F.when((F.size(nodes) < 2) | (F.size(F.array_distinct(nodes)) != F.size(nodes)), "node_ids must be unique and contain >=2 nodes"),
        F.when(F.size(F.array_except(nodes, known)) > 0, "gt_rewards do not cover every node"),
        F.when(F.size(F.array_except(nodes, seen)) > 0, "visible continuations do not cover every node"),
    ]
    return F.array_compact(F.array(*found))


def load_contexts(contexts: DataFrame, key: str = "context_id", require_variance: bool = True) -> DataFrame:
    """Valid contexts (node_ids, gt_rewards, continuations, ...), one of equal rows; an invalid or a conflicting one raises."""
    errors = context_errors(F.col("node_ids"), F.col("gt_rewards"), F.col("continuations"))
    told = F.concat_ws(": ", F.col(key).cast("string"), F.array_join(errors, "; "))
    varies = has_variance(F.col("node_ids"), F.col("gt_rewards"))
    # The check is part of the filter, so that no row is dropped before it is checked.
    kept = F.when(F.size(errors) > 0, F.raise_error(told).cast("boolean")).otherwise(varies if require_variance else F.lit(True))
    rows = contexts.where(kept).withColumn("has_variance", varies)
    # Maps are no keys: rows are compared by their JSON texts, whose map entries are sorted first.
    flat = [F.to_json(F.array_sort(F.map_entries(c))) if t.startswith("map") else F.col(c).cast("string") for c, t in rows.dtypes]
    one = rows.withColumn("_text", F.to_json(F.array(*flat))).groupBy(key).agg(
        F.min("_text").alias("_low"), F.max("_text").alias("_high"), F.first(F.struct(*rows.columns)).alias("_row"))
    clash = F.raise_error(F.concat(F.lit("conflicting duplicate context: "), F.col(key).cast("string")))
    return one.where(F.when(F.col("_low") == F.col("_high"), True).otherwise(clash.cast("boolean"))).select("_row.*")


def variance_population(contexts: DataFrame) -> DataFrame:
    """Contexts whose rewards vary, by instance, round and id."""
    return contexts.where(has_variance(F.col("node_ids"), F.col("gt_rewards"))).orderBy("instance_id", "round_index", "context_id")


def selection_error(selected: Column, success: Column, rewards: Column) -> Column:
    """The node selected then failed; missing evidence, a node without reward or a contradiction raises."""
    node = F.nullif(selected, F.lit(""))
    reward = F.try_element_at(rewards, node)
    derived = is_solved(reward)
    fail = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    return (
        F.when(node.isNull() & success.isNull(), fail("missing historical selection evidence")).when(node.isNull(), ~success)
        .when(reward.isNull(), fail("selected node lacks terminal GT"))
        .when(success.isNotNull() & (success != derived), fail("inconsistent historical selection outcome")).otherwise(~derived)
    )


def scopes(has_siblings: Column, has_pc: Column) -> Column:
    """Scopes for which there is evidence, siblings first."""
    return F.array_compact(F.array(F.when(has_siblings, "siblings"), F.when(has_pc, "pc")))


def selected_sample(samples: DataFrame, round_: str = "round", by_index: bool = True) -> DataFrame:
    """(round, sample_index) of samples (round, sample_index, selected, round_index): the one flagged, else the one the round names, else an only one.

    Null where none of these holds; several flagged, or several of the named
    index, raise. ``by_index`` is off for samples relative to the parent.
    """
    flag, named = F.coalesce("selected", F.lit(False)), F.coalesce(F.col("sample_index") == F.col("round_index"), F.lit(False))
    n = samples.groupBy(round_).agg(
        F.count_if(flag).alias("flags"), F.max(F.when(flag, F.col("sample_index"))).alias("flagged"), F.count_if(named).alias("names"),
        F.max(F.when(named, F.col("sample_index"))).alias("named"), F.count(F.lit(1)).alias("n"), F.max("sample_index").alias("last"),
    )
    several = lambda text: F.raise_error(F.lit(text)).cast("bigint")
    found = F.when(F.col("flags") > 1, several("multiple selected samples")).when(F.col("flags") == 1, F.col("flagged"))
    if by_index:
        found = found.when(F.col("names") > 1, several("selected_sample_index matches multiple samples")).when(F.col("names") == 1, F.col("named"))
    return n.select(round_, found.when(F.col("n") == 1, F.col("last")).alias("sample_index"))


def ground_truth_rewards(records: DataFrame, judged: DataFrame) -> DataFrame:
    """(sample, node, reward): what the rubrics' records (sample, rubric, node, reward) say, else the nodes' judge files (sample, node, reward).

    Records of one sample must agree node by node and cover the same nodes, or
    it raises. Judge rows without a reward are left out.
    """
    told = records.where("reward is not null")
    per = told.groupBy("sample").agg(F.count_distinct("rubric").alias("rubrics"))
    cells = told.groupBy("sample", "node").agg(F.min("reward").alias("reward"), F.max("reward").alias("most"), F.count_distinct("rubric").alias("n"))
    same = (F.col("reward") == F.col("most")) & (F.col("n") == F.col("rubrics"))
    checked = F.when(same, F.col("reward")).otherwise(F.raise_error(F.lit("ground-truth rewards disagree across rubrics")).cast("double"))
    first = cells.join(per, "sample").select("sample", "node", checked.alias("reward"))
    rest = judged.where("reward is not null").join(per, "sample", "left_anti").select("sample", "node", "reward")
    return first.unionByName(rest)


def context_of_round(nodes: DataFrame, round_: str = "round") -> DataFrame:
    """One context of each round of nodes (round, node, pos, score, reward, chosen): ordered ids, maps, selection and its success.

    The node that the asynchronous evaluation chose is selected, else that of
    the greatest (score, id). A node without reward or score, or a round of
    fewer than two nodes, raises.
    """
    cell = F.struct("pos", "node", "score", "reward")
    whole = F.count_if(F.col("score").isNull() | F.col("reward").isNull()) == 0
    out = nodes.groupBy(round_).agg(
        F.array_sort(F.collect_list(cell)).alias("cells"), whole.alias("whole"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.coalesce("chosen", F.lit(False)), F.col("node"))).alias("told"),
        F.max_by("node", F.struct(F.coalesce("score", F.lit(0.0)), "node")).alias("best"),
    )
    fine = F.when(F.col("whole") & (F.col("n") >= 2), F.col("cells")).otherwise(F.raise_error(F.lit("incomplete node coverage")).cast(out.schema["cells"].dataType))
    entry = lambda name: F.map_from_entries(F.transform("cells", lambda c: F.struct(c["node"], c[name])))
    out = out.withColumn("cells", fine).withColumn("selected_node_id", F.coalesce("told", "best"))
    out = out.select(
        round_, F.transform("cells", lambda c: c["node"]).alias("node_ids"), entry("score").alias("judge_scores"), entry("reward").alias("gt_rewards"),
        "selected_node_id", F.when(F.col("told").isNotNull(), "async_terminal_eval").otherwise("max_siblings_score_fallback").alias("selection_source"),
    )
    return out.withColumn("selection_success", is_solved(F.element_at("gt_rewards", F.col("selected_node_id"))))


def evaluation_reward(
    status: Column, passed: Column, failed: Column, fail_to_pass: Column, pass_to_pass: Column, infrastructure_error: Column,
    kind: str = "joint", alpha: float = 1.0, all_pass: float = 2.0, fallback_penalty: float = 1.0, no_action_penalty: float = 0.0,
) -> Column:
    """The ground-truth reward of one evaluation; tests are arrays, counted once each, blanks left out.

    resolved and unresolved: by ``kind`` hard, soft (share of visible tests),
    joint (share of broken tests mended - alpha times share of others broken) or
    f2p_only; a resolved one counts ``all_pass`` times. empty: -0.2; error: -0.5 if
    the infrastructure failed, else 0. Other statuses raise.
    """
    if kind not in ("hard", "soft", "joint", "f2p_only"):
        raise ValueError(f"unsupported reward kind {kind!r}")
    none = F.array().cast("array<string>")
    names = lambda tests: F.array_distinct(F.filter(F.coalesce(tests, none), lambda t: F.coalesce(t, F.lit("")) != ""))
    resolved = (status == "resolved").cast("double")

    def score(x: Column) -> Column:
        rate = lambda of: F.coalesce(F.try_divide(F.size(F.array_intersect(x["p"], of)), F.size(of)), F.lit(1.0))
        if kind == "hard":
            found = resolved
        elif kind == "soft":
            found = F.coalesce(F.try_divide(F.size(x["p"]), F.size(F.array_union(x["p"], x["f"]))), resolved)
        else:
            mended = rate(x["f2p"]) - alpha * (1 - rate(x["p2p"])) if kind == "joint" else rate(x["f2p"])
            found = F.when(F.size(x["f2p"]) + F.size(x["p2p"]) == 0, resolved).otherwise(mended)
        return found * F.when(status == "resolved", all_pass).otherwise(1.0) * fallback_penalty + no_action_penalty

    parts = F.struct(names(passed).alias("p"), names(failed).alias("f"), names(fail_to_pass).alias("f2p"), names(pass_to_pass).alias("p2p"))
    known = F.transform(F.array(parts), score)[0]
    error = F.when(F.coalesce(infrastructure_error, F.lit(False)), ERROR_REWARD).otherwise(0.0)
    unknown = F.raise_error(F.concat(F.lit("unknown evaluation status: "), F.coalesce(status, F.lit("null")))).cast("double")
    return F.when(status == "empty", EMPTY_REWARD).when(status == "error", error).when(status.isin("resolved", "unresolved"), known).otherwise(unknown)


def report_tests(groups: DataFrame, key: str) -> DataFrame:
    """(key, passed, failed) of report rows (key, success array, failure array), one a test group."""
    flat = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(c)), lambda t: t != "")))
    return groups.groupBy(key).agg(flat("success").alias("passed"), flat("failure").alias("failed"))


def own_tests(rows: DataFrame, group: str, branch: str, test: str) -> DataFrame:
    """(group, branch, tests): tests that a branch passed but not every evaluated branch of its group did, sorted.

    rows: one a passed test; a row with a null test is a branch evaluated without any.
    """
    branches = rows.groupBy(group).agg(F.count_distinct(branch).alias("n"))
    held = rows.where(F.col(test).isNotNull() & (F.col(test) != "")).groupBy(group, test).agg(F.count_distinct(branch).alias("held"))
    rare = held.join(branches, group).where("held < n").select(group, test)
    mine = rows.join(rare, [group, test], "left_semi").groupBy(group, branch).agg(F.array_sort(F.collect_set(test)).alias("tests"))
    every = rows.select(group, branch).distinct()
    return every.join(mine, [group, branch], "left").withColumn("tests", F.coalesce("tests", F.array().cast("array<string>")))
