"""Scores of rubrics over the nodes of a group, as long tables (group, node, rubric, raw score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a raw score of 1 to 5 counts, the detector's threshold, and the rewards of a wrong format and of a judge's error.
MAPPING = (1.0, 2.0, 4.0, 6.0, 8.0)
DETECTOR_THRESHOLD = 0.18
FORMAT_ERROR_REWARD = -1.0
JUDGE_ERROR_REWARD = -0.2
EPSILON = 1e-12


def _sign(direction: Column) -> Column:
    return F.when(direction == "negative", -1.0).otherwise(1.0)


def distinct_rubrics(rubrics: DataFrame, group: str = "g", rubric: str = "rubric", pos: str = "pos") -> DataFrame:
    """The first of each rubric of a group by position, in one aggregation."""
    rest = [c for c in rubrics.columns if c not in (group, rubric)]
    first = rubrics.groupBy(group, rubric).agg(F.min(F.struct(pos, *(c for c in rest if c != pos))).alias("_r"))
    return first.select(group, rubric, *(F.col(f"_r.{c}").alias(c) for c in rest))


def weight_shares(rubrics: DataFrame, group: str = "g") -> DataFrame:
    """``rubrics`` with ``share`` of |weight| in its group; a weight of zero or that isn't finite raises."""
    size = F.abs(F.col("weight").cast("double"))
    bad = size.isNull() | F.isnan(size) | (size == float("inf")) | (size <= 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid weight of rubric "), F.col("rubric").cast("string")))).otherwise(size)
    out = rubrics.withColumn("_w", checked)
    return out.withColumn("share", F.col("_w") / F.sum("_w").over(Window.partitionBy(group))).drop("_w")


def weighted_scores(scores: DataFrame, rubrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((g, node, signed, reward), (g, weighted_range)) of scores (g, node, rubric, raw) and rubrics (g, rubric, direction, weight).

    signed: mean of mapped scores by weight, negative ones subtracted; reward:
    0.5 + signed / 16; weighted_range: mean by weight of each rubric's spread over
    the nodes, as a share of the scale. A node without one of its group's
    rubrics, or a raw score outside 1 to 5, raises.
    """
    raw = F.col("raw").cast("int")
    mapped = F.when(raw.between(1, 5), F.element_at(F.array(*map(F.lit, MAPPING)), raw)).otherwise(
        F.raise_error(F.concat(F.lit("invalid raw judge score "), F.coalesce(raw.cast("string"), F.lit("null"))))
    )
    each = scores.join(rubrics, ["g", "rubric"]).select("g", "node", "rubric", "direction", "weight", mapped.alias("m"))
    total = rubrics.groupBy("g").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("rubrics"))
    nodes = each.groupBy("g", "node").agg(F.sum(F.col("m") * F.col("weight") * _sign(F.col("direction"))).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = F.when(F.col("n") == F.col("rubrics"), F.col("s")).otherwise(F.raise_error(F.lit("missing judge score")))
    nodes = nodes.join(total, "g").select("g", "node", (whole / F.col("total")).alias("signed"))
    # Spreads are taken where the scores lie, so one row of a rubric meets its weight.
    fits = F.coalesce(raw.between(1, 5), F.lit(False))
    known = F.when(fits, F.element_at(F.array(*map(F.lit, MAPPING)), raw))
    spans = scores.groupBy("g", "rubric").agg((F.max(known) - F.min(known)).alias("span"), F.count_if(~fits).alias("bad"))
    whole = F.when(F.col("bad") == 0, F.col("span")).otherwise(F.raise_error(F.lit("invalid raw judge score")))
    spread = spans.join(rubrics.groupBy("g", "rubric").agg(F.max("weight").alias("weight")), ["g", "rubric"]).select("g", whole.alias("span"), "weight")
    span = MAPPING[-1] - MAPPING[0]
    ranges = spread.groupBy("g").agg((F.sum(F.col("span") / span * F.col("weight")) / F.sum("weight")).alias("weighted_range"))
    return nodes.withColumn("reward", 0.5 + F.col("signed") / (2 * MAPPING[-1])), ranges


def predicts_variance(feature: Column, threshold: float = DETECTOR_THRESHOLD, direction: str = "ge") -> Column:
    compare = {"ge": feature >= threshold, "gt": feature > threshold, "le": feature <= threshold}
    if direction not in compare:
        raise ValueError("unsupported numeric variance direction")
    return compare[direction]


def predicted_zero(abstain: Column, feature: Column, threshold: float = DETECTOR_THRESHOLD, direction: str = "ge") -> Column:
    """The judge abstains, or the detector sees no variance."""
    return abstain | ~predicts_variance(feature, threshold, direction)


def normalized_score(raw: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw.cast("double") - 1) / 4))


def score_record(raw: Column, weight: Column, direction: Column) -> Column:
    """struct(score_raw, score_normalized, weight, weighted_score)."""
    score, size = normalized_score(raw), F.abs(weight.cast("double"))
    return F.struct(raw.cast("int").alias("score_raw"), score.alias("score_normalized"), size.alias("weight"), (size * score * _sign(direction)).alias("weighted_score"))


def average_scores(nodes: DataFrame, scores: DataFrame, rubrics: DataFrame, relative: bool = False) -> DataFrame:
    """(g, node, reward): normalised scores (g, node, rubric, score) by shares of |weight|; a missing score is 0.

    Negative rubrics subtract; ``relative`` to the parent they give half of what
    is left to 1. Groups without rubrics give 0, relative 0.5.
    """
    shares = weight_shares(rubrics).select("g", "rubric", "direction", "share")
    cells = nodes.select("g", "node").join(shares, "g", "left").join(scores.select("g", "node", "rubric", "score"), ["g", "node", "rubric"], "left")
    score, negative = F.coalesce("score", F.lit(0.0)), F.col("direction") == "negative"
    part = F.when(negative, 0.5 * (1 - score)).otherwise(score) if relative else score * _sign(F.col("direction"))
    return cells.groupBy("g", "node").agg(F.coalesce(F.sum(F.col("share") * part), F.lit(0.5 if relative else 0.0)).alias("reward"))


def _gaps(a: Column, b: Column, opposite: bool) -> Column:
    """Mean |da - db| over all pairs of places; ``opposite``: |da + db|."""
    n = F.size(a)
    other = F.transform(b, lambda y: -y) if opposite else b
    both = F.zip_with(a, other, lambda x, y: x - y)  # (ai - aj) - (bi - bj) = (ai - bi) - (aj - bj)
    total = F.aggregate(both, F.lit(0.0), lambda s, d: s + F.aggregate(both, F.lit(0.0), lambda t, e: t + F.abs(d - e)))
    return total / 2 / (n * (n - 1) / 2)


def gap_correlation(a: Column, b: Column) -> Column:
    """1 - mean |da - db| over the differences of all pairs; under two places 0."""
    return F.when(F.size(a) < 2, 0.0).otherwise(1 - _gaps(a, b, False))


def gap_redundancy(a: Column, b: Column) -> Column:
    """As ``gap_correlation``, the reversed order counting as well."""
    return F.when(F.size(a) < 2, 0.0).otherwise(1 - F.least(_gaps(a, b, False), _gaps(a, b, True)))


def redundancy_rewards(vectors: DataFrame, group: str = "g", pos: str = "pos", vector: str = "vector") -> DataFrame:
    """(group, pos, redundancy): 1 - the greatest redundancy against earlier vectors of the group; the first gets 1."""
    later = vectors.select(group, pos, F.col(vector).alias("a"))
    earlier = vectors.select(group, F.col(pos).alias("_p"), F.col(vector).alias("b"))
    pairs = later.join(earlier, group).where(F.col("_p") < F.col(pos))
    worst = pairs.groupBy(group, pos).agg(F.max(gap_redundancy(F.col("a"), F.col("b"))).alias("_m"))
    return later.join(worst, [group, pos], "left").select(group, pos, (1 - F.coalesce("_m", F.lit(0.0))).alias("redundancy"))


def rubric_evaluation(vectors: DataFrame, errors: DataFrame, with_variance: bool = True) -> DataFrame:
    """(g, pos, variance, redundancy, judge_error, reward) of each rubric's scores over the nodes.

    vectors: (g, pos, vector array<double>); errors: (g, pos), one row a failed
    call. Variance is that of the population.
    """
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    square = F.transform("vector", lambda x: x * x)
    spread = F.when(F.size("vector") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), mean(square) - mean(F.col("vector")) * mean(F.col("vector"))))
    failed = errors.groupBy("g", "pos").agg((F.count(F.lit(1)) * JUDGE_ERROR_REWARD).alias("judge_error"))
    out = vectors.select("g", "pos", spread.alias("variance")).join(redundancy_rewards(vectors), ["g", "pos"]).join(failed, ["g", "pos"], "left")
    out = out.withColumn("judge_error", F.coalesce("judge_error", F.lit(0.0)))
    share = F.col("variance") if with_variance else F.lit(0.0)
    return out.withColumn("reward", share + F.col("redundancy") + F.col("judge_error"))


def progress_reward(labels: Column, predictions: Column) -> Column:
    """Mean of prediction - 0.5 where the label is above a half and of its opposite where it is below; without any 0."""
    paired = F.zip_with(labels, predictions, lambda t, p: F.when(t > 0.5, p - 0.5).when(t < 0.5, 0.5 - p))
    known = F.array_compact(paired)
    unequal = F.raise_error(F.lit("labels and predictions must have the same length")).cast("double")
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0)
    return F.when(F.size(labels) != F.size(predictions), unequal).otherwise(mean)


def mixed_reward(variance: Column, redundancy: Column, judge_error: Column, alpha: float, gamma: float, theta: float) -> Column:
    total = (alpha + gamma + theta) or 1.0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (alpha * zero(variance) + gamma * zero(redundancy) + theta * zero(judge_error)) / total


def turn_rewards(turns: Column, rewards: Column, format_errors: Column) -> Column:
    """Reward of each assistant turn: the constant where its format was wrong (turns count from 1), else the next rubric's, else 0."""
    wrong = lambda k: F.size(F.filter(format_errors, lambda e: e <= k))
    numbers = F.when(turns > 0, F.sequence(F.lit(1), turns)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.when(F.array_contains(format_errors, k), FORMAT_ERROR_REWARD).otherwise(
        F.coalesce(F.get(rewards, k - wrong(k) - 1), F.lit(0.0))))


def collapse_overrides(rows: DataFrame, group: str, reward: str, collapsed: Column, margin: float) -> DataFrame:
    """``rows`` where collapsed ones get their group's least reward less ``margin``; ``overridden`` tells them."""
    least = F.min(reward).over(Window.partitionBy(group))
    hit = F.coalesce(collapsed, F.lit(False))
    return rows.withColumn("overridden", hit).withColumn(reward, F.when(hit, least - margin).otherwise(F.col(reward)))


def metric_deltas(candidate: dict[str, Column], baseline: dict[str, Column]) -> dict[str, Column]:
    return {k: candidate[k].cast("double") - baseline[k].cast("double") for k in candidate}


def improved(deltas: dict[str, Column], epsilon: float = EPSILON) -> Column:
    """Any metric grew."""
    return F.greatest(*deltas.values(), F.lit(float("-inf"))) > epsilon


def tie_break(scores: DataFrame, group: str = "g", node: str = "node", score: str = "score", secondary: str = "secondary") -> DataFrame:
    """``scores`` with ``adjusted``: nodes tied at the top are told apart by up to a millionth, as their secondary scores lie between least and greatest.

    Without a tie or without spread the score stays.
    """
    w = Window.partitionBy(group)
    top = F.max(score).over(w)
    close = F.greatest(F.lit(EPSILON), F.lit(1e-9) * F.greatest(F.abs(F.col(score)), F.abs(top)))
    out = scores.withColumn("_top", top).withColumn("_tied", F.abs(F.col(score) - top) <= close)
    among = F.when(F.col("_tied"), F.col(secondary))
    low, high = F.min(among).over(w), F.max(among).over(w)
    several = F.sum(F.col("_tied").cast("int")).over(w) > 1
    moved = F.col("_top") + 1e-6 * (F.col(secondary) - low) / (high - low)
    return out.withColumn("adjusted", F.when(F.col("_tied") & several & (high > low), moved).otherwise(F.col(score))).drop("_top", "_tied")


def first_fitting(views: DataFrame, key: str, order: str, size: str, room: Column) -> DataFrame:
    """(key, order): the first view, by order, whose size fits; null where none does."""
    return views.groupBy(key).agg(F.min(F.when(F.col(size) <= room, F.col(order))).alias(order))


def best_of(rows: DataFrame, group: str, score: str, pos: str, count: Column) -> DataFrame:
    """The ``count`` best rows of each group, stable by position."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), pos))
    return rows.withColumn("_k", rank).where(F.col("_k") <= count).drop("_k")


def weighted_sample(rows: DataFrame, group: str, score: str, key: str, count: Column, seed: int = 0) -> DataFrame:
    """``count`` rows of each group without replacement, likelier with a higher score.

    Weights are scores between the group's least (0) and greatest (1); keys
    ln(u) / weight are ranked, u being a hash of the row's key and the seed, so
    the draw doesn't depend on partitions. Equal scores are drawn evenly.
    """
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)
    drawn = F.when(weight > 0, F.ln(u) / weight).otherwise(F.lit(float("-inf")))
    ranked = rows.withColumn("_d", drawn).withColumn("_k", F.row_number().over(w.orderBy(F.desc("_d"), key)))
    return ranked.where((F.col("_k") <= count) & (F.col("_d") > float("-inf"))).drop("_d", "_k")


def beam_branches(rows: DataFrame, group: str, score: str, pos: str, regressed: str, width: int, limit: int) -> DataFrame:
    """Branches kept for the next round: the best that didn't regress, topped up with the best that did.

    As many of the former as ``limit`` allows, rounded down to a multiple of the
    beam's width once there are that many. Groups without any keep none.
    """
    if limit <= 0:
        return rows.limit(0)
    rank = F.row_number().over(Window.partitionBy(group, regressed).orderBy(F.desc(score), pos))
    good = F.sum((~F.col(regressed)).cast("int")).over(Window.partitionBy(group))
    most = F.least(F.lit(limit), F.col("_good"))
    keep = F.when(most >= width, most - most % width).otherwise(most)
    top_up = F.greatest(F.lit(0), F.lit(min(width, limit)) - keep)
    out = rows.withColumn("_k", rank).withColumn("_good", good).where("_good > 0")
    return out.where(F.col("_k") <= F.when(F.col(regressed), top_up).otherwise(keep)).drop("_k", "_good")


def judge_score(score: Column, kind: Column) -> Column:
    """1 to 5 of what a judge wrote: a whole number, or a text n, n.0 or n/5; else null. ``kind``: bool, int, float or str."""
    text = F.trim(score)
    written = F.regexp_extract(text, r"^([1-5])(?:\.0)?(?:\s*/\s*5)?$", 1)
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("int"))
    value = F.when(kind == "str", F.when(written != "", written.cast("int"))).when(kind.isin("int", "float"), whole)
    return F.when(value.between(1, 5), value)
