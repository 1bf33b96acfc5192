"""Robust scores of rubric weights over resampled panels: one row per weight vector, all by joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_weights(deltas: DataFrame, nominal: DataFrame, weights: DataFrame, base: DataFrame, score_range: int) -> DataFrame:
    """(weight_id, robust_correct, cvar10_correct, nominal_correct, signed_margin, active, min_max_ratio, l1).

    deltas: (draw, pair, rubric, value); nominal: (pair, rubric, value, denominator), where value and the denominator of
    a pair are signed score differences and their scale; weights: (weight_id, rubric, weight); base: (rubric, weight).
    The worst tenth of the draws (rounded up) makes ``cvar10_correct``. ``rank_weights`` orders the result. The weights
    are broadcast; deltas and nominal rows that lie by pair stay where they are.
    """
    w = weights.select("weight_id", "rubric", "weight")
    margins = deltas.join(F.broadcast(w), "rubric").groupBy("weight_id", "draw", "pair").agg(F.sum(F.col("value") * F.col("weight")).alias("m"))
    draws = margins.groupBy("weight_id", "draw").agg(F.count_if(F.col("m") > 0).alias("correct"))
    worst = Window.partitionBy("weight_id").orderBy("correct", "draw")
    draws = draws.withColumn("_r", F.row_number().over(worst)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("weight_id")))
    tail = F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.1))
    robust = draws.groupBy("weight_id").agg(F.sum("correct").alias("robust_correct"), F.sum(F.when(tail, F.col("correct"))).alias("cvar10_correct"))

    totals = w.groupBy("weight_id").agg(
        F.sum("weight").alias("_total"), F.count_if(F.col("weight") > 0).alias("active"),
        (F.min(F.when(F.col("weight") > 0, F.col("weight"))) / F.max("weight")).alias("min_max_ratio"),
    )
    by_pair = nominal.join(F.broadcast(w), "rubric").groupBy("weight_id", "pair").agg(
        F.sum(F.col("value") * F.col("weight")).alias("m"), F.first("denominator").alias("_d"),
    )
    plain = by_pair.groupBy("weight_id").agg(F.count_if(F.col("m") > 0).alias("nominal_correct"), F.sum(F.col("m") / F.col("_d")).alias("_margin"))

    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("weight_id"))
    ids = w.select("weight_id").distinct()
    base_sum = base.agg(F.sum("weight").alias("_bs"))
    # one row is joined to the base's few rubrics, and those to the ids of the weights
    own = w.select("weight_id", "rubric", share.alias("_x"))
    others = base.join(F.broadcast(base_sum)).select("rubric", (F.col("weight") / F.col("_bs")).alias("_b"))
    both = own.join(others, "rubric", "left")
    # rubrics of the base that a vector doesn't name count with their whole share
    named = both.groupBy("weight_id").agg(F.sum(F.abs(F.col("_x") - F.coalesce("_b", F.lit(0.0)))).alias("_l"), F.sum(F.coalesce("_b", F.lit(0.0))).alias("_seen"))
    l1 = named.select("weight_id", (F.col("_l") + 1.0 - F.col("_seen")).alias("l1"))

    out = ids.join(robust, "weight_id", "left").join(plain, "weight_id", "left").join(totals, "weight_id").join(l1, "weight_id")
    zero = F.lit(0)
    return out.select(
        "weight_id", F.coalesce("robust_correct", zero).alias("robust_correct"), F.coalesce("cvar10_correct", zero).alias("cvar10_correct"),
        F.coalesce("nominal_correct", zero).alias("nominal_correct"),
        F.coalesce(F.col("_margin") / (F.col("_total") * score_range), F.lit(0.0)).alias("signed_margin"), "active", "min_max_ratio", "l1",
    )


def rank_weights(scores: DataFrame, group: str | None = None) -> DataFrame:
    """``scores`` with ``rank``: more correct in all draws, in the worst, nominally; then margin, fewer active, ratio, nearness."""
    order = [F.desc("robust_correct"), F.desc("cvar10_correct"), F.desc("nominal_correct"), F.desc("signed_margin"),
             F.asc("active"), F.desc("min_max_ratio"), F.asc("l1"), F.asc("weight_id")]
    keys = [group] if group else [F.lit(0)]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def materialize_weights(rubrics: DataFrame, tenths: DataFrame, key: str = "rubric") -> DataFrame:
    """Rubrics with positive tenths, their weight as tenths / 10; those without or with none are removed."""
    kept = tenths.where(F.col("tenths") > 0).select(key, (F.col("tenths") / 10).alias("weight"))
    return rubrics.drop("weight").join(kept, key)


#: The grid of weights in tenths, and how many are active at most.
LEAST_TENTHS, MOST_TENTHS, MOST_ACTIVE = 5, 50, 6


def grid_weights(rows: DataFrame, group: str, pos: str, value: str, active: int = MOST_ACTIVE) -> DataFrame:
    """(group, pos, tenths): each group's weights on the grid of 0 and 5 to 50 tenths.

    Negative weights are 0; the ``active`` greatest stay, earlier ones on ties; a
    group without any has 1 at its first place; a group above 50 is scaled to
    50; halves round to even.
    """
    w = Window.partitionBy(group)
    x = F.coalesce(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    out = rows.select(group, pos, x.alias("_x")).withColumn("_k", F.row_number().over(w.orderBy(F.desc("_x"), pos)))
    kept = F.when(F.col("_k") <= active, F.col("_x")).otherwise(0.0)
    top, first = F.max("_x").over(w), F.min(pos).over(w)
    some = F.when(top > 0, kept).when(F.col(pos) == first, 1.0).otherwise(0.0)
    scaled = F.when(top > MOST_TENTHS, some * (float(MOST_TENTHS) / top)).otherwise(some)
    tenths = F.bround(scaled, 0).cast("int")
    return out.select(group, pos, F.when(tenths > 0, F.least(F.greatest(tenths, F.lit(LEAST_TENTHS)), F.lit(MOST_TENTHS))).otherwise(0).alias("tenths"))


def distinct_vectors(vectors: DataFrame, group: str, pos: str, vector: str, width: int) -> DataFrame:
    """The first of each vector of ``width`` places in its group, by position."""
    fits = vectors.where(F.size(vector) == width)
    return fits.groupBy(group, vector).agg(F.min(pos).alias(pos))


def cluster_weights(rubrics: DataFrame, members: DataFrame, initial: DataFrame) -> DataFrame:
    """(instance, rubric, weight): weights of rubrics (instance, rubric, weight) summed by the one their cluster keeps, the greatest scaled to 50.

    members: (instance, member, keep); initial: (instance, rubric, numerator,
    denominator), which lists the candidates and counts where no weight is above
    0. A member of two clusters, or a rubric without candidate, raises.
    """
    one = members.groupBy("instance", "member").agg(F.min("keep").alias("keep"), F.max("keep").alias("_most"))
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    one = one.select("instance", F.col("member").alias("rubric"), F.when(F.col("keep") == F.col("_most"), F.col("keep").cast("string")).otherwise(fail("overlapping semantic cluster")).alias("keep"))
    named = rubrics.join(one, ["instance", "rubric"], "left").select("instance", F.coalesce("keep", F.col("rubric").cast("string")).alias("rubric"), "weight")
    total = named.groupBy("instance", "rubric").agg(F.sum("weight").alias("_sum"))
    base = initial.select("instance", F.col("rubric").cast("string").alias("rubric"), (F.col("numerator") / F.col("denominator")).alias("_first"), F.lit(True).alias("_known"))
    both = base.join(total, ["instance", "rubric"], "full")
    w = Window.partitionBy("instance")
    top = F.max("_sum").over(w)
    known = F.when(F.col("_known"), F.col("rubric")).otherwise(fail("base rubric is absent from the candidates"))
    scaled = F.when(top > 0, F.coalesce("_sum", F.lit(0.0)) * (float(MOST_TENTHS) / top)).otherwise(F.col("_first"))
    return both.select("instance", known.alias("rubric"), scaled.alias("weight"))


def balanced_offsets(draws: int, samples: DataFrame, key: str, seed: str) -> DataFrame:
    """(draw, key, offset): for each sample a tenth of the draws -1, a tenth 1 and the rest 0, in an order given by hash of seed, sample and draw."""
    if draws < 10 or draws % 10:
        raise ValueError("draws must be a positive multiple of 10")
    cells = samples.select(key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), key, "draw"), "draw"))
    tenth = draws // 10
    placed = cells.withColumn("_k", rank)
    return placed.select("draw", key, F.when(F.col("_k") <= tenth, -1).when(F.col("_k") > draws - tenth, 1).otherwise(0).alias("offset"))
