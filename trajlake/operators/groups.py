"""Operators on groups of samples: ranking, filters, normalisation, selection and statistics.

Each takes a DataFrame and column names. Groups are reduced with partial
aggregates where the result is a row a group; only per-row results use windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def three_way(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """1, -1 or 0: whether a is above, below or within epsilon of b."""
    return F.when(a > b + epsilon, 1).when(b > a + epsilon, -1).otherwise(0)


def pairs(df: DataFrame, group: str, pos: str, columns: list[str]) -> DataFrame:
    """Ordered pairs (left position below right) inside each group: projected before the self-join."""
    slim = df.select(group, pos, *columns)
    left = slim.select(group, *(F.col(c).alias(f"l_{c}") for c in (pos, *columns)))
    right = slim.select(group, *(F.col(c).alias(f"r_{c}") for c in (pos, *columns)))
    return left.join(right, group).where(F.col(f"l_{pos}") < F.col(f"r_{pos}"))


def ranking_metrics(df: DataFrame, group: str, pos: str, score: str, reward: str) -> DataFrame:
    """(group, n, tie_aware, pairwise): success of the top score and pairwise accuracy.

    tie_aware = |best by score & best by reward| / |best by score|; a pair with a
    tie on either side counts a half. Groups of one are left out.
    """
    best = df.groupBy(group).agg(F.max(score).alias("ms"), F.max(reward).alias("mr"), F.count(F.lit(1)).alias("n"))
    top = df.join(best, group).where(F.col(score) >= F.col("ms") - EPSILON)
    tie = top.groupBy(group).agg(
        F.max("n").alias("n"), F.avg((F.col(reward) >= F.col("mr") - EPSILON).cast("double")).alias("tie_aware")
    )
    s = three_way(F.col(f"l_{score}"), F.col(f"r_{score}"))
    r = three_way(F.col(f"l_{reward}"), F.col(f"r_{reward}"))
    point = F.when((s == 0) | (r == 0), 0.5).otherwise((s == r).cast("double"))
    acc = pairs(df, group, pos, [score, reward]).groupBy(group).agg(F.avg(point).alias("pairwise"))
    return tie.join(acc, group)


def strict_pairs(df: DataFrame, group: str, pos: str, reward: str) -> DataFrame:
    """Pairs of a group whose rewards differ by more than epsilon, with the sign."""
    sign = three_way(F.col(f"l_{reward}"), F.col(f"r_{reward}"))
    return pairs(df, group, pos, [reward]).withColumn("gt_sign", sign).where("gt_sign <> 0")


def strict_pair_accuracy(df: DataFrame, group: str, pos: str, score: str, reward: str) -> DataFrame:
    """(group, correct, total) over pairs of different reward; a tied score is wrong."""
    s = three_way(F.col(f"l_{score}"), F.col(f"r_{score}"))
    r = three_way(F.col(f"l_{reward}"), F.col(f"r_{reward}"))
    found = pairs(df, group, pos, [score, reward]).where(r != 0)
    return found.groupBy(group).agg(F.count_if(s == r).alias("correct"), F.count(F.lit(1)).alias("total"))


def pass_at_k(df: DataFrame, group: str, correct: Column, size: int) -> DataFrame:
    """(k, pass_rate) for k = 1, 2, 4.. up to ``size`` over groups of at least k samples."""
    by = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("c"))
    ks = [1]
    while ks[-1] * 2 <= size:
        ks.append(ks[-1] * 2)
    each = by.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("n >= k")
    miss = F.expr("aggregate(if(c = 0 or n - c < k, array(), sequence(n - c + 1, n)), 1D, (a, i) -> a * (1D - k / i))")
    rate = F.when(F.col("c") == 0, 0.0).when(F.expr("n - c < k"), 1.0).otherwise(1.0 - miss)
    return each.groupBy("k").agg(F.avg(rate).alias("pass_rate"), F.count(F.lit(1)).alias("groups"))


def statistics(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """mean, interpolated median, max and min; exact."""
    return df.groupBy(*(by or [])).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.max(value).alias("max"), F.min(value).alias("min"),
    )


def nearest_ranks(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, p50, ...) nearest ranks of each key's sorted values, from the counts of distinct ones: no key's values meet in one list."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(key)
    placed = counts.withColumn("_u", F.sum("_c").over(w.orderBy("_v"))).withColumn("_n", F.sum("_c").over(w))
    at = lambda q: F.min(F.when(F.col("_u") > F.bround((F.col("_n") - 1) * q, 0), F.col("_v")))
    return placed.groupBy(key).agg(*(at(q).alias(f"p{int(q * 100)}") for q in shares))


def nonzero_std(df: DataFrame, group: str, reward: str, floor: float = 1e-6) -> DataFrame:
    """(group, keep): unbiased deviation above the floor; a single sample is dropped."""
    keep = F.coalesce(F.stddev_samp(reward) > floor, F.lit(False))
    return df.groupBy(group).agg(keep.alias("keep"))


def judge_variance(df: DataFrame, group: str, reward: str, predicted_zero: str, floor: float = 1e-6) -> DataFrame:
    """(group, reason): inconsistent flags, predicted zero variance, zero deviation, or keep."""
    return df.groupBy(group).agg(
        F.when(F.bool_or(predicted_zero) & ~F.bool_and(predicted_zero), "inconsistent")
        .when(F.bool_and(predicted_zero), "predicted_zero")
        .when(F.coalesce(F.stddev_samp(reward) > floor, F.lit(False)), "keep")
        .otherwise("zero_std")
        .alias("reason")
    )


def centre(df: DataFrame, group: str, reward: str, mode: str = "unbiased", scale: bool = True) -> DataFrame:
    """``df`` with ``advantage``.

    unbiased: x - mean, over (sample deviation + 1e-6), null deviation as 0;
    population: zero and ``masked`` where the group is single or its deviation is
    at most 1e-9; unit: only rewards in [0, 1] count and change, an all-zero
    group stays, a deviation below 1e-8 gives 0 and 1e-8 is added to others.
    """
    w = Window.partitionBy(group)
    x = F.col(reward)
    if mode == "unbiased":
        d = x - F.avg(x).over(w)
        dev = F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)) + 1e-6
        return df.withColumn("advantage", d / dev if scale else d)
    if mode == "population":
        dev = F.stddev_pop(x).over(w)
        flat = (F.count(F.lit(1)).over(w) < 2) | (dev <= 1e-9)
        d = x - F.avg(x).over(w)
        return df.withColumn("masked", flat).withColumn(
            "advantage", F.when(flat, 0.0).otherwise(d / (dev + 1e-6) if scale else d)
        )
    if mode == "unit":
        inside = x.between(0, 1)
        y = F.when(inside, x)
        mean, dev = F.avg(y).over(w), F.stddev_pop(y).over(w)
        zero = F.max(F.when(inside, F.abs(x))).over(w) == 0
        return df.withColumn(
            "advantage", F.when(~inside | zero, x).when(dev < 1e-8, 0.0).otherwise((x - mean) / (dev + 1e-8))
        )
    raise ValueError(f"unknown mode {mode!r}")


def whiten(df: DataFrame, value: str, mask: Column, shift_mean: bool = True) -> DataFrame:
    """Masked whitening over the whole table: E[x^2] - E[x]^2, Bessel when two or more, rsqrt(var + 1e-8)."""
    x = F.when(mask, F.col(value))
    one = df.agg(F.avg(x).alias("m"), F.avg(x * x).alias("q"), F.count(x).alias("n"))
    var = F.expr("(q - m * m) * if(n >= 2, n / (n - 1), 1)")
    one = one.select("m", (1 / F.sqrt(var + 1e-8)).alias("r"), F.lit(1).alias("one"))
    out = df.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").drop("one")
    y = (F.col(value) - F.col("m")) * F.col("r")
    return out.withColumn("whitened", y if shift_mean else y + F.col("m")).drop("m", "r")


def whole_groups(df: DataFrame, group: str, valid: Column, size: int | None = None) -> DataFrame:
    """Rows of groups whose every member is valid (and that have ``size`` members, if given)."""
    ok = df.groupBy(group).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("n"))
    good = ok.where("ok" if size is None else f"ok and n = {int(size)}").select(group)
    return df.join(good, group, "left_semi")


def newest_groups(df: DataFrame, group: str, ts: str, n: int) -> DataFrame:
    """Groups by their latest time, the newest n; ties by group. A top-k, not a global sort."""
    return df.groupBy(group).agg(F.max(ts).alias("latest")).orderBy(F.desc("latest"), group).limit(n)


def first_wins(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """First row of each key by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(base: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``change`` put in place of equal keys, or added."""
    return base.join(change.select(key), key, "left_anti").select(*base.columns).unionByName(change.select(*base.columns))


def ratio_of_sums(df: DataFrame, by: list[str], top: Column, bottom: Column, empty: float = 0.0) -> DataFrame:
    """sum(top) / sum(bottom) by group; ``empty`` where the divisor is 0."""
    rate = F.coalesce(F.try_divide(F.sum(top).cast("double"), F.sum(bottom).cast("double")), F.lit(empty))
    return df.groupBy(*by).agg(rate.alias("ratio"))


def fresh(df: DataFrame, version: str, current: int, max_lag: int = 1) -> DataFrame:
    """Rows at most ``max_lag`` versions old; a version from the future raises."""
    lag = F.lit(current) - F.col(version)
    checked = F.when(lag < 0, F.raise_error(F.lit("version from the future"))).otherwise(lag)
    return df.withColumn("lag", checked.cast("long")).where(F.col("lag") <= max_lag)


def version_lag(policy: Column, observed: Column) -> Column:
    """Distance of two labels by the number that ends them; a label without one raises."""
    def number(c: Column) -> Column:
        digits = F.regexp_extract(c, r"(\d+)$", 1)
        return F.when(digits == "", F.raise_error(F.lit("policy label without a number"))).otherwise(digits.cast("long"))

    return number(observed) - number(policy)


def by_request(df: DataFrame, requests: DataFrame, key: str, pos: str) -> DataFrame:
    """Each request with the row of its key, to be read in order of ``pos``; ``found`` is false where there is none.

    ``df`` holds one row a key (``first_wins`` picks it). Callers that allow no
    missing key filter on ``found``.
    """
    return requests.join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def group_diagnostics(df: DataFrame, group: str, pos: str, truth: str, judged: str, predicted_zero: str, abstained: str) -> DataFrame:
    """One row of sums over groups: pairs of different truth and those judged in their order (a tie is wrong), and both detectors' confusion counts.

    variance: by what was predicted in the end; stage1: by the judge's abstention
    alone. Groups with a missing judgement don't count, those with a missing
    truth only as groups.
    """
    whole = df.groupBy(group).agg(
        F.count_if(F.col(judged).isNull()).alias("_nj"), F.count_if(F.col(truth).isNull()).alias("_nt"), (F.max(truth) - F.min(truth)).alias("_span"),
        F.min_by(predicted_zero, pos).alias("_zero"), F.min_by(abstained, pos).alias("_quiet"), F.count(F.lit(1)).alias("_n"),
    ).where("_nj = 0")
    known = whole.where("_nt = 0")
    rows = df.join(known.select(group), group, "left_semi").select(group, pos, truth, judged)
    other = rows.select(group, F.col(pos).alias("_p"), F.col(truth).alias("_t"), F.col(judged).alias("_j"))
    apart = F.abs(F.col(truth) - F.col("_t")) > 1e-12
    right = ((F.col(truth) > F.col("_t")) & (F.col(judged) - F.col("_j") > 1e-12)) | ((F.col(truth) < F.col("_t")) & (F.col("_j") - F.col(judged) > 1e-12))
    pairs = rows.join(other, group).where(F.col(pos) < F.col("_p")).where(apart).agg(F.count(F.lit(1)).alias("gt_pairs"), F.count_if(right).alias("gt_correct"))
    varies = F.coalesce(F.col("_span") > 1e-12, F.lit(False)) & (F.col("_nt") == 0)
    cells = []
    for prefix, predicted in (("variance", ~F.col("_zero")), ("stage1", ~F.col("_quiet"))):
        for name, hit in (("tp", predicted & varies), ("fp", predicted & ~varies), ("fn", ~predicted & varies), ("tn", ~predicted & ~varies)):
            cells.append(F.count_if(hit & (F.col("_nt") == 0)).alias(f"{prefix}_{name}"))
    sums = whole.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rollouts"), F.count_if("_zero").alias("predicted_zero_groups"), F.count_if("_quiet").alias("explicit_abstain_groups"), *cells)
    one = lambda t: t.withColumn("_one", F.lit(1))
    return one(sums).join(one(pairs), "_one").drop("_one")


def length_quartiles(df: DataFrame, length: str, longest: int, parts: int = 4) -> DataFrame:
    """One row p25 .. p100: shares of lengths by which part of the longest they reach; lengths beyond it don't count."""
    bucket = F.greatest(F.lit(1), F.ceil(F.col(length) * parts / F.lit(longest)))
    inside = F.col(length) <= longest
    share = lambda k: F.coalesce(F.try_divide(F.count_if(inside & (bucket == k)), F.count_if(inside)), F.lit(0.0))
    return df.agg(*(share(k).alias(f"p{-(-100 * k // parts)}") for k in range(1, parts + 1)))
