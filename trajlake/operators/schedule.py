"""A whole data-parallel schedule: steps of rollouts, micro-batches within a token bound, the same number for each rank."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import with_rank
from .packing import first_fit, largest_differencing, split_heaviest


@dataclass(frozen=True)
class Plan:
    """Sizes of a schedule.

    ``rollouts`` a step; ``ranks``; ``tokens`` a micro-batch may hold (dynamic)
    or ``samples`` it has (static); ``together``: micro-batches of a rank come
    in multiples of it. ``balance_bins`` packs by cost instead of first fit,
    which doesn't hold the token bound; ``balance_ranks`` deals micro-batches by cost.
    """

    rollouts: int
    ranks: int
    tokens: int | None = None
    samples: int | None = None
    together: int = 1
    balance_bins: bool = False
    balance_ranks: bool = False

    def __post_init__(self) -> None:
        if (self.tokens is None) == (self.samples is None):
            raise ValueError("a schedule needs either tokens or samples of a micro-batch")
        if min(self.rollouts, self.ranks, self.together, self.tokens or self.samples or 0) < 1:
            raise ValueError("sizes of a schedule start at 1")


def micro_batches(lengths: list[int], costs: list[float], plan: Plan) -> list[list[int]]:
    """The samples of one step, as places in it, by micro-batch; their number is a multiple of ranks x together."""
    n, unit = len(lengths), plan.ranks * plan.together
    if plan.samples is not None:
        bins = [list(range(i, min(i + plan.samples, n))) for i in range(0, n, plan.samples)]
        if len(bins) % unit or not bins:
            raise ValueError(f"{len(bins)} micro-batches aren't a multiple of {unit}")
        return bins
    count = max(1, -(-sum(lengths) // plan.tokens))
    if not plan.balance_bins:
        bins = _rows(first_fit(lengths, plan.tokens))
    elif count >= n:
        bins = [[i] for i in range(n)]
    else:
        bins = _rows(largest_differencing(costs, count))
    bins = split_heaviest(bins, lengths, max(unit, -(-len(bins) // unit) * unit))
    if len(bins) % unit:
        raise ValueError(f"{n} samples can't fill a multiple of {unit} micro-batches")
    return bins


def _rows(bin_of: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(bin_of):
        out.setdefault(b, []).append(i)
    return [out[b] for b in sorted(out)]


def dealt(bins: list[list[int]], costs: list[float], plan: Plan) -> list[list[int]]:
    """By rank, the numbers of its micro-batches: in turn, or as many to each rank with costs as even as can be."""
    if not plan.balance_ranks:
        return [list(range(r, len(bins), plan.ranks)) for r in range(plan.ranks)]
    return _rows(largest_differencing([sum(costs[i] for i in b) for b in bins], plan.ranks, equal_size=True))


def schedule(samples: DataFrame, plan: Plan, sample: str, rollout: str, length: str, cost: str | None = None) -> DataFrame:
    """(sample, step, rank, micro_batch, place): where each sample of a full step is trained.

    Rollouts are taken in the order of their first sample, so many a step, with
    all their samples; a last step that isn't full is left out. ``micro_batch``
    counts a rank's micro-batches through all steps, ``place`` its samples; both
    start at 0 and have no gap. ``cost`` (default: the length) is what
    balancing evens out. ``sample`` is a distinct whole number. A step is in
    one task, as the batch bounds its size. A step with fewer samples than
    ranks raises, and so does a static one that doesn't come out even.
    """
    rows = samples.select(F.col(sample).cast("long").alias("sample"), F.col(rollout).alias("rollout"), F.col(length).cast("long").alias("length"),
                          F.col(cost or length).cast("double").alias("cost"))
    firsts = rows.groupBy("rollout").agg(F.min("sample").alias("first"))
    firsts = with_rank(firsts, "first").withColumn("step", F.expr(f"rank div {plan.rollouts}"))
    full = firsts.groupBy("step").agg(F.count("*").alias("n")).where(F.col("n") == plan.rollouts).select("step")
    steps = rows.join(firsts.join(full, "step").select("rollout", "step", "first"), "rollout")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "sample"]).reset_index(drop=True)
        lengths, costs = pdf["length"].tolist(), pdf["cost"].tolist()
        if len(pdf) < plan.ranks:
            raise ValueError(f"step {pdf['step'][0]} has fewer samples than ranks")
        bins = micro_batches(lengths, costs, plan)
        out = []
        for rank, own in enumerate(dealt(bins, costs, plan)):
            place = 0
            for k, b in enumerate(own):
                for i in bins[b]:
                    out.append((pdf["sample"][i], pdf["step"][i], rank, k, place))
                    place += 1
        return pd.DataFrame(out, columns=["sample", "step", "rank", "micro", "place"])

    placed = steps.groupBy("step").applyInPandas(run, "sample long, step long, rank int, micro int, place int")
    sizes = placed.groupBy("rank", "step").agg((F.max("micro") + 1).alias("micros"), F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # one row a step
    offsets = sizes.select("rank", "step", F.coalesce(F.sum("micros").over(before), F.lit(0)).alias("m"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    out = placed.join(offsets, ["rank", "step"])
    return out.select("sample", "step", "rank", (F.col("m") + F.col("micro")).alias("micro_batch"), (F.col("p") + F.col("place")).alias("place"))
