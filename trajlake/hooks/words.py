"""A generator of word spans: a rollout hook with the parts that a group buffer takes from it, and hooks on its samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import f1
from ..streaming.buffer import interval_meta, of_size  # noqa: F401

TASK_TYPE = "words"


class run_rollout:  # noqa: N801
    """``count`` spans of ``size`` words of a text, one after another, as samples of one group; fewer where the text ends."""

    RETURNS = "sample int, response string, n_words int"

    def eval(self, text: str | None, count: int, size: int = 8) -> Iterator[tuple[int, str, int]]:
        words = (text or "").split()
        for k in range(count):
            part = words[k * size : (k + 1) * size]
            if not part:
                return
            yield k, " ".join(part), len(part)


def transform_group(group: list[Row]) -> list[Row]:
    return sorted(group, key=lambda r: r["sample"])


is_valid_group = of_size(4, "response")


def varied(samples: DataFrame, group: str = "group", reward: str = "reward") -> DataFrame:
    """Filter hook: groups whose rewards differ."""
    by = Window.partitionBy(group)
    marked = samples.withColumn("_spread", F.max(reward).over(by) > F.min(reward).over(by))
    return marked.where("_spread").drop("_spread")


def overlap(response: Column, label: Column) -> Column:
    """Reward hook: F1 of the words of the response and of the label."""
    return f1(response, label)


def long_share(response: Column, label: Column, size: int = 8) -> Column:
    """Reward hook: share of the response's words that are longer than the label's first."""
    words = F.split(response, " ")
    least = F.length(F.split(label, " ")[0])
    return F.size(F.filter(words, lambda w: F.length(w) > least)) / F.greatest(F.size(words), F.lit(size))


def centred(rewards: Column, group: Column | str = "group") -> Column:
    """Advantage hook: reward less the mean of its group."""
    return rewards - F.avg(rewards).over(Window.partitionBy(group))


def counts(samples: DataFrame) -> DataFrame:
    """Log hook: samples and mean reward."""
    return samples.agg(F.count("*").alias("n"), F.round(F.avg("reward"), 9).alias("mean_reward"))
