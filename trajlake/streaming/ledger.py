"""Structured Streaming: tail of an append-only ledger, group buffer, staleness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType, kind: str = "json") -> DataFrame:
    """New files of a ledger folder as they come; offsets are kept by the query's checkpoint."""
    return spark.readStream.schema(schema).format(kind).load(path)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each event id; the watermark bounds the state."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def token_totals(events: DataFrame, ts: str = "ts", width: str = "10 minutes", by: str = "family") -> DataFrame:
    """Tokens by window and key."""
    return events.groupBy(F.window(ts, width), by).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


def complete_groups(samples: DataFrame, group: str, value: str, size: int, patience: int | None = None) -> DataFrame:
    """(group, n, mean) once, when a group has ``size`` samples; its state is then dropped.

    State is a count and a sum, so it doesn't grow with the group. Samples past
    a completion begin the group anew. Incomplete groups wait, with
    ``patience`` at most so many milliseconds after their last sample: they are
    then given out as they are and dropped.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], n, total / n)], columns=[group, "n", "mean"])
            return
        out = []
        for part in parts:
            for v in part[value]:
                n, total = n + 1, total + float(v)
                if n == size:
                    out.append((key[0], n, total / n))
                    n, total = 0, 0.0
        if n:
            state.update((n, total))
            if patience is not None:
                state.setTimeoutDuration(patience)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[group, "n", "mean"])

    kind = samples.schema[group].dataType.simpleString()
    return samples.groupBy(group).applyInPandasWithState(
        update, f"{group} {kind}, n long, mean double", "n long, total double", "append",
        GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def save_buffer(groups: DataFrame, path: str) -> None:
    """A snapshot of buffered groups; nested samples stay nested."""
    groups.write.mode("overwrite").parquet(path)


def load_buffer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
