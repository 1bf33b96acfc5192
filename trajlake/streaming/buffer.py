"""A buffer of groups in a stream: items are held as list state until their group is complete, then given out together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that list state and timers need, to be set before the query starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Rows of a group after which it is looked at again within a micro-batch.
CHUNK_ROWS = 1024

Valid = Callable[[list[Row]], bool]
Transform = Callable[[list[Row]], list[Row]]


def of_size(size: int, text: str | None = None) -> Valid:
    """A group is complete with ``size`` items; with ``text`` so many must have one that isn't blank."""
    if size < 1:
        raise ValueError("a group needs an item")

    def valid(items: list[Row]) -> bool:
        return len(items) >= size and (text is None or sum(bool((r[text] or "").strip()) for r in items) >= size)

    return valid


class _Buffer(StatefulProcessor):
    def __init__(self, schema: StructType, valid: Valid, transform: Transform | None, patience: int | None, keep: int | None):
        self.schema, self.valid, self.transform, self.patience, self.keep = schema, valid, transform, patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", self.schema, self.keep)

    def _out(self, items: list[Row], status: str) -> Iterator[Row]:
        names = self.schema.names
        for r in self.transform(items) if self.transform else items:
            yield Row(*names, "status")(*(r[n] for n in names), status)

    def _timer(self, now: int | None) -> None:
        """The group's one timer: ``now`` and its patience, or none."""
        if self.patience is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due[0] if isinstance(due, tuple) else due)
            if now is not None:
                self.handle.registerTimer(now + self.patience)

    def _held(self) -> list[Row]:
        return [Row(*self.schema.names)(*r) for r in self.items.get()] if self.items.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        group = self._held()
        known, done = bool(group), False
        while part := list(islice(rows, CHUNK_ROWS)):
            if done:
                yield from self._out(part, "complete")
                continue
            group += part
            if self.valid(group):
                done = True
                yield from self._out(group, "complete")
                group = []
        if not done:
            self.items.put([tuple(r[n] for n in self.schema.names) for r in group])
            self._timer(timerValues.getCurrentProcessingTimeInMs() if self.patience is not None else None)
        elif known:
            self.items.clear()
            self._timer(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._out(self._held(), "timed_out")
        self.items.clear()

    def close(self) -> None:
        pass


def buffered_groups(
    samples: DataFrame, key: str, valid: Valid, transform: Transform | None = None, patience: int | None = None, keep: int | None = None
) -> DataFrame:
    """The rows of complete groups, each once, with ``status``; the others wait with all their columns.

    At the end of a micro-batch a group of which ``valid`` holds is given out
    whole, with what came in that batch, and forgotten: later rows of its key
    begin a new group. ``transform`` maps a group's rows before. With
    ``patience``, a group without new rows for so many milliseconds is given
    out as it is, as ``timed_out``; with ``keep``, items older than that many
    milliseconds are dropped. A key's held rows are in one task at once, as
    few as ``valid`` leaves incomplete; what follows a completion in the same
    batch passes by in runs of CHUNK_ROWS rows. Rows with a null key are one group.
    """
    if patience is not None and patience <= 0:
        raise ValueError("patience must be positive")
    schema = StructType(list(samples.schema.fields))
    out = StructType(list(schema.fields)).add("status", "string")
    timed = patience is not None or keep is not None
    return samples.groupBy(key).transformWithState(_Buffer(schema, valid, transform, patience, keep), out, "Append", "ProcessingTime" if timed else "None")


def held_items(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows of incomplete groups that a stopped query's checkpoint holds, read from its state store."""
    state = spark.read.format("statestore").option("stateVarName", "items").load(checkpoint)
    return state.select("list_element.*")


def interval_meta(items: DataFrame, key: str, reward: str) -> DataFrame:
    """One row over held or received items: total_samples, num_groups, avg_group_size, avg_reward; zeros without any."""
    groups = items.groupBy(key).agg(F.count("*").alias("n"), F.sum(reward).alias("total"), F.count(reward).alias("scored"))
    zero = F.lit(0.0)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"), F.count("*").alias("num_groups"), F.coalesce(F.sum("n") / F.count("*"), zero).alias("avg_group_size"),
        F.coalesce(F.sum("total") / F.nullif(F.sum("scored"), F.lit(0)), zero).alias("avg_reward"),
    )


def run_once(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the query over all that has come, appends its rows to ``path`` and returns that table."""
    spark = out.sparkSession
    known = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], known) if known else spark.conf.unset(PROVIDER[0])
    return spark.read.schema(out.schema).parquet(path)
