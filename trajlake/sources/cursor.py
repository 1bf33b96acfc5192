"""A cursor over a table of numbered rows that wraps over epochs, saved as one JSON row in any store Spark writes to."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cursor:
    """Rows handed out in this epoch, whole epochs, groups and samples handed out in all, validation rows scheduled and acknowledged."""

    offset: int = 0
    epoch: int = 0
    groups: int = 0
    samples: int = 0
    validated: int = 0
    acknowledged: int = 0

    def take(self, rows: DataFrame, rank: str, size: int, n: int, copies: int = 1) -> tuple[DataFrame, Cursor]:
        """The next ``n`` rows of ``size`` in order of ``rank`` (from 0), over the end into later epochs, ``copies`` of each.

        Columns ``epoch``, ``group_index`` and ``sample_index`` follow. The range of ranks is filtered in the scan.
        """
        if size <= 0:
            raise ValueError("the table has no rows")
        spans, at, left, group = [], self, n, self.groups
        while left > 0:
            count = min(left, size - at.offset)
            part = rows.where(F.col(rank).between(at.offset, at.offset + count - 1))
            part = part.select("*", F.lit(at.epoch).alias("epoch"), (F.col(rank) - at.offset + group).cast("long").alias("group_index"))
            spans.append(part)
            group, left = group + count, left - count
            full = at.offset + count == size
            at = replace(at, offset=0 if full else at.offset + count, epoch=at.epoch + full)
        out = spans[0] if spans else rows.where(F.lit(False)).select("*", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("group_index"))
        for more in spans[1:]:
            out = out.unionByName(more)
        copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        out = out.withColumn("_copy", copy)
        sample = F.lit(self.samples) + (F.col("group_index") - self.groups) * copies + F.col("_copy")
        out = out.withColumn("sample_index", sample.cast("long")).drop("_copy")
        return out, replace(at, groups=group, samples=self.samples + n * copies)

    def mark_validated(self, scheduled: int, size: int) -> Cursor:
        """``scheduled`` validation rows in all; the count never falls and never exceeds ``size``."""
        if not 0 <= scheduled <= size:
            raise ValueError(f"{scheduled} of {size} validation rows")
        return replace(self, validated=max(self.validated, scheduled))

    def acknowledge(self, attempted: int) -> Cursor:
        """Attempts that a validation covered; the count never falls and never exceeds what was scheduled."""
        if attempted > self.validated:
            raise ValueError(f"{attempted} acknowledged of {self.validated} scheduled")
        return replace(self, acknowledged=max(self.acknowledged, attempted))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([asdict(self)], _SCHEMA).coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Cursor:
        """The saved cursor; one saved without some of the numbers has them at 0."""
        row = spark.read.schema(_SCHEMA).json(path).first()
        if row is None:
            raise ValueError(f"no cursor in {path}")
        return Cursor(**{k: v or 0 for k, v in row.asDict().items()})


_SCHEMA = "offset long, epoch long, groups long, samples long, validated long, acknowledged long"
