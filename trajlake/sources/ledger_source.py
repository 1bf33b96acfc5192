"""A data source of append-only line files, read by byte offsets: whole lines only, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .runs import LEDGER

#: Name of the format.
FORMAT = "trajlake_ledger"
#: Bytes of a file that one task reads; bytes that are looked at once.
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
#: Lines of an Arrow batch.
BATCH_LINES = 4096


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> Iterator[tuple[pafs.FileSystem, str, int]]:
    """(file system, file, size) of a file, or of the visible files of a folder, by name."""
    store, inner = _at(path)
    info = store.get_file_info(inner)
    found = [info] if info.type == pafs.FileType.File else []
    if info.type == pafs.FileType.Directory:
        found = [x for x in store.get_file_info(pafs.FileSelector(inner)) if x.type == pafs.FileType.File and x.base_name[0] not in "._"]
    for x in sorted(found, key=lambda x: x.path):
        yield store, x.path, x.size


def _whole(store: pafs.FileSystem, file: str, size: int) -> int:
    """Bytes of the file up to the end of its last whole line: read backwards, block by block."""
    with store.open_input_file(file) as f:
        end = size
        while end > 0:
            begin = max(0, end - BLOCK_BYTES)
            f.seek(begin)
            cut = f.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return 0


def _lines(stream, begin: int, stop: int, end: int, skip: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in [begin, stop), the last one read on to ``end`` at most.

    With ``skip`` the range may begin within a line, which belongs to the range
    before: reading starts one byte earlier and drops the first piece.
    """
    at = begin - 1 if skip else begin
    stream.seek(at)
    held, read = b"", at
    while at < stop:
        block = stream.read(min(BLOCK_BYTES, end - read))
        if not block:
            return
        read += len(block)
        if b"\n" not in block:
            held += block
            continue
        pieces = (held + block).split(b"\n")
        held = pieces.pop()
        for line in pieces:
            if at >= stop:
                return
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1


def _offsets(text: str | None) -> dict[str, int]:
    """Offsets by file, checked: whole numbers from 0."""
    out = json.loads(text) if text else {}
    if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in out.values()):
        raise ValueError("offsets of a ledger must be whole numbers from 0")
    return out


@dataclass
class _Range(InputPartition):
    file: str
    begin: int
    stop: int
    first: int
    end: int


class _Reading:
    """What batch and stream share: the options, the ranges between two offsets, and how to read one."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = _offsets(options.get("start"))
        self.end = _offsets(options["end"]) if options.get("end") else None
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def latest(self) -> dict[str, int]:
        return {file: _whole(store, file, size) for store, file, size in _files(self.path)}

    def ranges(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            cuts = [*range(first, stop, self.split), stop]
            out += [_Range(file, a, b, first, stop) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        return out

    def rows(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no range at all is planned as one task
            return
        store, _ = _at(self.path)
        names, held = ["path", "at", "line"], []

        def batch() -> pa.RecordBatch:
            texts = []
            for _, line in held:
                try:
                    texts.append(line.decode())
                except UnicodeDecodeError:
                    texts.append(None)
            return pa.RecordBatch.from_arrays(
                [pa.array([part.file] * len(held)), pa.array([at for at, _ in held], pa.int64()), pa.array(texts, pa.string())], names
            )

        with store.open_input_file(part.file) as f:
            for row in _lines(f, part.begin, part.stop, part.end, part.begin > part.first):
                held.append(row)
                if len(held) == BATCH_LINES:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return self.ranges(self.start, self.latest() if self.end is None else self.end)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        return self.latest() if self.end is None else self.end

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self.ranges(start, end)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class LedgerLines(DataSource):
    """Lines of a ledger with their places.

    Options: ``path``, a file or a folder of files; ``start`` and ``end``, JSON
    objects of a byte offset by file (nothing, and the last whole line);
    ``splitBytes``. Files only grow. A last line without line end isn't read
    until it has one. A line that isn't UTF-8 is null.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, at long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _source(reader, spark: SparkSession, path: str, start: dict | None, end: dict | None, split_bytes: int | None) -> DataFrame:
    spark.dataSource.register(LedgerLines)
    given = {"path": path, "start": start and json.dumps(start), "end": json.dumps(end) if end is not None else None, "splitBytes": split_bytes}
    return reader.format(FORMAT).options(**{k: str(v) for k, v in given.items() if v is not None}).load()


def ledger_lines(spark: SparkSession, path: str, start: dict | None = None, end: dict | None = None, split_bytes: int | None = None) -> DataFrame:
    """(path, at, line) of the whole lines between two offsets."""
    return _source(spark.read, spark, path, start, end, split_bytes)


def ledger_stream(spark: SparkSession, path: str, start: dict | None = None, split_bytes: int | None = None) -> DataFrame:
    """(path, at, line) of whole lines as they are completed; the query's checkpoint keeps the offsets."""
    return _source(spark.readStream, spark, path, start, None, split_bytes)


def ledger_offsets(path: str) -> dict[str, int]:
    """Where the ledger ends now, by file, at whole lines: what a checkpoint keeps."""
    return {file: _whole(store, file, size) for store, file, size in _files(path)}


def events_of(lines: DataFrame) -> DataFrame:
    """Events of lines, with their places; lines that aren't JSON objects with a non-blank event id are skipped."""
    parsed = lines.select("path", "at", F.from_json("line", LEDGER).alias("e")).select("path", "at", "e.*")
    return parsed.where(F.length("event_id") > 0)


def first_events(events: DataFrame) -> DataFrame:
    """The first event of each id: by place in a batch; in a stream the first to arrive, with ids kept as state."""
    if events.isStreaming:
        return events.dropDuplicates(["event_id"])
    rest = [c for c in events.columns if c != "event_id"]
    return events.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct("path", "at")).alias("r")).select("event_id", "r.*")


def resume_window(spark: SparkSession, path: str, checkpoint: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(history, stream) of a run restored at ``checkpoint``: the lines up to it, and those completed from now on.

    What lies between belongs to the run that was given up: neither has it.
    Negative or fractional offsets raise.
    """
    _offsets(json.dumps(checkpoint))
    return ledger_lines(spark, path, end=checkpoint), ledger_stream(spark, path, start=ledger_offsets(path))
