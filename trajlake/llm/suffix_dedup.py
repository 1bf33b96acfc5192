"""Operator 5: passages repeated across documents, by a sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, free_names, parts, read, release, scratch
from .wordhash import U, Words, _powers, as_long, chunks, mix

#: A passage counts as repeated from so many words on.
MIN_WORDS = 50
#: Words at a retained suffix that choose it and head its sort key.
SEED_WORDS = 20


def _totals(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any run of words follows, and the powers that align it."""
    n = len(words.hash)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(words.hash * up[:n], out=total[1:])
    return total, down


def _run_hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def _retained(words: Words, length: int, seed: int):
    """The retained suffixes: (position, seed hash, first and last window start that chose it).

    A window of ``length`` words chooses the position of its least ``seed``-gram
    hash (leftmost on ties). That depends on the window's words only, so equal
    windows choose equal suffixes; the windows that chose one are consecutive.
    """
    n = len(words.hash)
    windows = n - length + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, np.zeros(0, U), none, none
    value, at = words.grams(seed)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=U)
    least[at] = value
    where = np.arange(n)
    best, span, width = where, 1, length - seed + 1
    # best[i]: position of the least gram in [i, i + span)
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(least[b] < least[a], b, a)
        span *= 2
    a, b = best[:windows], best[width - span : width - span + windows]
    best = np.where(least[b] < least[a], b, a)
    start = np.flatnonzero(words.row[:windows] == words.row[length - 1 :])
    chosen = best[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (np.diff(start) > 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start)) - 1
    return chosen[begin], least[chosen[begin]], start[begin], start[last[: len(begin)]]


def _suffixes(length: int, seed: int):
    """Rows of the suffix table: seed, hash of all words that its windows cover, document, covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, words in chunks(batch.column(2)):
                at, value, first, last = _retained(words, length, seed)
                if not len(at):
                    continue
                total, down = _totals(words)
                around = _run_hash(total, down, first, last + length)
                around = mix(around ^ mix((at - first).astype(U) + U(length)))
                row = words.row[at]
                of = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(value),
                        as_long(around),
                        batch.column(0).take(of),
                        batch.column(1).take(of),
                        pa.array(first - words.first[row], pa.int32()),
                        pa.array(last - first + 1, pa.int32()),
                    ],
                    ["a", "b", "doc_id", "text_key", "at", "n"],
                )

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares sorted neighbours: each row's run of equal (a, b), its head, and whether another run shares a.

    A row behind the head of its run is returned with the head's document. A
    head is returned if the run before or behind shares its a, or if its run
    touches an end of the partition, where the neighbour isn't seen. ``edge``
    tells the rows whose head may lie in an earlier partition, and the last head.
    """
    names = ["a", "b", "doc_id", "text_key", "at", "n", "kept", "again", "edge"]
    carry: list | None = None  # head of the run at hand
    sibling, edge = False, True  # does the run before it share a; is it the partition's first
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(6)]
        if carry is not None:
            rows = [np.concatenate((c, r)) for c, r in zip(carry, rows, strict=True)]
        a, b, doc, text_key, at, _ = rows
        if not len(a):
            continue
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin, run = np.flatnonzero(new), np.cumsum(new) - 1
        head = begin[run]
        again = (doc != doc[head]) | (text_key != text_key[head]) | (at != at[head])
        shared = np.zeros(len(begin), dtype=bool)  # with the run before
        shared[0], shared[1:] = sibling, a[begin[1:]] == a[begin[:-1]]
        first = np.zeros(len(begin), dtype=bool)
        first[0] = edge
        told = first[:-1] | shared[:-1] | shared[1:]  # the last run goes on
        out = np.concatenate((np.flatnonzero(again), begin[:-1][told]))
        columns = [*(r[out] for r in rows), doc[head[out]], again[out], first[run[out]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        carry = [r[begin[-1:]] for r in rows]
        sibling, edge = bool(shared[-1]), bool(first[-1])
    if carry is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*carry, carry[2], np.array([False]), np.array([True]))], names)


_ROW = "a long, b long, doc_id long, text_key long, at int, n int"


def _sorted_runs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(again, heads, scratch table of both) of the rows sorted by (a, b, doc_id, text_key, at).

    The rows are dealt by ranges of the whole key, so that one very common
    key spans several tasks. Runs that go over the end of a partition are put
    right by a table of two rows a partition at most: the run's first head.
    """
    order = ["a", "b", "doc_id", "text_key", "at"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = scratch(dealt.mapInArrow(_neighbours, f"{_ROW}, kept long, again boolean, edge boolean"), "runs", rows=10_000)
    own = F.struct("doc_id", "text_key", "at")
    ends = out.where("edge and not again").groupBy("a", "b", "edge").agg(F.min(own).alias("true"))
    fixed = out.join(F.broadcast(ends), ["a", "b", "edge"], "left")
    fixed = fixed.withColumn("again", F.coalesce(F.col("true") != own, "again"))
    fixed = fixed.withColumn("kept", F.coalesce("true.doc_id", "kept"))
    again = fixed.where("again").select("doc_id", "text_key", "at", "n", "kept")
    return again, fixed.where("not again").select("doc_id", "text_key", "at"), out


def _extensions(length: int, seed: int):
    """The windows around the asked suffixes: each way to extend one by ``length`` words in all, left and right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(3)
            for lo, hi, words in chunks(batch.column(2)):
                at, value, first, last = _retained(words, length, seed)
                total, down = _totals(words)
                row = words.row[at]
                counts = np.diff(asked.slice(lo, hi - lo).offsets.to_numpy())
                width = int(words.count.max(initial=0)) + 1
                wanted = np.repeat(np.arange(hi - lo), counts) * width + asked.slice(lo, hi - lo).flatten().to_numpy()
                keep = np.isin(row * width + first - words.first[row], wanted)
                first, last, value, row = first[keep], last[keep], value[keep], row[keep]
                size = last - first + 1
                start = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                if not len(start):
                    continue
                row = np.repeat(row, size)
                of = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(np.repeat(value, size)),
                        as_long(_run_hash(total, down, start, start + length)),
                        batch.column(0).take(of),
                        batch.column(1).take(of),
                        pa.array(start - words.first[row], pa.int32()),
                        pa.array(np.ones(len(start)), pa.int32()),
                    ],
                    ["a", "b", "doc_id", "text_key", "at", "n"],
                )

    return run


def _spans(length: int):
    """Unions of marked windows, one row a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
            for doc, text_key, marks in keys:
                flat = marks.values
                at, n, kept = (flat.field(k).to_numpy() for k in range(3))
                order = np.argsort(at, kind="stable")
                at, end, kept = at[order], np.maximum.accumulate((at + n)[order] - 1 + length), kept[order]
                cut = np.flatnonzero(at[1:] > end[:-1]) + 1
                for p, e, k in zip(np.split(at, cut), np.split(end, cut), np.split(kept, cut), strict=True):
                    out.append((doc, text_key, int(p[0]), int(e[-1] - p[0]), np.unique(k).tolist()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            names = ["doc_id", "text_key", "first_word", "n_words", "kept_doc_ids"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    return run


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = MIN_WORDS,
    seed: int = SEED_WORDS,
) -> DataFrame:
    """(doc_id, text_key, first_word, n_words, kept_doc_ids): what repeats earlier text, word for word (A-Z folded).

    Every run of ``length`` words that an earlier document (smaller id), or the
    same one further up, holds too lies in a span; the first occurrence is in
    none. ``kept_doc_ids`` names documents that hold the span's words first.

    Each window of ``length`` words retains one suffix, at its minimiser of
    ``seed`` words (about one position in 16). Suffixes are sorted by seed, then
    by the words around it as far as their windows reach. (1) Neighbours that
    agree in both repeat each other whole: all but the first are marked.
    (2) Neighbours that agree in the seed alone are extended left and right on
    their texts: each way to reach ``length`` words is a row, these rows are
    sorted and compared in the same way, and all but the first are marked.
    Spans are unions of marked windows. Words are compared by two 64-bit hashes.

    ``text_key`` is xxhash64 of the text: rows that repeat an id with other
    text are documents of their own, those with equal text count as one. Null,
    empty and short texts have no span. Rows with a null id are left out. Other
    columns are ignored. An empty table gives no rows.
    """
    plain = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    plain = plain.where("doc_id is not null and text is not null")
    plain = plain.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = scratch(plain.mapInArrow(_suffixes(length, seed), _ROW), "suffixes")
    again, heads, runs = _sorted_runs(rows)
    release(rows)
    marks = scratch(again, "marks")
    asked = scratch(heads.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("asked")), "asked")
    release(runs)
    found = plain.join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "asked")
    windows = scratch(found.mapInArrow(_extensions(length, seed), _ROW), "windows")
    release(asked)
    more, _, runs = _sorted_runs(windows)
    release(windows)
    by_doc = marks.unionByName(more).groupBy("doc_id", "text_key")
    by_doc = by_doc.agg(F.collect_list(F.struct("at", "n", "kept")).alias("marks"))
    shape = "doc_id long, text_key long, first_word int, n_words int, kept_doc_ids array<long>"
    spans = scratch(by_doc.mapInArrow(_spans(length), shape), "spans")
    release(marks, runs)
    return spans


def _without(words: Words, i: int, spans: list[dict]) -> str:
    """Row i's text without the spans' words and the white space after each."""
    begin, end = int(words.offsets[i]), int(words.offsets[i + 1])
    first, count, parts, at = int(words.first[i]), int(words.count[i]), [], begin
    for a, n in sorted((s["first_word"], s["n_words"]) for s in spans):
        if a < count:
            parts.append(words.raw[at : max(at, int(words.start[first + a]))].tobytes())
            at = int(words.start[first + a + n]) if a + n < count else end
    parts.append(words.raw[at:end].tobytes())
    return b"".join(parts).decode()


def _cut(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, spans = batch.column(text_col), batch.column("spans")
            marked = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(marked):
                out = texts.to_pylist()
                todo = spans.take(pa.array(marked)).to_pylist()
                for lo, hi, words in chunks(texts.take(pa.array(marked))):
                    for i in range(hi - lo):
                        out[marked[lo + i]] = _without(words, i, todo[lo + i])
                batch = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(out, texts.type))
            yield batch.drop_columns(["spans"])

    return run


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans' words taken out of its text; every row stays, untouched ones as they are.

    Spans hold for the rows of their id and text_key. Columns of any name stay.
    """
    ident, key, marks = free_names(docs.columns, "id", "key", "spans")
    by_doc = spans.groupBy(F.col("doc_id").alias(ident), F.col("text_key").alias(key))
    by_doc = by_doc.agg(F.collect_list(F.struct("first_word", "n_words")).alias(marks))
    keyed = docs.withColumns({ident: column(id_col).cast("long"), key: F.xxhash64(column(text_col))})
    # mapInArrow takes no dots in names: columns go through it by number.
    numbered = [column(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    joined = keyed.join(by_doc, [ident, key], "left").select(*numbered, F.col(marks).alias("spans"))
    text = f"c{docs.columns.index(text_col)}"
    return joined.mapInArrow(_cut(text), joined.drop("spans").schema).toDF(*docs.columns)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that repeat an earlier document, over all of ``documents``."""
    return repeated_spans(read(spark, sf_dir, "documents")).drop("text_key")
