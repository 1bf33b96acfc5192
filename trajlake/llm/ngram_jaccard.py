"""Operator 6: n-gram Jaccard similarity join with rare-first prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read, release, scratch
from .components import connected_components
from .wordhash import U, as_long, chunks, lists, mix, sets

#: Counters of the frequency sketch that orders shingles (2**ORDER_BITS, a fixed size).
ORDER_BITS = 20
_PIECE = 1 << 14
_BINS = 16


def _digest(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each row's set, from an order-free sum of mixed members."""
    total = np.zeros(len(value) + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(mix(value ^ U(0xA0761D6478BD642F)), out=total[1:])
        cut = np.searchsorted(row, np.arange(rows + 1))
        size = np.diff(cut).astype(U)
        return mix(total[cut[1:]] - total[cut[:-1]] + size * U(0xE7037ED1A0B428DB))


def _survey(n: int):
    """Per document: set size and set digest; per task: its part of the frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, dtype=np.int64)
        for batch in batches:
            for lo, hi, words in chunks(batch.column(1)):
                row, value = sets(words, n)
                size = np.bincount(row, minlength=hi - lo)
                counts += np.bincount((value & U(len(counts) - 1)).astype(np.int64), minlength=len(counts))
                m = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, m),
                        batch.column(2).slice(lo, m),
                        pa.array(size, pa.int64()),
                        as_long(_digest(row, value, m)),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.binary()),
                    ],
                    ["doc_id", "text_key", "size", "node", "piece", "counts"],
                )
        pieces = [
            (i, part.astype("<i8").tobytes())
            for i, part in enumerate(counts.reshape(-1, _PIECE))
            if part.any()
        ]
        k = len(pieces)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.nulls(k, pa.int64()) for _ in range(4)),
                pa.array([i for i, _ in pieces], pa.int32()),
                pa.array([b for _, b in pieces], pa.binary()),
            ],
            ["doc_id", "text_key", "size", "node", "piece", "counts"],
        )

    return run


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch parts of a task, at most one row a piece."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(b, "<i8")
            total[i] = total[i] + part if i in total else part
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(total), pa.int32()),
            pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary()),
        ],
        ["piece", "counts"],
    )


def _order(survey: DataFrame) -> np.ndarray:
    """Rank of each sketch bucket, about 8 log2 of its count: a byte for each of 2**ORDER_BITS."""
    parts = survey.where("piece is not null").select("piece", "counts").repartition("piece")
    counts = np.zeros(1 << ORDER_BITS, dtype=np.int64)
    for piece, part in parts.mapInArrow(_add_pieces, "piece int, counts binary").collect():
        counts[piece * _PIECE : (piece + 1) * _PIECE] = np.frombuffer(part, "<i8")
    return np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)


def _prefixes(n: int, num: int, den: int, rank):
    """Per document: digest, prefix shingles rarest first, commonness, sizes by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in batches:
            for lo, hi, words in chunks(batch.column(1)):
                m = hi - lo
                row, value = sets(words, n, order)
                size = np.bincount(row, minlength=m)
                by_value = np.lexsort((value, row))
                node = _digest(row, value[by_value], m)
                common = np.bincount(row, order[(value & U(len(order) - 1)).astype(np.int64)], minlength=m)
                bins = np.bincount(row * _BINS + (value >> U(60)).astype(np.int64), minlength=m * _BINS)
                width = size - (num * size + den - 1) // den + 1
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row]
                short = place < width[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, m),
                        as_long(node),
                        pa.array(size, pa.int64()),
                        pa.array(100 * common / np.maximum(size, 1)).cast(pa.int64(), safe=False),
                        lists(np.full(m, _BINS), pa.array(bins, pa.int32())),
                        lists(np.bincount(row[short], minlength=m), as_long(value[short])),
                    ],
                    ["doc_id", "node", "size", "common", "bins", "prefix"],
                )

    return run


def _own(n: int):
    """Keeps the rows whose text has the digest asked for (an id may repeat with other text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, words in chunks(batch.column(1)):
                row, value = sets(words, n)
                mine = _digest(row, value, hi - lo).view(np.int64) == wanted[lo:hi]
                yield batch.slice(lo, hi - lo).filter(pa.array(mine))

    return run


def _verify(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            for lo in range(0, batch.num_rows, 64):
                m = min(64, batch.num_rows - lo)
                both = []
                for column in (2, 3):
                    rows, values = [], []
                    for a, _, words in chunks(batch.column(column).slice(lo, m)):
                        row, value = sets(words, n)
                        rows.append(row + a)
                        values.append(value)
                    both.append((np.concatenate(rows), np.concatenate(values)))
                row, value = (np.concatenate([x[i] for x in both]) for i in (0, 1))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                shared = np.bincount(row[1:][same], minlength=m)
                union = np.bincount(row, minlength=m) - shared
                linked[lo : lo + m] = (den * shared >= num * union) & (union > 0)
            yield batch.select([0, 1]).filter(pa.array(linked))

    return run


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    num: int = 80,
    den: int = 100,
) -> DataFrame:
    """(doc_id, text_key, n_shingles, class_id, component_id) for every row of ``docs``.

    Documents link when ``den * |A & B| >= num * |A | B|`` over their sets of
    ``words``-word shingles; component_id is the smallest id reachable. Equal
    sets form one class, class_id its smallest id, and only classes are
    compared: (1) a fixed-size frequency sketch over all documents gives one
    global order, rarest shingles first; (2) prefix shingles held by two or
    more classes are the postings; (3) members of a posting are compared with
    its most common-looking member of like size, which joins large groups by
    as many pairs as they have members; (4) what is then still in different
    components is compared exhaustively, under length, positional and suffix
    (hash-range count) filters, each pair verified once on the whole texts.
    So the result is that of all links, without listing all pairs of a group.

    Null or wordless texts have no shingle and link with nothing. A row with a
    null id joins the class of equal sets but is never its name, and alone it
    links with nothing. Rows that repeat an id keep a row each, told apart by
    ``text_key``, xxhash64 of the text. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    keyed = plain.withColumn("text_key", F.xxhash64("text"))
    shape = "doc_id long, text_key long, size long, node long, piece int, counts binary"
    survey = scratch(keyed.mapInArrow(_survey(words), shape), "survey")
    rank = spark.sparkContext.broadcast(_order(survey))
    every = scratch(survey.where("piece is null").select("doc_id", "text_key", "size", "node"), "sizes")
    release(survey)
    classes = scratch(every.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("class_id")), "classes")

    profile = plain.mapInArrow(
        _prefixes(words, num, den, rank),
        "doc_id long, node long, size long, common long, bins array<int>, prefix array<long>",
    ).where("size > 0")
    first = classes.select("node", F.col("class_id").alias("doc_id"))
    profile = scratch(profile.join(first, ["node", "doc_id"], "left_semi"), "profile")
    long = profile.select("node", "size", "common", F.posexplode("prefix").alias("pos", "token"))
    shared = long.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    postings = scratch(long.join(shared.select("token"), "token"), "postings")
    active = postings.select("node").distinct().join(profile.select("node", "doc_id", "size", "bins"), "node")
    active = scratch(active.dropDuplicates(["node"]), "active")
    texts = plain.join(active.select("node", "doc_id"), "doc_id").select("node", "text")
    texts = scratch(texts.mapInArrow(_own(words), "node long, text string"), "texts")
    release(profile)

    need = F.expr(f"({num} * (x_size + y_size) + {num + den - 1}) div {num + den}")
    sized = F.expr(f"{den} * least(x_size, y_size) >= {num} * greatest(x_size, y_size)")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) that link, of candidate pairs."""
        pairs = pairs.distinct()
        for side in ("x", "y"):
            about = active.select(
                F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("bins").alias(f"{side}_bins")
            )
            pairs = pairs.join(about, side)
        most = F.aggregate(
            F.zip_with("x_bins", "y_bins", lambda a, b: F.least(a, b)), F.lit(0), lambda acc, v: acc + v
        )
        pairs = scratch(pairs.where(sized & (most >= need)).select("x", "y"), "pairs")
        slim = pairs
        for side in ("x", "y"):
            slim = slim.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text")), side)
        out = slim.select("x", "y", "x_text", "y_text").mapInArrow(_verify(words, num, den), "x long, y long")
        out = scratch(out, "links")
        release(pairs)
        return out

    step = float(np.log(den / num)) if num < den else 1e-9
    stratum = F.floor(F.log(F.col("size").cast("double")) / F.lit(step))
    placed = postings.withColumn("s", F.explode(F.array(stratum, stratum + 1)))
    pivot = placed.groupBy("token", "s").agg(
        F.max(F.struct("common", "node")).alias("top"), F.min("node").alias("low")
    )
    star = (
        placed.join(pivot, ["token", "s"])
        .select("node", F.explode(F.array("top.node", "low")).alias("other"))
        .where("node <> other")
        .select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y"))
    )
    links = verified(star)
    labels = connected_components(links, "x", "y")

    known = scratch(
        postings.join(labels, "node", "left").select(
            "token", "pos", "node", "size", F.coalesce("root", "node").alias("root")
        ),
        "known",
    )
    release(postings, labels)
    by_root = known.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("token").agg(
        F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")
    )
    main = main.where("roots > 1").select("token", F.col("main.root").alias("main"))
    rest = (
        known.join(main, "token")
        .where("root <> main")
        .select("token", "main", *(F.col(c).alias(f"x_{c}") for c in ("pos", "node", "size", "root")))
    )
    other = known.select("token", *(F.col(c).alias(f"y_{c}") for c in ("pos", "node", "size", "root")))
    fits = F.least(F.expr("x_size - x_pos"), F.expr("y_size - y_pos")) >= need
    across = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
    cross = (
        rest.join(other, "token")
        .where(across & sized & fits)
        .select(F.least("x_node", "y_node").alias("x"), F.greatest("x_node", "y_node").alias("y"))
    )
    more = verified(cross)
    labels = connected_components(links.unionByName(more), "x", "y")
    release(known, active, texts, links, more)

    named = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch(named, "named")
    release(classes, labels)
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "root").select("node", "class_id", "component_id")
    return (
        every.join(named.withColumnRenamed("node", "n"), (F.col("node") == F.col("n")) & (F.col("size") > 0), "left")
        .select(
            "doc_id",
            "text_key",
            F.col("size").alias("n_shingles"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 3-word shingles and Jaccard 0.9 over all of ``documents``."""
    out = jaccard_components(read(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id", "class_id")
