"""Operator 9: near-duplicate embeddings by random-hyperplane hashing and exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read, release, scratch
from .components import connected_components

#: A pair at the threshold meets in some table with this probability, closer pairs with more.
RECALL = 0.98
#: Vectors that share a bucket on average, were they spread evenly: the sign bits of a table follow.
BUCKET = 512
#: Vectors of a bucket that are compared in one piece; larger buckets are dealt as pairs of pieces.
PIECE = 2048
SEED = 20240229


#: Tables and sign bits that a bucket's number has room for. Where a threshold asks for more tables, fewer bits make up
#: for it: buckets grow, and as pieces of them are compared whole, the recall stays.
MOST_TABLES, MOST_BITS = 1024, 32


def tables_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(sign bits a table, tables) for ``n`` vectors, with which a pair at the threshold meets with probability ``recall``.

    Bits grow with log2 n, so that a bucket's size and the comparisons a
    vector has don't. Two vectors at the threshold agree in a sign with
    probability 1 - angle / pi; so many tables make up for all bits agreeing.
    Without bits all vectors are one bucket.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    for bits in range(min(MOST_BITS, max(4, math.ceil(math.log2(max(n, 1) / BUCKET)))), 0, -1):
        meet = agree**bits
        if meet >= recall:
            return bits, 1
        tables = math.log(1 - recall) / math.log1p(-meet) if meet > 1e-12 else math.inf
        if tables <= MOST_TABLES:
            return bits, math.ceil(tables)
    return 0, 1


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _place(bits: int, tables: int, payload: bool):
    """Per table a row: its bucket and, if asked for, the vector with all its signatures.

    Vectors that single precision holds exactly travel as such; they are compared in double.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(lengths)))
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                raw = values[begin[at][:, None] + np.arange(dim)]
                signs = (_unit(raw) @ _planes(dim, bits, tables) > 0).reshape(len(at), tables, bits)
                code = signs @ weight
                bucket = (np.int64(dim) << 42) + (np.arange(tables, dtype=np.int64) << 32) + code
                if not payload:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel())], ["bucket"])
                    continue
                ids = batch.column(0).take(pa.array(at))
                copies = batch.column(2).take(pa.array(at))
                codes = pa.array([c.astype("<u4" if bits > 16 else "<u2").tobytes() for c in code], pa.binary())
                exact = (raw.astype("<f4") == raw).all(axis=1)
                vector = [v.astype("<f4" if e else "<f8").tobytes() for v, e in zip(raw, exact, strict=True)]
                vector = pa.array(vector, pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[:, t]), ids, copies, codes, vector],
                        ["bucket", "id", "copies", "codes", "vector"],
                    )

    return run


def _pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal leading columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of each pair; ``root`` stays flat, the least number of a tree being its root."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(flat := root[root], root):
            root[:] = flat


def _compare(threshold: float, bits: int):
    """Links inside a piece or between two: per vector how many, and a forest of links.

    A pair counts in the first table where it meets, which the signatures tell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_of in _pieces(batches, 3):
            table = pa.Table.from_batches(run_of)
            if table.num_rows < 2:
                continue
            part = table.column("part").to_numpy()
            lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            bucket = table.column("bucket")[0].as_py()
            dim, tab = bucket >> 42, bucket >> 32 & (MOST_TABLES - 1)
            ids = table.column("id").to_numpy()
            copies = table.column("copies").to_numpy()
            codes = np.stack([np.frombuffer(x, "<u4" if bits > 16 else "<u2") for x in table.column("codes").to_pylist()])
            vector = table.column("vector").to_pylist()
            unit = _unit(np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8").astype(float) for x in vector]))
            left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
            count = np.zeros(len(ids), dtype=np.int64)
            root = np.arange(len(ids))
            for a in range(0, len(left), 256):
                rows = left[a : a + 256]
                near = unit[rows] @ unit[right].T >= threshold
                i, j = np.nonzero(near)
                i, j = rows[i], right[j]
                keep = (ids[i] < ids[j]) if lo == hi else (ids[i] != ids[j])
                i, j = i[keep], j[keep]
                for before in range(tab):
                    if not len(i):
                        break
                    new = codes[i, before] != codes[j, before]
                    i, j = i[new], j[new]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                _merge(root, i, j)
            touched = np.flatnonzero(count)
            if len(touched):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[touched]),
                        pa.array(ids[root[touched]]),
                        pa.array(count[touched]),
                    ],
                    ["id", "other", "links"],
                )

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    bits: int | None = None,
    tables: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Equal vectors are one class and are looked up once. Class vectors are
    hashed by the signs of ``bits`` random projections in each of ``tables``
    tables (without them, as ``tables_for`` says for their number); those that meet are compared by exact cosine in double precision,
    so no link is below the threshold and links well above it are all found.
    A bucket of more than PIECE vectors is dealt as pairs of pieces, so a task
    holds two pieces at most, and gives counts and a spanning forest instead
    of pairs. n_links counts vectors, copies included.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing. Vectors of different length don't link. Rows that repeat an
    id count as vectors of their own. A null id keeps its row and is never the
    name of a component with others. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = column(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    # -0.0 becomes 0.0, so equal vectors are equal keys
    plain = vectors.select(column(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("v"))
    plain = scratch(plain.withColumn("ok", F.coalesce(usable, F.lit(False))), "vectors")
    classes = plain.where("ok").groupBy("v").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"))
    classes = scratch(classes.withColumn("id", F.xxhash64("v")), "classes")
    if bits is None or tables is None:
        bits, tables = tables_for(classes.count(), threshold)
    source = classes.select("id", "v", "copies")
    buckets = source.mapInArrow(_place(bits, tables, False), "bucket long")
    # At most tables * 2**bits rows a vector length, whatever the number of vectors.
    large = buckets.groupBy("bucket").count().where(F.col("count") > PIECE)
    placed = source.mapInArrow(
        _place(bits, tables, True), "bucket long, id long, copies long, codes binary, vector binary"
    )
    spread = placed.join(F.broadcast(large), "bucket", "left")
    spread = spread.withColumn("m", F.coalesce(F.ceil(F.col("count") / PIECE), F.lit(1)).cast("int"))
    spread = spread.withColumn("part", F.pmod(F.col("id"), F.col("m")).cast("int"))
    spread = spread.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    spread = spread.select(
        "bucket", F.least("part", "against").alias("lo"), F.greatest("part", "against").alias("hi"),
        "part", "id", "copies", "codes", "vector",
    )
    spread = spread.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    found = scratch(spread.mapInArrow(_compare(threshold, bits), "id long, other long, links long"), "found")
    labels = connected_components(found, "id", "other")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    about = classes.join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    about = scratch(
        about.select("v", "name", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")),
        "about",
    )
    release(classes, found, labels)
    least = about.groupBy("root").agg(F.min("name").alias("component"))
    about = about.join(least, "root").select(F.col("v").alias("w"), "copies", "links", "component")
    out = plain.join(about, (F.col("v") == F.col("w")) & F.col("ok"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 over all of ``embeddings``, whatever their labels."""
    return near_vectors(read(spark, sf_dir, "embeddings"))
