"""Operator 3: bottom-k document fingerprints, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Hashes kept of a document's shingles.
K = 128
SHINGLE_WORDS = 5
_MOST_RANGES = 16384


def _bound(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, words: int = SHINGLE_WORDS) -> Column:
    """The k least 64-bit hashes of the distinct word shingles, ascending (``array<bigint>``).

    Words are runs without white space, lower-cased; a shorter text is one
    shingle. Null and wordless texts give an empty sketch.
    """
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(
            F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))),
        )
        return F.when(n > 0, full).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(_bound(hashed, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A & B| / |A | B|; exact while the union has at most k shingles. Two empty sets: 1."""
    both = F.array_intersect(a, b)
    share = _bound(merge(a, b, k), lambda u: F.size(F.array_intersect(u, both)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of |A|: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A & B| / |A|, between 0 and 1; an empty A is contained."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(shared / distinct_shingles(a, k), F.lit(1.0)))


def merge_parts(parts: DataFrame, key: str, sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """(key, sketch) of the union over each key's parts, in any number and order.

    Hashes are ranked within (key, salt) first, k kept of each, and then within
    the key, so a key with a third of all parts has at most ``salts * k``
    hashes in a task. Empty parts give an empty sketch; a null key is a key.
    """
    each = parts.select(key, F.explode_outer(sketch_col).alias("h")).distinct()
    each = each.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    for by in ((key, "salt"), (key,)):
        ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("h"))))
        each = ranked.where(F.col("r") <= k).drop("r")
    return each.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))


def _ranges(docs: DataFrame, parts: int) -> tuple[list[int], int]:
    """Bounds of about equal ranges of ids (at most ``parts``, a bounded list), and the step of its coarse level."""
    if parts < 2:
        return [], 1
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    row = docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10000, 20 * parts))).alias("q")).first()
    bounds = sorted(set(row.q or []))
    return bounds, max(1, math.isqrt(len(bounds)))


def _range_of(doc_id: Column, bounds: list[int], step: int) -> Column:
    """Number of bounds not above the id, looked up in two levels."""
    if not bounds:
        return F.lit(0)
    fine = F.array(*map(F.lit, bounds)) if len(bounds) > 1 else F.array(F.lit(bounds[0]))
    coarse = F.array(*map(F.lit, bounds[::step]))
    c = F.size(F.filter(coarse, lambda b: b <= doc_id))
    rest = F.size(F.filter(F.slice(fine, (c - 1) * step + 1, F.lit(step)), lambda b: b <= doc_id))
    return F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + rest)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, part, last, sketch, next_text, next_sketch): each with its follower by descending id.

    Ids are dealt in ranges, so texts move once; the first row of each range is
    also a closing row of the range before it, and that of the highest range of
    the lowest one. Null ids come last; equal ids follow each other by hash of text.
    """
    bounds, step = _ranges(docs, parts)
    placed = docs.withColumn("part", _range_of(F.col("doc_id"), bounds, step).cast("int"))
    tops = placed.groupBy("part").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.asc("part"))  # one row a range: at most `parts`
    edges = tops.select("top", F.lead("part").over(order).alias("up"), F.min("part").over(Window.partitionBy()).alias("low"))
    edges = edges.select("top", F.coalesce("up", "low").alias("also"))
    both = placed.join(F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    spread = F.array(
        F.struct(F.col("part").alias("part"), F.lit(0).alias("last")),
        F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("part"), F.lit(1).alias("last"))),
    )
    rows = both.select("doc_id", "text", F.explode(F.array_compact(spread)).alias("at")).select("doc_id", "text", "at.*")
    follow = Window.partitionBy("part").orderBy("last", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(follow)).withColumn("sketch", sketch(F.col("text")))
    return rows.withColumn("next_sketch", F.lead("sketch").over(follow)).where("last = 0")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each whole text, of its edited form, and their likeness; one row a row.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next document by descending id; after the last
    comes the first, and a lone document is its own next. Null texts are empty;
    an empty set is like an empty set only. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    parts = min(_MOST_RANGES, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(plain, parts)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("*", sketch(F.col("edited")).alias("es"), F.sha2("edited", 256).alias("edited_sha256"))
    text = lambda c: F.array_join(F.transform(c, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("sketch").alias("fingerprint"),
        text("es").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("es")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("es"), F.col("sketch")).alias("edited_in_text"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents``."""
    return fingerprints(read(spark, sf_dir, "documents"))
