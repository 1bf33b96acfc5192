"""Operator 11: ranked lexical search by three phases over term-partitioned posting lists (TPUT)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, read, release, scratch
from .wordhash import NOT_ALNUM, Words, as_long, buffers, chunks, lists

#: Documents by item.
TOP = 10
#: Bytes of item texts that one run over the documents holds in the driver and each Python worker.
ITEM_BYTES = 4 << 20
#: Postings that are dealt into pieces of lists at once.
SEGMENT_POSTINGS = 2_000_000
#: Documents by item and place of the ranking that are scored exactly for the lower bound of phase 1.
PROBES = 5
#: Hundredths of the bound that all lists of an item together may hold back in phase 2. Less of it
#: takes more entries from the lists and leaves fewer documents to look up.
HELD_BACK = 50
#: Documents of 2^RANGE_BITS numbers are summed in one task.
RANGE_BITS = 13
#: Candidate rows up to which their numbers are sent to all executors; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


class Queries:
    """Items as weighted lists: of each (item, term) the repeats of the term, its weight and what phase 2 may leave out."""

    def __init__(self, rows: list[tuple]):
        self.ids = sorted({i for i, _ in rows}, key=lambda x: (str(type(x)), x))
        number = {x: k for k, x in enumerate(self.ids)}
        words = Words(*buffers(pa.array([t for _, t in rows], pa.large_string())), True, NOT_ALNUM)
        self.vocabulary, term = np.unique(words.hash, return_inverse=True)
        of = np.array([number[i] for i, _ in rows], np.int64)[words.row]
        pair, self.repeats = np.unique(of * max(1, len(self.vocabulary)) + term, return_counts=True)
        self.item, self.term = np.divmod(pair, max(1, len(self.vocabulary)))

    def weigh(self, docs: int, words: int, df: np.ndarray) -> None:
        self.docs, self.words = docs, words
        weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df]
        self.weight = self.repeats * np.array(weight, np.int64)[self.term]
        self.item_at = np.searchsorted(self.item, np.arange(len(self.ids) + 1))

    def bounds(self, least: np.ndarray, most: np.ndarray) -> None:
        """Phase 2 from each item's lower bound ``least`` and each list's highest impact ``most``.

        An item's threshold is the highest one with which entries held back by
        each list, all below the threshold and no higher than the list's best,
        come to HELD_BACK hundredths of the bound at most. A list gives the
        entries that reach the lowest threshold among its items, once for all.
        ``slack`` is what an entry that a list holds back can score.
        """
        best = self.weight * most[self.term]
        threshold = np.zeros(len(self.ids), np.int64)
        for k in range(len(self.ids)):
            tops, rest = np.sort(best[self.item_at[k] : self.item_at[k + 1]]), int(least[k]) * HELD_BACK // 100 - 1
            left = len(tops)
            for x in tops.tolist():
                if left * x > rest:  # this list and all better ones hold back as much each
                    threshold[k] = max(0, rest // left + 1)
                    break
                rest, left = rest - x, left - 1
        live = self.weight > 0
        self.from_impact = np.full(len(self.vocabulary), np.iinfo(np.int64).max)
        np.minimum.at(self.from_impact, self.term[live], -(-threshold[self.item[live]] // self.weight[live]))
        self.slack = np.where(live, np.maximum(0, np.minimum(self.weight * (self.from_impact[self.term] - 1), best)), 0)
        self.open = np.zeros(len(self.ids), np.int64)
        np.add.at(self.open, self.item, self.slack)
        self.least = least

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, of documents of n terms."""
        sizes, which = np.unique(n, return_inverse=True)
        m = np.array([25 + 75 * int(x) * self.docs // self.words for x in sizes], np.int64)[which]
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _forward(vocabulary: Broadcast):
    """(row, doc_id, n, terms, tfs) of documents with terms: which of the vocabulary's they hold, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for lo, _, words in chunks(batch.column(2), True, NOT_ALNUM):
                if len(known):
                    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
                    found = np.flatnonzero(known[at] == words.hash)
                else:
                    at, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
                key, tf = np.unique(words.row[found] * max(1, len(known)) + at[found], return_counts=True)
                row, term = np.divmod(key, max(1, len(known)))
                some = np.flatnonzero(words.count)
                of = pa.array(some + lo)
                sizes = np.bincount(row, minlength=words.rows)[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(of),
                        batch.column(1).take(of),
                        pa.array(words.count[some].astype(np.int64)),
                        lists(sizes, pa.array(term.astype(np.int32))),
                        lists(sizes, pa.array(tf.astype(np.int32))),
                    ],
                    ["row", "doc_id", "n", "terms", "tfs"],
                )

    return run


def _segments(queries: Broadcast):
    """Pieces of posting lists: (term, part, rows, impacts), by falling impact, then row."""

    def piece(held: list[tuple], part: int) -> pa.RecordBatch:
        row, n, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        impact = queries.value.impacts(tf.astype(np.int64), n)
        order = np.lexsort((row, -impact, term))
        term = term[order]
        begin = np.concatenate(([0], np.flatnonzero(term[1:] != term[:-1]) + 1))
        sizes = np.diff(np.append(begin, len(term)))
        made = [
            pa.array(term[begin]), pa.array(np.full(len(begin), part, np.int32)),
            lists(sizes, pa.array(row[order])), lists(sizes, pa.array(impact[order].astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays(made, ["term", "part", "rows", "impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            row, n, terms, tfs = batch.columns
            counts = np.diff(terms.offsets.to_numpy())
            if not counts.sum():
                continue
            held.append((np.repeat(row.to_numpy(), counts), np.repeat(n.to_numpy(), counts), terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            size += int(counts.sum())
            if size >= SEGMENT_POSTINGS:
                yield piece(held, part)
                held, size = [], 0
        if held:
            yield piece(held, part)

    return run


def _fetched(queries: Broadcast):
    """(range, term, rows, impacts) of the entries that a list gives, by ranges of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = queries.value.from_impact
        for batch in batches:
            term = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
            row, impact = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            keep = np.flatnonzero(impact >= least[term])
            keep = keep[np.lexsort((term[keep], row[keep] >> RANGE_BITS))]
            if not len(keep):
                continue
            term, row, impact = term[keep], row[keep], impact[keep]
            of = row >> RANGE_BITS
            begin = np.concatenate(([0], np.flatnonzero((term[1:] != term[:-1]) | (of[1:] != of[:-1])) + 1))
            sizes = np.diff(np.append(begin, len(term)))
            made = [pa.array(of[begin]), pa.array(term[begin]), lists(sizes, pa.array((row & ((1 << RANGE_BITS) - 1)).astype(np.int32))), lists(sizes, pa.array(impact))]
            yield pa.RecordBatch.from_arrays(made, ["of", "term", "places", "impacts"])

    return run


def _bounded(queries: Broadcast):
    """(item, row, score, most) of the documents of a range that can still reach their item's bound."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        q, first = queries.value, key[0].as_py() << RANGE_BITS
        table = table.combine_chunks()
        held: dict[int, list[tuple]] = {}
        for term, places, impacts in zip(table["term"].to_pylist(), table["places"].chunk(0), table["impacts"].chunk(0), strict=True):
            held.setdefault(term, []).append((places.values.to_numpy(), impacts.values.to_numpy().astype(np.int64)))
        out: list[tuple] = []
        for item in range(len(q.ids)):
            score, known = np.zeros(1 << RANGE_BITS, np.int64), np.zeros(1 << RANGE_BITS, np.int64)
            for k in range(q.item_at[item], q.item_at[item + 1]):
                for place, impact in held.get(int(q.term[k]), ()):
                    score[place] += q.weight[k] * impact
                    known[place] += q.slack[k]
            most = score - known + q.open[item]
            left = np.flatnonzero((score > 0) & (most >= q.least[item]))
            out.append((np.full(len(left), item), left + first, score[left], most[left]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], ["item", "row", "score", "most"])

    return run


def _exact(queries: Broadcast):
    """(item, doc_id, score) of candidates, from the documents' own terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        for batch in batches:
            of, items, scores = [], [], []
            n, terms, tfs, asked = (batch.column(k) for k in range(1, 5))
            for k in range(batch.num_rows):
                term, tf = terms[k].values.to_numpy(), tfs[k].values.to_numpy().astype(np.int64)
                impact = q.impacts(tf, np.full(len(tf), n[k].as_py()))
                for item in asked[k].values.to_numpy().tolist():
                    own = slice(q.item_at[item], q.item_at[item + 1])
                    at = np.minimum(np.searchsorted(term, q.term[own]), len(term) - 1)
                    scores.append(int((q.weight[own] * impact[at] * (term[at] == q.term[own])).sum()))
                    items.append(item)
                    of.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), batch.column(0).take(pa.array(of, pa.int64())), pa.array(scores, pa.int64())], ["item", "doc_id", "score"]
            )

    return run


def _scored(forward: DataFrame, asked: DataFrame, queries: Broadcast, kind: str) -> DataFrame:
    """(item, doc_id, score) of the items asked by row, a table that is counted before it is broadcast."""
    side = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    found = forward.join(side, "row").select("doc_id", "n", "terms", "tfs", "items")
    return found.mapInArrow(_exact(queries), f"item int, doc_id {kind}, score long")


def _kth(rows: DataFrame, score: str, top: int, items: int) -> np.ndarray:
    """By item, the ``top``-th highest score of its rows, 0 if there are fewer: one number an item."""
    by = Window.partitionBy("item").orderBy(F.desc(score))
    best = rows.select("item", score, F.row_number().over(by).alias("place")).where(F.col("place") <= top)
    out = np.zeros(items, np.int64)
    for r in best.where(F.col("place") == top).collect():
        out[r["item"]] = max(0, r[score])
    return out


def _search(docs: DataFrame, queries: Queries, top: int) -> tuple[DataFrame, list[DataFrame]]:
    """(item number, rank, doc_id, score) of one block of items, and the tables to delete after use."""
    spark = docs.sparkSession
    context = spark.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"row long, doc_id {kind}, n long, terms array<int>, tfs array<int>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body")
    # The numbers hold as soon as the table is written: no later step computes them again.
    forward = scratch(numbered.mapInArrow(_forward(context.broadcast(queries.vocabulary)), shape), "forward", rows=10_000)
    size = forward.agg(F.count("*"), F.sum("n")).first()
    size = (size[0], size[1] or 1)
    queries.docs, queries.words = size
    ranked = forward.where("doc_id is not null").select("row", "n", "terms", "tfs")
    pieces = ranked.mapInArrow(_segments(context.broadcast(queries)), "term int, part int, rows array<long>, impacts array<int>")
    # Lists are dealt by term and piece, so that a term of a third of the documents spans many tasks.
    pieces = scratch(pieces.repartition("term", "part").sortWithinPartitions("term"), "postings", rows=10_000)
    held = np.zeros((2, len(queries.vocabulary)), np.int64)
    for r in pieces.groupBy("term").agg(F.sum(F.size("rows")).alias("df"), F.max(F.col("impacts")[0]).alias("most")).collect():
        held[:, r["term"]] = r["df"], r["most"]
    unnamed = forward.where("doc_id is null").select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    for r in unnamed:
        held[0, r["term"]] += r["count"]
    queries.weigh(*size, held[0])
    shared = context.broadcast(queries)
    # Phase 1: the heads of all lists name documents; the exact scores of the best give each item a lower bound.
    by = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    heads = pieces.select("term", F.explode(F.arrays_zip(F.slice("rows", 1, top).alias("row"), F.slice("impacts", 1, top).alias("impact"))).alias("x"))
    heads = heads.select("term", "x.row", "x.impact").withColumn("place", F.row_number().over(by)).where(F.col("place") <= top)
    asked = spark.createDataFrame(pd.DataFrame({"item": queries.item, "term": queries.term, "weight": queries.weight}), "item int, term int, weight long")
    partial = heads.join(asked.where("weight > 0"), "term").groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    by = Window.partitionBy("item").orderBy(F.desc("score"), "row")
    probes = partial.withColumn("place", F.row_number().over(by)).where(F.col("place") <= PROBES * top)
    probes = scratch(probes.groupBy("row").agg(F.collect_list("item").alias("items")), "probes")
    least = _kth(_scored(forward, probes, shared, kind), "score", top, len(queries.ids))
    # Phase 2: every list gives its entries above the threshold, which are summed by ranges of documents.
    queries.bounds(least, held[1])
    shared = context.broadcast(queries)
    fetched = pieces.select("term", "rows", "impacts").mapInArrow(_fetched(shared), "of long, term int, places array<int>, impacts array<int>")
    seen = fetched.groupBy("of").applyInArrow(_bounded(shared), "item int, row long, score long, most long")
    seen = scratch(seen, "seen", rows=10_000)
    better = np.maximum(least, _kth(seen, "score", top, len(queries.ids)))
    # Phase 3: the exact scores of what is left.
    limits = spark.createDataFrame(pd.DataFrame({"item": range(len(queries.ids)), "least": better}), "item int, least long")
    left = seen.join(limits, "item").where("most >= least").groupBy("row").agg(F.collect_list("item").alias("items"))
    left = scratch(left, "candidates")
    scored = _scored(forward, left, shared, kind).where("score > 0")
    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    best = scratch(best.select("item", "rank", "doc_id", "score"), "ranked")
    return best, [forward, pieces, probes, seen, left]


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by lexical score, exactly.

    Terms are runs of ASCII letters (A-Z folded), digits and all other
    characters than ASCII, compared by 64-bit hashes. With N documents that
    have terms, L terms in all and n in the document, a term of df documents
    that occurs tf times scores w * ((10^9 tf) div (1000 tf + 8 m)), w =
    floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + (75 n N) div L, once for
    each of its repeats in the item.

    Posting lists hold the items' terms only and lie in pieces by falling
    score. Phase 1 takes the first ``top`` entries of each list; the PROBES *
    ``top`` documents of the best partial sums are looked up, and the
    ``top``-th exact score is an item's lower bound. Phase 2 takes from each of
    its lists the entries above one threshold, by which a document that no list
    gives can't reach the bound. They are shuffled by ranges of documents, each
    posting once for all items. Sums, and what the lists held back, bound each
    document from both sides, and those below the bound go. Phase 3 scores the
    rest exactly from the table by document.

    Each row of ``docs`` is a document of its own, repeats too; equal scores
    follow doc_id. Rows without id count in N, L and df but have no rank; null
    and empty texts have no terms. Rows that repeat an item's id are one item of
    all their terms; items without id, text or matching document have no rows.
    Items are taken in blocks of about ``item_bytes`` of text, each in a run
    over the documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    flat = items.select(column(item_col).alias("item_id"), column(item_text_col).alias("text")).where("item_id is not null and text is not null")
    kind = flat.schema["item_id"].dataType.simpleString()
    plain = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("body"))
    blocks, out = max(1, -(-(flat.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes)), []
    for b in range(blocks):
        rows = [tuple(r) for r in flat.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        queries = Queries(rows)
        best, tables = _search(plain, queries, top)
        release(*tables)
        names = spark.createDataFrame([(k, x) for k, x in enumerate(queries.ids)], f"item int, item_id {kind}")
        out.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``."""
    return lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Every document that shares a term with an item, scored and ranked.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), totals AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term, N),
q AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, term
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(repeats * df.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * N) // L)))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN d USING (r), totals WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
