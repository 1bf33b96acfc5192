"""Operator 12: benchmark passages in documents, by suffix arrays of the documents searched for every benchmark suffix."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read
from .wordhash import NOT_ALNUM, Words, buffers, chunks

#: Consecutive words of an item that count as taken from it.
WINDOW = 10
#: Bytes of item texts that one pass over the documents holds in each Python worker.
ITEM_BYTES = 16 << 20
#: Bytes of document text under one suffix array, one longer document apart.
SHARD_BYTES = 8 << 20


class Needles:
    """A block of benchmark items: their words as numbers, one after another, and what starts at each place.

    ``seq`` holds numbers from 1, with a 0 behind each item; ``left`` the words
    of the item from a place on; ``width`` the words of the window that starts
    there (0: none). ``need`` gives, by word number, the least width of a
    window that starts with the word.
    """

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words = Words(*buffers(pa.array(texts, pa.large_string())), True, NOT_ALNUM)
        self.vocabulary, code = np.unique(words.hash, return_inverse=True)
        size = int(words.count.sum())
        at = np.arange(size) + words.row  # one place free behind each item
        self.seq = np.zeros(size + len(ids) + 1, np.int64)
        self.seq[at] = code + 1
        rest = (words.first + words.count)[words.row] - np.arange(size)
        self.left, self.width = np.zeros(len(self.seq), np.int64), np.zeros(len(self.seq), np.int64)
        self.left[at] = rest
        whole = np.minimum(words.count, window)[words.row]
        self.width[at] = np.where(rest >= whole, whole, 0)
        self.width[at[(words.count[words.row] < window) & (rest < words.count[words.row])]] = 0
        self.item = np.zeros(len(self.seq), np.int64)
        self.item[at] = words.row
        self.start = words.first + np.arange(len(ids))
        self.ids = ids
        self.suffixes = at
        self.depth = int(words.count.max(initial=0))
        self.need = np.full(len(self.vocabulary) + 1, np.iinfo(np.int64).max)
        begins = at[self.width[at] > 0]
        np.minimum.at(self.need, self.seq[begins], self.width[begins])
        # Windows of equal words have one number, so that each is located once.
        of: dict[bytes, int] = {}
        self.window = np.full(len(self.seq), -1, np.int64)
        self.items_of: dict[int, list[int]] = defaultdict(list)
        for p in begins.tolist():
            k = of.setdefault(self.seq[p : p + self.width[p]].tobytes(), len(of))
            self.window[p] = k
            self.items_of[k].append(int(self.item[p]))


class Shard:
    """The suffix array of a run of documents, over the places where a match may start.

    Words that no item holds end a match, so the array is built over the runs
    of known words in which some window could start and fit; no occurrence of a
    window lies elsewhere. Suffixes are sorted by prefix doubling, as deep as
    the longest item.
    """

    def __init__(self, words: Words, needles: Needles, least: int | None = None):
        n = len(words.hash)
        at = np.searchsorted(needles.vocabulary, words.hash)
        at[at == len(needles.vocabulary)] = 0
        known = needles.vocabulary[at] == words.hash if len(needles.vocabulary) else np.zeros(n, bool)
        code = np.where(known, at + 1, 0)
        # Maximal runs of known words within a document.
        first = known.copy()
        first[1:] &= ~known[:-1] | (words.row[1:] != words.row[:-1])
        begin = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        length = np.bincount(run[known], minlength=len(begin))
        left = np.zeros(n, np.int64)
        left[known] = (begin + length)[run[known]] - np.flatnonzero(known)
        need = needles.need[code] if least is None else np.full(n, least)
        fits = np.flatnonzero(known & (left >= need))
        used = np.zeros(len(begin), bool)
        used[run[fits]] = True
        keep = known.copy()
        keep[known] = used[run[known]]
        self.place = np.flatnonzero(keep)  # of each kept word in the shard
        gap = np.cumsum(first[self.place]) - 1  # a 0 behind each run
        where = np.arange(len(self.place)) + gap
        self.seq = np.zeros(len(self.place) + (int(gap[-1]) if len(gap) else 0) + 2, np.int64)
        self.seq[where] = code[self.place]
        self.word = np.zeros(len(self.seq), np.int64)
        self.word[where] = self.place
        self.order = self._sorted(where, left[self.place], needles.depth)
        self.head = self.seq[self.order]

    def _sorted(self, where: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
        rank, step = self.seq.copy(), 1
        while step < depth and len(where):
            after = np.where(left > step, rank[np.minimum(where + step, len(rank) - 1)], 0)
            value, place = np.unique(rank[where] * (rank.max() + 1) + after, return_inverse=True)
            rank[where] = place + 1
            step *= 2
            if len(value) == len(where):
                break
        return where[np.argsort(rank[where], kind="stable")]

    def common(self, at: np.ndarray, needles: Needles, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words of the suffixes at ``at`` and the items from ``q`` on, ``limit`` at most."""
        out = np.zeros(len(q), np.int64)
        active = np.arange(len(q))
        while len(active):
            j = out[active]
            same = (j < limit[active]) & (self.seq[np.minimum(at[active] + j, len(self.seq) - 1)] == needles.seq[q[active] + j])
            active = active[same]
            out[active] += 1
        return out

    def bound(self, needles: Needles, q: np.ndarray, limit: np.ndarray, past: bool) -> np.ndarray:
        """By binary search, how many suffixes lie before the items from ``q`` on, of ``limit`` words; with ``past`` also those that begin with them."""
        lo = np.searchsorted(self.head, needles.seq[q], "left")
        hi = np.searchsorted(self.head, needles.seq[q], "right")
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            at, of, most = self.order[mid], q[open_], limit[open_]
            j = self.common(at, needles, of, most)
            end = j == most
            less = ~end & (self.seq[at + j] < needles.seq[of + np.minimum(j, most - 1)])
            right = less | end if past else less
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def longest(self, needles: Needles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(benchmark suffix, its longest match in words, a place of it) of every suffix that matches a word or more."""
        q = needles.suffixes
        q = q[np.isin(needles.seq[q], self.head)]
        if not len(q):
            return q, q, q
        limit = needles.left[q]
        at = self.bound(needles, q, limit, False)
        best, where = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for side in (at, at - 1):  # the suffix with the longest common prefix is a neighbour
            inside = np.flatnonzero((side >= 0) & (side < len(self.order)))
            j = self.common(self.order[side[inside]], needles, q[inside], limit[inside])
            more = j > best[inside]
            best[inside[more]], where[inside[more]] = j[more], self.order[side[inside[more]]]
        keep = best > 0
        return q[keep], best[keep], self.word[where[keep]]

    def located(self, needles: Needles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of a window, word at which it occurs, its width), each occurrence once."""
        none = np.zeros(0, np.int64)
        if not len(self.order):
            return none, none, none
        q, best, _ = self.longest(needles)
        q = q[(needles.width[q] > 0) & (best >= needles.width[q])]
        number, first = np.unique(needles.window[q], return_index=True)
        q = q[first]
        lo = self.bound(needles, q, needles.width[q], False)
        size = self.bound(needles, q, needles.width[q], True) - lo
        each = np.repeat(np.arange(len(q)), size)
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return number[each], self.word[self.order[at]], needles.width[q][each]


def needle_blocks(items: DataFrame, id_col: str, text_col: str, window: int, size: int) -> list[Broadcast]:
    """Broadcasts of the items with text, about ``size`` bytes each; ids as text, rows without id left out.

    Blocks follow a hash of the row. The driver holds one at a time.
    """
    flat = items.select(column(id_col).cast("string").alias("item"), column(text_col).alias("body"))
    flat = flat.where("item is not null and body is not null")
    count = max(1, -(-(flat.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // size))
    out = []
    for b in range(count):
        pairs = sorted(map(tuple, flat.where(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == b).collect()))
        out.append(items.sparkSession.sparkContext.broadcast(Needles([i for i, _ in pairs], [t for _, t in pairs], window)))
    return out


_FOUND = "spans array<struct<first_word:int,n_words:int>>, items array<string>"


def _matches(needles, keep: int):
    """Appends to each row's columns the number of its words, the spans taken from items and the items' ids.

    The text is the last column but isn't returned; the first ``keep`` are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = needles.value
        for batch in batches:
            counts, spans, items = [], [None] * batch.num_rows, [None] * batch.num_rows
            for lo, _, words in chunks(batch.column(keep), True, NOT_ALNUM, SHARD_BYTES):
                counts.append(words.count)
                number, at, width = Shard(words, block).located(block)
                row = words.row[at]
                order = np.lexsort((at, row))
                number, at, width, row = number[order], at[order], width[order], row[order]
                for i, a, b in zip(*_runs(row), strict=True):
                    start = at[a:b] - words.first[i]
                    end = np.maximum.accumulate(start + width[a:b])
                    cut = np.flatnonzero(start[1:] > end[:-1]) + 1
                    heads = np.concatenate(([0], cut))
                    tails = np.concatenate((cut, [b - a])) - 1
                    spans[lo + i] = [{"first_word": int(start[h]), "n_words": int(end[t] - start[h])} for h, t in zip(heads, tails, strict=True)]
                    items[lo + i] = sorted({block.ids[x] for k in np.unique(number[a:b]).tolist() for x in block.items_of[k]})
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))
            made = [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            names = [*batch.schema.names[:keep], "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *made], names)

    return run


def _runs(row: np.ndarray):
    """(value, begin, end) of runs of equal values."""
    if not len(row):
        return [], [], []
    begin = np.concatenate(([0], np.flatnonzero(row[1:] != row[:-1]) + 1))
    return row[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(row)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of the spans and items that several blocks of items gave a document."""
    for batch in batches:
        spans, items = [], []
        for found, names in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            out: list[list[int]] = []
            for a, n in sorted((s["first_word"], s["n_words"]) for x in found for s in x):
                if out and a <= out[-1][0] + out[-1][1]:
                    out[-1][1] = max(out[-1][1], a + n - out[-1][0])
                else:
                    out.append([a, n])
            spans.append([{"first_word": a, "n_words": n} for a, n in out] or None)
            items.append(sorted({i for x in names for i in x}) or None)
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))
        made = [pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made, batch.column(5)], ["doc_id", "n_words", "spans", "items", "copies"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(doc_id, n_words, spans, items), one row a document: what it shares with benchmark items, word for word.

    Words are runs of ASCII letters (A-Z folded), digits and all other
    characters than ASCII. A window is ``window`` consecutive words of an item,
    or the whole of an item of fewer. ``spans`` are the unions of the
    document's words under occurrences of windows, ``items`` the ids (as text,
    sorted) of items with a window that occurs; both are null where none does.

    Each Python worker builds suffix arrays over SHARD_BYTES of documents and
    searches them for every suffix of the items; nothing is shuffled. Words are
    compared by 64-bit hashes. Items are broadcast, at most about
    ``item_bytes`` of text at a time; more of them take a pass over the
    documents for each such block, whose results are merged by document.

    Null and empty texts have no words and no spans. Rows are documents of
    their own: rows that repeat an id, or have none, each have a row. Items
    without id or without words match nothing; items that repeat an id are one
    item of several texts. Without items all spans are null. Other columns of
    either table are ignored. An empty table gives no rows.
    """
    plain = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    blocks = needle_blocks(items, item_col, item_text_col, window, item_bytes)
    if len(blocks) == 1:
        return plain.mapInArrow(_matches(blocks[0], 1), f"doc_id {kind}, n_words long, {_FOUND}")
    keyed = plain.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    passes = None
    for k, needles in enumerate(blocks):
        found = keyed.mapInArrow(_matches(needles, 2), f"doc_id {kind}, text_key long, n_words long, {_FOUND}")
        found = found.withColumn("first", F.lit(k == 0)).where("first or spans is not null")
        passes = found if passes is None else passes.unionByName(found)
    own = passes.groupBy("doc_id", "text_key", "n_words").agg(
        F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"), F.count_if("first").alias("copies")
    )
    merged = own.mapInArrow(_merged, f"doc_id {kind}, n_words long, {_FOUND}, copies long")
    return merged.select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def longest_matches(
    docs: DataFrame,
    items: DataFrame,
    least: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item_id, item_word, n_words, doc_id, doc_word): the longest verbatim match of each item suffix and where it lies.

    One row for each word of an item from which ``least`` words or more occur
    in a document: as many of them as any document holds, and the document
    (smallest id, then place) that does. Each shard offers its longest match by
    suffix, and these are reduced over all shards. Ids of items are text.
    Nulls, repeats and other columns as in ``contamination``; rows without id
    are left out.
    """
    out = None
    plain = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).where("doc_id is not null")
    kind = plain.schema["doc_id"].dataType.simpleString()
    shape = f"item_id string, item_word int, n_words int, doc_id {kind}, doc_word int"
    for needles in needle_blocks(items, item_col, item_text_col, 1, item_bytes):

        def run(batches: Iterator[pa.RecordBatch], needles=needles) -> Iterator[pa.RecordBatch]:
            block = needles.value
            for batch in batches:
                for lo, _, words in chunks(batch.column(1), True, NOT_ALNUM, SHARD_BYTES):
                    shard = Shard(words, block, least)
                    if not len(shard.order):
                        continue
                    q, best, at = shard.longest(block)
                    q, best, at = q[best >= least], best[best >= least], at[best >= least]
                    item, row = block.item[q], words.row[at]
                    made = [
                        pa.array([block.ids[i] for i in item.tolist()], pa.string()), pa.array(q - block.start[item], pa.int32()),
                        pa.array(best, pa.int32()), batch.column(0).take(pa.array(row + lo)), pa.array(at - words.first[row], pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(made, ["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        found = plain.mapInArrow(run, shape)
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "doc_id", "doc_word")).alias("best")
    best = out.groupBy("item_id", "item_word").agg(best)
    return best.select("item_id", "item_word", (-F.col("best.less")).alias("n_words"), "best.doc_id", "best.doc_word")


def remove_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """The rows of ``docs`` that share no window with an item; see ``contamination``. Columns of any name stay."""
    out, numbered = docs, [f"c{k}" for k in range(len(docs.columns))]
    for needles in needle_blocks(items, item_col, item_text_col, window, item_bytes):
        flat = out.toDF(*numbered).withColumn("text", F.col(numbered[docs.columns.index(text_col)]))
        more = {"n_words": "long", "spans": "array<struct<first_word:int,n_words:int>>", "items": "array<string>"}
        shape = flat.drop("text").withColumns({k: F.lit(None).cast(t) for k, t in more.items()}).schema
        out = flat.mapInArrow(_matches(needles, len(numbered)), shape).where("spans is null").select(*numbered).toDF(*docs.columns)
    return out


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every whole text of ``documents`` against ``benchmark``."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"]), F.lit(0).cast("long"))
    named = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: Each window as text at each place of each document, joined with the items' windows.
SQL = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS words
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0
), dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), places AS (
  SELECT r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS words
  FROM dw, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(k)
), hits AS (SELECT r, k, n, item_id FROM places JOIN windows USING (n, words)),
covered AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, n FROM hits), unnest(range(0, n)) AS t(j) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
