"""Operator 13: how far the word use of a source lies from other sources' and from its language's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, read, scratch
from .wordhash import NOT_ALPHA, chunks

#: Documents of a language that a kept term must be in.
LEAST_DOCS = 3
#: Ranks of terms that are returned by group.
TOP_TERMS = 200
#: Shares are whole numbers of this unit.
UNIT = 1_000_000_000
#: Bytes of text whose terms are counted at once, one longer document apart.
COUNT_BYTES = 16 << 20


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, uses, docs) of runs of documents: each term is told apart by its own text."""
    for batch in batches:
        for lo, hi, words in chunks(batch.column(2), True, NOT_ALPHA, COUNT_BYTES):
            if not len(words.start):
                continue
            terms = words.strings().dictionary_encode()
            lang, source = (batch.column(k).slice(lo, hi - lo).dictionary_encode() for k in (0, 1))
            width = len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
            at, uses = np.unique(terms.indices.to_numpy() * np.int64(words.rows) + words.row, return_counts=True)
            of = (at // words.rows) * np.int64(width * len(lang.dictionary)) + group[at % words.rows]
            of, first, docs = np.unique(of, return_inverse=True, return_counts=True)
            total = np.zeros(len(of), np.int64)
            np.add.at(total, first, uses)
            term, group = np.divmod(of, width * len(lang.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(group // width)),
                    source.dictionary.take(pa.array(group % width)),
                    terms.dictionary.take(pa.array(term)).cast(pa.string()),
                    pa.array(total),
                    pa.array(docs.astype(np.int64)),
                ],
                ["lang", "source", "term", "uses", "docs"],
            )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(uses: Column, total: Column) -> Column:
    """1 + UNIT * (uses + 1) div total, in decimals where longs would overflow."""
    big = "decimal(38,0)"
    wide = _div((F.lit(UNIT).cast(big) * (uses + 1).cast(big)), total.cast(big))
    return 1 + F.when(uses < 9_000_000_000, _div(F.lit(UNIT).cast("long") * (uses + 1), total)).otherwise(wide)


def _gap(p: Column, q: Column) -> Column:
    """(p - q)^2 div q."""
    return _div((p - q) * (p - q), q)


def postings(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, source, uses, total, head): uses of each kept term by group, ``total`` in the language; ``head`` is true once a term.

    Terms are runs of ASCII letters (A-Z folded) and other characters than
    ASCII; a language keeps those in LEAST_DOCS of its documents. One shuffle,
    of counts by COUNT_BYTES of documents.
    """
    plain = docs.select(*(F.coalesce(column(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)))
    counts = plain.toDF("lang", "source", "body").mapInArrow(_counts, "lang string, source string, term string, uses long, docs long")
    rows = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = rows.withColumns({"total": F.sum("uses").over(term), "held": F.sum("docs").over(term), "head": F.min("source").over(term) == F.col("source")})
    return rows.where(F.col("held") >= LEAST_DOCS).drop("docs", "held")


def _groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """One row a group: its uses n, its kept terms, those of the language v and its uses; share of a term without use."""
    groups = docs.select(*(F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("uses").alias("n"), F.count("*").alias("support"), F.count_if("head").alias("heads"))
    lang = own.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("heads").alias("v"))
    rows = groups.join(own.drop("heads"), ["lang", "source"], "left").join(lang, "lang", "left").na.fill(0, ["n", "support", "all", "v"])
    return rows.withColumn("zero", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n") + F.col("v"))))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language, by inclusion and exclusion over their supports."""
    own = groups.select("lang", "source", "n", "v", "zero", "support")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero2"), F.col("support").alias("support2"))
    named = ["lang", "source", "item", "value"]
    turned = [F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item")]
    # Constants: terms that neither holds, as if no term were held by both.
    pairs = own.join(other, "lang").where("source <> item")
    neither = F.col("v") - F.col("support") - F.col("support2")
    constant = F.when(F.col("v") > 0, neither * _gap(F.col("zero"), F.col("zero2"))).otherwise(0)
    parts = [pairs.select("lang", "source", "item", constant.alias("value"))]
    # Terms of one side, priced by how many have a number of uses, as if the other side had none of them.
    histogram = kept.groupBy("lang", "source", "uses").agg(F.count("*").alias("terms"))
    shares = histogram.join(own, ["lang", "source"]).withColumn("p", _share(F.col("uses"), F.col("n") + F.col("v")))
    sided = shares.join(other, "lang").where("source <> item").groupBy("lang", "source", "item")
    sided = sided.agg(F.sum(F.col("terms") * _gap(F.col("p"), F.col("zero2"))).alias("of"), F.sum(F.col("terms") * _gap(F.col("zero2"), F.col("p"))).alias("to"))
    parts += [sided.select("lang", "source", "item", F.col("of").alias("value")), sided.select(*turned, F.col("to").alias("value"))]
    # Terms of both sides: their true price instead of two one-sided ones, and one more that neither lacks.
    rows = kept.select("lang", "term", "source", "uses").join(own.select("lang", "source", "n", "v", "zero"), ["lang", "source"])
    rows = rows.select("lang", "term", "source", _share(F.col("uses"), F.col("n") + F.col("v")).alias("p"), "zero")
    right = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("zero").alias("zero2"))
    both = rows.join(right, ["lang", "term"]).where("source < item")

    def correction(p: str, zero: str, q: str, zero2: str) -> Column:
        p, zero, q, zero2 = map(F.col, (p, zero, q, zero2))
        return F.sum(_gap(p, q) - _gap(p, zero2) - _gap(zero, q) + _gap(zero, zero2)).alias("value")

    both = both.groupBy("lang", "source", "item").agg(correction("p", "zero", "p2", "zero2").alias("of"), correction("p2", "zero2", "p", "zero").alias("to"))
    parts += [both.select("lang", "source", "item", F.col("of").alias("value")), both.select(*turned, F.col("to").alias("value"))]
    out = parts[0].select(*named)
    for part in parts[1:]:
        out = out.unionByName(part.select(*named))
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the kept terms that a group uses more than its language."""
    rows = kept.join(groups.select("lang", "source", "n", "v", "all"), ["lang", "source"])
    p, q = _share(F.col("uses"), F.col("n") + F.col("v")), _share(F.col("total"), F.col("all") + F.col("v"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return rows.select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each (lang, source) group from the other sources of its language, and by term from the language.

    A group gives each term that its language keeps (see ``postings``) the
    share p = 1 + UNIT * (uses + 1) div (n + v), n its uses of kept terms and v
    how many there are; a language likewise. The gap of p from q is
    (p - q)^2 div q. Part ``pair``: ``item`` is another source of the language,
    ``value`` the sum of gaps from it over all kept terms (0 without any). Part
    ``term``: ``item`` is a kept term with use in the group and p above the
    language's q, ``value`` its gap; only the first ``top`` ranks. Ranks run
    from 1 by falling value, then item.

    Sums over all kept terms are put together from the supports: terms of one
    side from histograms of uses, terms of both from a join of the postings,
    terms of neither by a constant. All is exact in 64 bits while a language
    keeps up to 10^9 terms.

    Null language, source and text count as empty; each row is a document, so
    repeats count. A group without terms has pairs but no terms; a language of
    one source has no pairs. Other columns are ignored. An empty table gives no
    rows.
    """
    kept = scratch(postings(docs, lang_col, source_col, text_col), "postings")
    groups = scratch(_groups(docs, kept, lang_col, source_col), "groups")
    parts = [_pairs(kept, groups).withColumn("part", F.lit("pair")), _terms(kept, groups).withColumn("part", F.lit("term"))]
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(by)) for part in parts]
    out = ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long"), "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language over all of ``documents``."""
    return source_divergence(read(spark, sf_dir, "documents"))


#: Every share of every kept term in every group, compared with every other group's.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), uses AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM uses GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS c FROM uses JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN own USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 1)) // (g.n + s.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (s.n + s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
