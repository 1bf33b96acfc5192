"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.bpe import default_path, encode_texts
from trajlake.llm.common import column, free_names, read, release, scratch
from trajlake.llm.mixing import mix
from trajlake.llm.ngram_jaccard import jaccard_components
from trajlake.llm.quality import THRESHOLD, fit_quality, score_quality
from trajlake.llm.suffix_dedup import cut_spans, repeated_spans

#: Near duplicates: five-word shingles, Jaccard of 0.8 or more.
NEAR = {"words": 5, "num": 80, "den": 100}


def _columns(docs: DataFrame) -> list:
    return [column(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality score THRESHOLD or more; the model is fitted on the labelled ones among ``docs``.

    Null and empty texts are scored as empty; rows without id, or that repeat
    one, are judged by their own text. Columns of any name stay.
    """
    (score,) = free_names(docs.columns, "score")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model, score_col=score).where(F.col(score) >= THRESHOLD).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    A row goes if a document of smaller id is in its group. Rows are told apart
    by id and text: an id's other text stays unless it is in such a group
    itself. Rows without id and wordless texts stay; so do rows that repeat the
    id of the one that stays. Columns of any name stay.
    """
    ident, key = free_names(docs.columns, "id", "key")
    gone = jaccard_components(docs, **NEAR).where("component_id <> doc_id")
    gone = gone.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key))
    keyed = docs.withColumns({ident: F.col("doc_id").cast("long"), key: F.xxhash64("text")})
    return keyed.join(gone, [ident, key], "left_anti").select(*_columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that repeat an earlier one; ``n_chars`` follows the text.

    Null texts and rows without id stay as they are, empty ones too; rows that
    repeat id and text lose the same passages. Columns of any name stay.
    """
    spans = repeated_spans(docs)
    out = cut_spans(docs, spans)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def _placed(docs: DataFrame, wanted: list, name: str) -> DataFrame:
    """``wanted`` columns of ``docs`` with the place in the mix, ordered by it.

    Rows that repeat an id within a source share its first place.
    """
    ident, source = free_names(docs.columns, "id", "of")
    places = mix(docs).groupBy("doc_id", "source").agg(F.min("position").alias(name))
    places = scratch(places.select(F.col("doc_id").alias(ident), F.col("source").alias(source), name), "places")
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(source))
    return docs.join(places, same, "left").select(*wanted, name).repartitionByRange(name).sortWithinPartitions(name)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in the order of the mix: files and rows follow each other by position.

    Rows without source are a source of their own; rows without id have a place
    like others. Every row and column stays.
    """
    (name,) = free_names(docs.columns, "position")
    return _placed(docs, _columns(docs), name).drop(name)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, in the order of the mix, with the row's position in it.

    Reading Parquet again doesn't keep the order of the rows, so the position
    is computed anew: it depends on ids and sources only. Null and empty texts
    have no ids. Other columns end here.
    """
    slim = docs.select("doc_id", "lang", "source", "text")
    out = encode_texts(_placed(slim, _columns(slim), "position"), default_path())
    return out.select("doc_id", "lang", "source", "position", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixing),
    ("BPE encoding", encoding),
]

#: A fitted model and sequential scheduling aren't SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents that the stages keep, one row each; an empty table gives no rows.

    Each stage's result is written as Parquet in the shared folder and read
    again as the next one's input, which is then deleted.
    """
    docs, written = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, written = written, scratch(docs, f"stage{k}")
            docs = written
            if before is not None:
                release(before)
    return docs
