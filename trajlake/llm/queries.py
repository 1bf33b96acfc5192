"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, divergence, embedding_dedup, fingerprint, lexical, licences, mixing, ngram_jaccard, quality, suffix_dedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_chat": chat.op2_chat,
        "op3_fingerprint": fingerprint.op3_fingerprint,
        "op4_bpe": bpe.op4_bpe,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
        "op7_licences": licences.op7_licences,
        "op8_warc": warc.op8_warc,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_quality": quality.op10_quality,
        "op11_lexical": lexical.op11_lexical,
        "op12_decontamination": decontamination.op12_decontamination,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.SQL, "op7_licences": licences.SQL, "op8_warc": warc.SQL, "op11_lexical": lexical.SQL, "op12_decontamination": decontamination.SQL, "op13_divergence": divergence.SQL}
