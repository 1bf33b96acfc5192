"""Decisions on experience cards from replays, and the banks that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedupe_fold, phrase_match

CARD = ["scope", "experience_id"]


def card_decisions(bank: DataFrame, results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(scope, experience_id, keep, reason, retrieval_count, mean_pairwise) for every card of ``bank``.

    results: (scope, pairwise, retrieved array of ids), a row per replay. Cards of scopes without replays are kept.
    """
    seen = results.select("scope", "pairwise", F.explode("retrieved").alias("experience_id"))
    stats = seen.groupBy(*CARD).agg(F.count(F.lit(1)).alias("retrieval_count"), F.avg("pairwise").alias("mean_pairwise"))
    scopes = results.select("scope").distinct().withColumn("_evaluated", F.lit(True))
    rows = bank.select(*CARD).join(stats, CARD, "left").join(scopes, "scope", "left")
    enough = F.coalesce(F.col("mean_pairwise") >= threshold, F.lit(False))
    reason = (
        F.when(F.col("_evaluated").isNull(), "scope_not_evaluated").when(enough, "kept")
        .when(F.col("retrieval_count").isNull(), "never_retrieved").otherwise(f"mean_judge_pairwise_accuracy_below_{threshold:g}")
    )
    return rows.select(
        *CARD, (F.col("_evaluated").isNull() | enough).alias("keep"), reason.alias("reason"),
        F.coalesce("retrieval_count", F.lit(0)).alias("retrieval_count"), "mean_pairwise",
    )


def scope_summary(results: DataFrame) -> DataFrame:
    """(scope, events, baseline_mean, candidate_mean) of results with ``baseline`` (nullable) and ``pairwise``."""
    return results.groupBy("scope").agg(
        F.count(F.lit(1)).alias("events"), F.avg("baseline").alias("baseline_mean"), F.avg("pairwise").alias("candidate_mean"),
    )


def keyword_selection(keywords: DataFrame, results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(scope, experience_id, selected_keywords, policy): phrases whose replays average ``threshold`` or more.

    keywords: (scope, experience_id, selected_keywords); results: (scope, pairwise, retrieved, view). A phrase is
    measured on the replays that retrieved its card and show the phrase. Cards without such a phrase keep all.
    """
    phrases = keywords.select(*CARD, F.posexplode("selected_keywords").alias("pos", "phrase"))
    seen = results.select("scope", "pairwise", "view", F.explode("retrieved").alias("experience_id"))
    hits = phrases.join(seen, CARD).where(phrase_match(F.col("phrase"), F.col("view")))
    good = hits.groupBy(*CARD, "pos", "phrase").agg(F.avg("pairwise").alias("_m")).where(F.col("_m") >= threshold)
    chosen = good.groupBy(*CARD).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phrase"))), lambda s: s["phrase"]).alias("_kept"))
    out = keywords.join(chosen, CARD, "left")
    policy = F.when(F.col("_kept").isNull(), "conservative_union_when_no_keyword_is_attributable").otherwise("positive_joint_replay_evidence")
    return out.select(*CARD, F.coalesce("_kept", "selected_keywords").alias("selected_keywords"), policy.alias("policy"))


def filter_bank(bank: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cards that ``decisions`` keep. A scope that would lose all its cards raises when the result is computed."""
    kept = decisions.groupBy("scope").agg(F.bool_or("keep").alias("_any"))
    message = F.concat(F.lit("the filter removes the whole bank of scope "), F.col("scope"))
    checked = kept.select("scope", F.when(F.col("_any"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")).alias("_any"))
    rows = bank.join(decisions.select(*CARD, "keep"), CARD).join(checked, "scope")
    return rows.where("keep AND _any").select(*bank.columns)


def counts(bank: DataFrame) -> DataFrame:
    """(scope, experience_count)."""
    return bank.groupBy("scope").agg(F.count(F.lit(1)).alias("experience_count"))


def keyword_bank(records: DataFrame) -> DataFrame:
    """(scope, experience_id, generated_keywords, selected_keywords) of records with base, model and chosen keywords.

    Phrases are stripped; of those equal but for case the first stays. A record without chosen keywords raises.
    """
    none = F.array().cast("array<string>")
    generated = dedupe_fold(F.concat(F.coalesce("base_keywords", none), F.coalesce("model_keywords", none)))
    chosen = dedupe_fold(F.coalesce("keywords", none))
    message = F.concat_ws(":", "scope", "experience_id", F.lit(" selected keywords must be nonempty"))
    checked = F.when(F.size(chosen) > 0, chosen).otherwise(F.raise_error(message).cast("array<string>"))
    return records.select(*CARD, generated.alias("generated_keywords"), checked.alias("selected_keywords"))
