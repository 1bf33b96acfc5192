"""Rewards of search conversations: well-formed sequences, retrieval hits, tiers. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import answer_block, exact_match, let, normalize_answer

_ANY = r"</?(?:think|search|information|answer)>"
_INSIDE = rf"(?:(?!{_ANY}).)*"
_PART = lambda tag: rf"<{tag}>{_INSIDE}</{tag}>\s*"
#: Thoughts, each followed by a search and its information, and at last by an answer; nothing else between the parts.
SEQUENCE = rf"(?s)^\s*(?:{_PART('think')}{_PART('search')}{_PART('information')})*{_PART('think')}{_PART('answer')}$"


def valid_sequence(text: Column) -> Column:
    """What follows the first assistant marker is a whole sequence of parts; false without a marker or text."""
    at = F.instr(text, "<|im_start|>assistant")
    said = F.substring(text, at + len("<|im_start|>assistant"), F.length(text))
    return F.coalesce((at > 0) & said.rlike(SEQUENCE), F.lit(False))


def retrieval_hit(text: Column, golds: Column) -> Column:
    """A gold answer is part of some information block, both normalised."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<information>(.*?)</information>"), 1)
    plain = F.transform(blocks, normalize_answer)
    return let(F.transform(golds, normalize_answer), lambda gs: F.exists(plain, lambda b: F.exists(gs, lambda g: F.contains(b, g))))


def search_score(text: Column, golds: Column, structure: float = 0.0, final: float = 0.0, retrieval: float = 0.0, score: float = 1.0) -> Column:
    """Tiers: the right answer in a valid sequence, the right one alone (less ``structure``), a valid sequence with or without a hit, an answer at all.

    The last answer counts if there are two or more (the prompt holds one).
    """
    state = F.struct(valid_sequence(text).alias("valid"), answer_block(text).alias("answer"), retrieval_hit(text, golds).alias("hit"))

    def tier(s: Column) -> Column:
        right = F.coalesce(exact_match(s["answer"], golds), F.lit(False))
        formed = F.when(s["hit"], structure + retrieval).otherwise(structure)
        return (
            F.when(right & s["valid"], score).when(right, score - structure).when(s["valid"], formed)
            .when(s["answer"].isNotNull(), final).otherwise(0.0)
        )

    return let(state, tier)
