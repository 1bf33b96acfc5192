"""Training masks of chats, checked by what the trained tokens decode to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chat_templates import CHATML, Template, chats_of, template_masks
from .groups_q import _t


def _masks(spark, d, family, template=CHATML):
    import public_tokenizers

    rows = template_masks(chats_of(_t(spark, d, "conversations")), family, str(public_tokenizers.path("byte_bpe_50k.json")), template=template, texts=True)
    agree = (F.size("tokens") == F.size("loss_mask")) & (F.size("tokens") > 0)
    return rows.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text"), F.md5(F.col("trained").cast("binary")).alias("trained"), agree.alias("agree"))


def masks_spliced(spark, d):
    return _masks(spark, d, "spliced")


def masks_headed(spark, d):
    return _masks(spark, d, "headed", Template(default_system="Help."))


def masks_rendered(spark, d):
    return _masks(spark, d, "rendered")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and k.startswith("masks_")}
_TURNS = """WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, coalesce(text, '') AS t FROM conversations),
r AS (SELECT conv_id, k, CASE WHEN role = 'system' AND k > 1 THEN 'user' ELSE coalesce(role, 'assistant') END AS role, t FROM m),
x AS (SELECT conv_id, k, role, '<|im_start|>' || CASE WHEN role = 'tool' THEN 'user' ELSE role END || chr(10) AS head,
  CASE WHEN role = 'tool' THEN '<tool_response>' || chr(10) || t || chr(10) || '</tool_response>' ELSE t END || '<|im_end|>' || chr(10) AS body FROM r)
SELECT conv_id, md5({system}string_agg(head || body, '' ORDER BY k)) AS text, md5(coalesce(string_agg({own}, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS trained, true AS agree FROM x GROUP BY conv_id"""
SQL = {
    "masks_spliced": _TURNS.format(system="", own="head || body"),
    "masks_headed": _TURNS.format(system="CASE WHEN any_value(role ORDER BY k) = 'system' THEN '' ELSE '<|im_start|>system' || chr(10) || 'Help.<|im_end|>' || chr(10) END || ", own="body"),
    "masks_rendered": _TURNS.format(system="", own="body"),
}
