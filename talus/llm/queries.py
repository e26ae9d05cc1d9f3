"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from talus.llm import conversation_repair, html_text, image_copies, jaccard_join, language_id, line_dedup, lm_scoring, merkle, mixing, packing, quality, toxicity, warc

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_warc": warc.op2_warc,
    "op3_image_copies": image_copies.op3_image_copies,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_html_text": html_text.op8_html_text,
    "op9_mixing": mixing.op9_mixing,
    "op10_language_id": language_id.op10_language_id,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_merkle": merkle.op12_merkle,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
SQL = {
    "op2_warc": warc.SQL,
    "op9_mixing": mixing.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_merkle": merkle.SQL,
    "op13_line_dedup": line_dedup.SQL,
}
