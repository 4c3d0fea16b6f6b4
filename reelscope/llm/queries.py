"""The registered corpus queries and their SQL counterparts."""

from __future__ import annotations

from reelscope.llm import (
    chat_format, conversation_repair, exact_dedup, license_scan, line_crf, line_dedup, near_dedup, packing, parity_join,
    quality_classifier, sentence_pieces, spelling_variants, token_counts,
)

QUERIES = {
    "op1_quality_rules": line_crf.op1_quality_rules,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_sentence_pieces": sentence_pieces.op8_sentence_pieces,
    "op9_packing": packing.op9_packing,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_jaccard_join": parity_join.op12_jaccard_join,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_chat_format": chat_format.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op10_license_scan": license_scan.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_jaccard_join": parity_join.SQL,
    "op13_spelling_variants": spelling_variants.SQL,
}
