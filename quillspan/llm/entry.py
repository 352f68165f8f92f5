"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import chat, codes, imatch, langid, layout, linededup, mixing, pieces, quality, simhash, suffix, topk, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_chat_format": chat.op4_chat_format,
    "op5_imatch": imatch.op5_imatch,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_mixing": mixing.op10_mixing,
    "op11_clustered_layout": layout.op11_clustered_layout,
    "op12_warc": warc.op12_warc,
    "op13_vector_codes": codes.op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op2_line_dedup": linededup.OP2_SQL, "op4_chat_format": chat.OP4_SQL, "op9_exact_topk": topk.OP9_SQL, "op11_clustered_layout": layout.OP11_SQL, "op12_warc": warc.OP12_SQL, "op13_vector_codes": codes.OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
