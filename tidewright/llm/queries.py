"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, embed_dedup, fixity, language, lm_score, ngram_join, packing, pii, quotes, substring_dedup

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_language_id": language.op3_language_id,
    "op4_embedding_dedup": embed_dedup.op4_embedding_dedup,
    "op5_pii": pii.op5_pii,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_merkle_audit": fixity.op7_merkle_audit,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_quote_linking": quotes.op9_quote_linking,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {"op7_merkle_audit": fixity.OP7_SQL, "op9_quote_linking": quotes.OP9_SQL}
