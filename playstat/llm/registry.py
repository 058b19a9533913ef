"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from playstat.llm import (chat, collocations, decontamination, fingerprints, language_id, nearest, ngram_join, packing, pii,
                          ranked_search, substring_dedup, token_counts, warc)

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_pii": pii.op4_pii,
    "op5_nearest": nearest.op5_nearest,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_warc": warc.op8_warc,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op1_ngram_jaccard": ngram_join.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op5_nearest": nearest.OP5_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
