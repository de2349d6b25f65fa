"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from . import chat, collocations, decontaminate, divergence, jaccard, langid, lines, passages, pii, sentencepiece_fst, shards, token_cache, topk

QUERIES = {
    "op1_pii": pii.op1,
    "op2_jaccard_join": jaccard.op2,
    "op3_shard": shards.op3,
    "op4_chat_format": chat.op4,
    "op5_line_dedup": lines.op5,
    "op6_top_k": topk.op6,
    "op7_language_id": langid.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_sentencepiece": sentencepiece_fst.op9,
    "op10_repeated_passages": passages.op10,
    "op11_collocations": collocations.op11,
    "op12_token_counts": token_cache.op12,
    "op13_source_divergence": divergence.op13,
}

ORACLE = {
    "op2_jaccard_join": jaccard.ORACLE_OP2,
    "op4_chat_format": chat.ORACLE_OP4,
    "op5_line_dedup": lines.ORACLE_OP5,
    "op6_top_k": topk.ORACLE_OP6,
    "op11_collocations": collocations.ORACLE_OP11,
    "op13_source_divergence": divergence.ORACLE_OP13,
}
