"""The queries of this subpackage, and SQL for those that SQL can express."""

from postmill.llm import align, chat, decontaminate, jaccard, langid, lm, mixing, pii, quality, search, sharding, syncmers, urls

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_pii": pii.op3_pii,
    "op4_url_filters": urls.op4_url_filters,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_mixing": mixing.op7_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality": quality.op9_quality,
    "op10_fingerprints": syncmers.op10_fingerprints,
    "op11_search": search.op11_search,
    "op12_alignment": align.op12_alignment,
    "op13_langid": langid.op13_langid,
}
ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_lm_scoring": lm.OP2_SQL,
    "op5_jaccard_join": jaccard.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_search": search.OP11_SQL,
}
