"""Queries of this subpackage and their SQL, where SQL can express them."""

from wayfold.llm import chat, decontaminate, media, packing, quality, setjoin, substring, tokens, toxicity, url_filter

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_quality": quality.op2_quality,
    "op3_media": media.op3_media,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_packing": packing.op7_packing,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_ngram_join": setjoin.op9_ngram_join,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLE_SQL = {"op1_chat_format": chat.OP1_SQL, "op5_decontaminate": decontaminate.OP5_SQL, "op8_substring_dedup": substring.OP8_SQL, "op9_ngram_join": setjoin.OP9_SQL}
