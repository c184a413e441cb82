"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import importlib.util

from millrace.llm import chat, langid, media, mixing, packing, pii, quality, simhash, substring, urls

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_media_webp": media.query,
    "op3_substring_dedup": substring.query,
    "op4_packing": packing.query,
    "op5_simhash": simhash.query,
    "op6_chat_format": chat.query,
    "op7_mixing": mixing.query,
    "op8_url_filters": urls.query,
    "op9_pii": pii.query,
    "op10_language_id": langid.query,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op8_url_filters": urls.ORACLE,
}

if importlib.util.find_spec("corpus_pipeline") is not None:
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
