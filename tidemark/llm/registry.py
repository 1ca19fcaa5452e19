"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, fingerprint, html_text, jaccard_join, language, media, mixing, pii, quality, url_filter

QUERIES = {
    "op1_language": language.op1_language,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_media": media.op5_media,
    "op6_html": html_text.op6_html,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_jaccard": jaccard_join.op8_jaccard,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_bpe": bpe.op10_bpe,
}
SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
}
