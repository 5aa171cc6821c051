"""The queries of this folder and their SQL counterparts."""

from __future__ import annotations

from . import filter_audit, html_text, mixing, packing, simhash, spotsigs, substring_dedup, suffix_dedup, token_files, topk, toxicity, url_filter, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_html_text": html_text.op2_html_text,
    "op3_token_files": token_files.op3_token_files,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_top_k": topk.op5_top_k,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_simhash": simhash.op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_whitening": whitening.op11_whitening,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
ORACLES: dict[str, str] = {
    "op5_top_k": topk.OP5_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
