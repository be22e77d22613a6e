"""Named queries of the operators and their SQL twins."""

from __future__ import annotations

from dqspark.llm import (
    chat,
    decontaminate,
    divergence,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    minhash_dedup,
    packing,
    token_files,
    url_filter,
    warc,
    whitening,
)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_language_id": language_id.op2_language_id,
    "op3_chat_format": chat.op3_chat_format,
    "op4_token_files": token_files.op4_token_files,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op5_jaccard_links": jaccard_join.op5_jaccard_links,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op6_near_phrases": decontaminate.op6_near_phrases,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_warc": warc.op9_warc,
    "op10_packing": packing.op10_packing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_whitening": whitening.op12_whitening,
    "op13_minhash_dedup": minhash_dedup.op13_minhash_dedup,
}

# The others cannot be said in SQL; tests hold them against brute force, the library's ids or held-out accuracy.
ORACLES = {
    "op1_url_filter": url_filter.SQL,
    "op3_chat_format": chat.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op5_jaccard_links": jaccard_join.LINKS_SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_warc": warc.SQL,
    "op11_source_divergence": divergence.SQL,
    "op13_minhash_dedup": minhash_dedup.SQL,
}
