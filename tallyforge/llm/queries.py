"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyforge.llm import audit, chat, decontam, fingerprints, jaccard, langid, lines, mixing, sharding, simhash, warc, whitening

QUERIES = {
    "op1_multiset_fingerprints": fingerprints.query,
    "op2_hypergeometric_sharding": sharding.query,
    "op3_language_centroids": langid.query,
    "op4_pivotal_mixing": mixing.query,
    "op5_warc_archive": warc.query,
    "op6_benchmark_decontamination": decontam.query,
    "op7_line_windows": lines.query_windows,
    "op8_partenum_jaccard": jaccard.query,
    "op9_chat_formatting": chat.query,
    "op10_sentence_hashes": lines.query_sentences,
    "op10_line_hashes": lines.query_lines,
    "op11_svd_whitening": whitening.query,
    "op12_filter_audit": audit.query,
    "op13_simhash_pivots": simhash.query,
}

#: DuckDB SQL where it can express the query.
SQL: dict[str, str] = {
    "op5_warc_archive": warc.SQL,
    "op6_benchmark_decontamination": decontam.SQL,
    "op7_line_windows": lines.SQL_WINDOWS,
    "op8_partenum_jaccard": jaccard.SQL,
    "op9_chat_formatting": chat.SQL,
    "op10_sentence_hashes": lines.SQL_SENTENCES,
    "op10_line_hashes": lines.SQL_LINES,
    "op12_filter_audit": audit.SQL,
}
