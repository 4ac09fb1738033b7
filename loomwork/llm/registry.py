"""Queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

from . import binaries, chat, divergence, fingerprints, infill, licenses, mixing, neardup, neighbours, pieces, quality, secrets, substrings

QUERIES = {
    "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op4_document_fingerprints": fingerprints.op4_document_fingerprints,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_license_scans": licenses.op6_license_scans,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_mixing_to_targets": mixing.op8_mixing_to_targets,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_token_files": binaries.op13_token_files,
}
ORACLES = {
    "op5_substring_dedup": substrings.ORACLE,
    "op7_minhash_near_dedup": neardup.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op11_fill_in_middle": infill.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
