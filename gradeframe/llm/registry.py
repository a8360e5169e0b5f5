"""The document operators' queries and their SQL."""

from __future__ import annotations

from gradeframe.llm import clustering, decontam, exact_dedup, langid, line_dedup, mixing, near_dedup, neighbours, phrases, quality, repeats, sharding, tokens

QUERIES = {
    "op1_quality": quality.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_token_files": tokens.query,
    "op4_line_dedup": line_dedup.query,
    "op5_mixing": mixing.query,
    "op6_repeats": repeats.query,
    "op7_sharding": sharding.query,
    "op8_near_dedup": near_dedup.query,
    "op9_decontamination": decontam.query,
    "op10_language_id": langid.query,
    "op11_clustering": clustering.query,
    "op12_phrases": phrases.query,
    "op13_neighbours": neighbours.query,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op9_decontamination": decontam.ORACLE,
    "op11_clustering": clustering.ORACLE,
    "op12_phrases": phrases.ORACLE,
}
