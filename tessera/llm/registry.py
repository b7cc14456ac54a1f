"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tessera.llm import chat_format, decontaminate, divergence, line_dedup, manifest, mtree, packing, pii, simhash, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_chat_formatting": chat_format.op2_chat_formatting,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_exact_top_k": mtree.op6_exact_top_k,
    "op7_warc": warc.op7_warc,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_pii": pii.op13_pii,
}

ORACLES = {
    "op2_chat_formatting": chat_format.ORACLE_SQL,
    "op3_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op6_exact_top_k": mtree.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op12_merkle_manifest": manifest.ORACLE_SQL,
}
