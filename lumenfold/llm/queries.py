"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from lumenfold.llm import cotrain, decontam, exact_dedup, langid, licenses, merkle, minhash, packing, repair, substring_dedup, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_quality": cotrain.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_token_counts": token_counts.op4,
    "op5_warc": warc.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_decontamination": decontam.op7,
    "op8_minhash_dedup": minhash.op8,
    "op9_language_id": langid.op9,
    "op10_packing": packing.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_license_scan": licenses.op12,
    "op13_conversation_repair": repair.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op8_minhash_dedup": minhash.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_license_scan": licenses.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
}
