"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from quirespark.llm import bpe, embedding_dedup, exact_topk, language_id, line_dedup, mixing, near_dedup, periodic_runs, substring_dedup, token_files, toxicity, vector_codes, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_exact_topk": exact_topk.op6_exact_topk,
    "op7_token_files": token_files.op7_token_files,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_language_id": language_id.op9_language_id,
    "op10_embedding_near_dedup": embedding_dedup.op10_embedding_near_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_warc": warc.op13_warc,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_exact_topk": exact_topk.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op10_embedding_near_dedup": embedding_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_periodic_runs": periodic_runs.ORACLE,
    "op13_warc": warc.ORACLE,
}
