"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import exact_dedup, near_dedup, packing, pii, piece_sampling, secret_scan, token_files, topk, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pii": pii.op2_pii,
    "op3_topk": topk.op3_topk,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_piece_sampling": piece_sampling.op6_piece_sampling,
    "op7_token_files": token_files.op7_token_files,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_topk": topk.SQL,
    "op10_warc": warc.SQL,
}
