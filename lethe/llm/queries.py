"""The corpus queries and their SQL, by registered name."""

from __future__ import annotations

from . import (bpe, centroids, context_tree, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, runs, secret_scan, token_counts, toxicity,
               transport_stream)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_toxicity": toxicity.op5_toxicity,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_transport_stream": transport_stream.op10_transport_stream,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op6_bpe": bpe.op6_bpe,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op11_context_tree": context_tree.op11_context_tree,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE_SQL = {
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
