"""The queries of this subpackage by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from noticeloom.llm import ball_tree, decontamination, drift_clusters, exact_dedup, mixing, near_dedup, piece_sampling, quality, secrets, spelling, suffix_family, token_counts, token_files

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_secrets": secrets.op2_secrets,
    "op3_token_files": token_files.op3_token_files,
    "op4_mixing": mixing.op4_mixing,
    "op5_sampled_pieces": piece_sampling.op5_sampled_pieces,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_repeated_passages": suffix_family.op7_repeated_passages,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality": quality.op9_quality,
    "op10_exact_top_k": ball_tree.op10_exact_top_k,
    "op11_centroid_clusters": drift_clusters.op11_centroid_clusters,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op10_exact_top_k": ball_tree.ORACLE,
    "op11_centroid_clusters": drift_clusters.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
}
