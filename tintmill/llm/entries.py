"""Queries and SQL of this subpackage, for the registry at the repository's top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tintmill.llm import ball_kmeans, exact_dedup, hard_negatives, language_id, lm_scoring, media, mixing, packing, pii, sharding, simhash_dedup, token_counts, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        sharding.op1_feistel_shards, exact_dedup.op2_recipe_dedup, mixing.op3_tree_mix, token_counts.op4_separator_scan,
        language_id.op5_kneser_ney_language, packing.op6_hilbert_packing, lm_scoring.op7_pitman_yor,
        simhash_dedup.op8_pigeonring_simhash, pii.op9_bootstrapped_pii, media.op10_interleaved_media,
        token_files.op11_mixed_range_coder, hard_negatives.op12_hard_negatives, ball_kmeans.op13_ball_kmeans,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_recipe_dedup": exact_dedup.ORACLE_SQL, "op3_tree_mix": mixing.oracle(), "op12_hard_negatives": hard_negatives.ORACLE_SQL, "op13_ball_kmeans": ball_kmeans.oracle(),
    } | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
