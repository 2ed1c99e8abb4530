"""The queries of the thirteen operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, counts, fingerprints, jaccard, languages, licenses, negatives, packing, shards, substrings, suffixes, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_packing": packing.op3_packing,
    "op4_embedding_near_dedup": vectors.op4_embedding_near_dedup,
    "op5_suffix_array_dedup": suffixes.op5_suffix_array_dedup,
    "op6_language_id": languages.op6_language_id,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_token_counts": counts.op9_token_counts,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_sharding": shards.op12_sharding,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substrings.OP1_SQL,
    "op7_jaccard_join": jaccard.OP7_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op13_centroid_clustering": centroids.OP13_SQL,
}
