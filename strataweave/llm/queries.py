"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, licences, mixing, near_dedup, packing, paragraphs, pivot_search, quality, secrets, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        secrets.op1_trigram_secret_scan,
        quality.op2_boosted_quality,
        paragraphs.op3_paragraph_minhash,
        near_dedup.op4_setsketch_near_dedup,
        suffixes.op5_sampled_suffix_dedup,
        pivot_search.op6_pivot_top_k,
        fingerprints.op7_prefix_fingerprints,
        licences.op8_automaton_licences,
        packing.op9_binary_packing,
        mixing.op10_sainte_lague_mix,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_trigram_secret_scan": secrets.OP1_SQL, "op4_setsketch_near_dedup": near_dedup.OP4_SQL, "op5_sampled_suffix_dedup": suffixes.OP5_SQL, "op6_pivot_top_k": pivot_search.OP6_SQL}
