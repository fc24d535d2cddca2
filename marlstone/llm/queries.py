"""The subpackage's queries and their SQL, added by the entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name: module of this subpackage that has a function of that name
PLACES = {
    "op1_cotrained_quality": "quality",
    "op2_nearest_centroid_language": "langid",
    "op3_latent_decontamination": "decontaminate",
    "op4_weighted_fair_mix": "mixing",
    "op5_subword_toxicity": "toxicity",
    "op6_line_crf_rules": "line_rules",
    "op7_license_templates": "licenses",
    "op8_vector_packed_shards": "sharding",
    "op9_quotation_threads": "quotes",
    "op10_superminhash_near_dup": "near_dup",
    "op11_context_triggered_hash": "fuzzy_hash",
    "op12_token_alignment": "alignment",
    "op13_distance_key_negatives": "hard_negatives",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{place}"), name) for name, place in PLACES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, place in PLACES.items():
        sql = getattr(import_module(f"{__package__}.{place}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
