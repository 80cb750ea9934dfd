"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm import (
    brown_lm,
    language_id,
    length_buckets,
    near_duplicates,
    quality_classifier,
    quality_rules,
    source_mix,
    training_order,
    url_filters,
    vector_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_training_order": training_order.op1_training_order,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_near_duplicates": near_duplicates.op3_near_duplicates,
        "op4_brown_lm": brown_lm.op4_brown_lm,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_length_buckets": length_buckets.op6_length_buckets,
        "op7_language_id": language_id.op7_language_id,
        "op8_source_mix": source_mix.op8_source_mix,
        "op9_vector_search": vector_search.op9_vector_search,
        "op10_url_filters": url_filters.op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_source_mix": source_mix.op8_sql(),
        "op10_url_filters": url_filters.op10_sql(),
    }
