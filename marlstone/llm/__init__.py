"""Operators for training-data pipelines; optional, nothing else in the library imports them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, langid, mixing, pieces, pii, quality, repeats, template, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_context_mixing": mixing.scores,
        "op2_toxicity": toxicity.toxic_documents,
        "op3_personal_data": pii.personal_data,
        "op4_decontamination": decontaminate.contaminated,
        "op5_template_removal": template.main_text,
        "op6_segmentations": pieces.segmentations,
        "op7_quality_rules": quality.quality_rules,
        "op8_language_id": langid.languages,
        "op9_jaccard_join": jaccard.near_duplicates,
        "op10_shared_passages": repeats.shared_passages,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express."""
    return {
        "op4_decontamination": decontaminate.ORACLE,
        "op9_jaccard_join": jaccard.ORACLE,
        "op10_shared_passages": repeats.ORACLE,
    }
