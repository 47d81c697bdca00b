"""The corpus operators' queries, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, media, mixing, pieces, quality_mil, quality_rules, simhash, substrings, token_file, toxicity, url_filter, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality_mil.op1_quality,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_mixing": mixing.op3_mixing,
        "op4_simhash": simhash.op4_simhash,
        "op5_pieces": pieces.op5_pieces,
        "op6_urls": url_filter.op6_urls,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_tokens": token_file.op8_tokens,
        "op9_media": media.op9_media,
        "op10_warc": warc.op10_warc,
        "op11_conversations": conversations.op11_conversations,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_substrings": substrings.op13_substrings,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": warc.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_substrings": substrings.ORACLE_SQL}
