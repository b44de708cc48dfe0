"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, bpe, common, fingerprints, html, jaccard, language, lines, middle, mixing, neighbours,
    quality, substrings, urls)

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, Query]:
    found = {
        "op1_jaccard_join": jaccard.op1_jaccard_join,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
        "op5_url_filter": urls.op5_url_filter,
        "op6_language_id": language.op6_language_id,
        "op7_bpe": bpe.op7_bpe,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_html_text": html.op9_html_text,
        "op10_substring_dedup": substrings.op10_substring_dedup,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_fill_in_middle": middle.op12_fill_in_middle,
        "op13_fingerprints": fingerprints.op13_fingerprints,
    }
    return {name: _shipped(query) for name, query in found.items()}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)

    return run


def statements() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard.OP1_SQL,
        "op2_quality_rules": quality.OP2_SQL,
        "op3_mix_sources": mixing.OP3_SQL,
        "op8_line_dedup": lines.OP8_SQL,
        "op10_substring_dedup": substrings.OP10_SQL,
        "op12_fill_in_middle": middle.OP12_SQL,
        "op13_fingerprints": fingerprints.OP13_SQL,
    }
