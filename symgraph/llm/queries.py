"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_pairs, html_text, infilling, merkle, mixing, neighbours, packing, pii, quality, simhash, sketches, toxicity, url_filter
from .common import table


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


def _labelled(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator over its whole table."""
    return {
        "op1_toxicity": _labelled(toxicity.query),
        "op2_neighbours": _over("embeddings", neighbours.query),
        "op3_url_filter": _over("pages", url_filter.query),
        "op4_document_fingerprints": _over("documents", sketches.query),
        "op5_simhash_groups": _over("documents", simhash.query),
        "op6_source_mixing": _over("documents", mixing.query),
        "op7_mixture_packing": _over("documents", packing.query),
        "op8_html_text": _over("pages", html_text.query),
        "op9_quality": _labelled(quality.query),
        "op10_personal_data": _over("documents", pii.query),
        "op11_infilling": _over("documents", infilling.query),
        "op12_merkle_manifest": _over("documents", merkle.query),
        "op13_byte_pairs": _over("documents", byte_pairs.query),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the same rows, where SQL can express them."""
    return {"op3_url_filter": url_filter.sql(), "op11_infilling": infilling.sql(), "op12_merkle_manifest": merkle.sql()}
