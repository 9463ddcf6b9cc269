"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_dedup, exact_dedup, extraction, licenses, mixing, packing, quality, simhash, substring_dedup, url_filter, vector_codes, warc, whitening


def _on(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": _on("documents", substring_dedup.op1),
        "op2_byte_dedup": _on("documents", byte_dedup.op2),
        "op3_mixing": _on("documents", mixing.op3),
        "op4_warc": _on("pages", warc.op4),
        "op5_extraction": _on("pages", extraction.op5),
        "op6_simhash": _on("documents", simhash.op6),
        "op7_quality": _on("documents", quality.op7),
        "op8_packing": _on("documents", packing.op8),
        "op9_exact_dedup": _on("documents", exact_dedup.op9),
        "op10_url_filter": _on("pages", url_filter.op10),
        "op11_whitening": _on("embeddings", whitening.op11),
        "op12_vector_codes": _on("embeddings", vector_codes.op12),
        "op13_licenses": _on("documents", licenses.op13),
    }


def oracle_sql() -> dict[str, str]:
    """Keys drawn from 64-bit hashes (op3, op6), a tokenizer's ids (op8) and eigenvectors (op11) have no SQL form; tests compare those by brute force."""
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op2_byte_dedup": byte_dedup.OP2_SQL,
        "op4_warc": warc.OP4_SQL,
        "op5_extraction": extraction.OP5_SQL,
        "op7_quality": quality.OP7_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
        "op13_licenses": licenses.OP13_SQL,
    }
