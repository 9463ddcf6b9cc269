"""The corpus pipeline: quality rules, exact dedup, near-dedup by Jaccard similarity, mixing to target weights, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, mixing, packing, quality, simhash
from lectern.llm.common import discard, external_id, gathered, internal_id, materialise, scratch_scope, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the divergence tests let pass.

    A null or empty text fails the base rule and goes; repeated rows go or stay together; a null id or language is judged like any other.
    """
    bad = quality.quality_rules(docs).filter(~F.col("kept")).select("did", "tag").distinct()
    return _without(docs, bad)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id; a null id ranks last, null texts are empty.

    Of repeated rows with that id all stay: nothing tells them apart.
    """
    return gathered(exact_dedup.deduplicate(docs), docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id; of texts that share that id, one.

    A null id ranks last, texts without words are alike, repeated rows stay or go together.
    """
    later = simhash.near_duplicates(docs).filter("did <> component or tag <> component_tag").select("did", "tag").distinct()
    return _without(docs, later)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that the mix takes; the last of a document taken in part holds its first words.

    A null source is one of its own, the last; documents without words are not taken; repeated rows are each taken on their own.
    """
    return gathered(mixing.mixed_documents(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids. A null text is empty: one id; repeated rows are packed each on their own."""
    return packing.pack_documents(gathered(docs)).select(
        external_id("did").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"
    )


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows that (did, tag) names; the tag is the text's hash, so rows that share an id stay apart."""
    did, tag = unused(docs.columns, "did"), unused(docs.columns, "tag")
    keys = keys.select(F.col("did").alias(did), F.col("tag").alias(tag))
    kept = docs.join(keys, (internal_id(docs["doc_id"]) == keys[did]) & (F.xxhash64(docs["text"].cast("string")) == keys[tag]), "left_anti")
    return gathered(kept, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The shingles' hash and the tokenizer's ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch_scope() as made:
            docs = materialise(stage(spark, docs, sf_dir), name)
        for table in (t for t in (before, *made) if t is not None and t is not docs):
            discard(table)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
