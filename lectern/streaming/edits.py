"""Corrections that arrive as a stream, kept as a table with a version for each batch.

A batch is written under its number and nothing else, so a batch that is replayed after a failure replaces itself; a table read up to
a version is the same however often it was written. The latest edit of a key wins, also where it arrives in an earlier batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.edits import latest_edits

VERSION = "version"


def write_version(batch: DataFrame, number: int, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """The last edit of each key in a batch, as version `number` of the table."""
    latest_edits(batch, keys, order).write.mode("overwrite").parquet(f"{path}/{VERSION}={number}")


def stream_edits(edits: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start saving a stream of edits; with the same checkpoint it goes on where it was."""
    save = lambda batch, number: write_version(batch, number, path, keys, order)
    return edits.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, edits): how many keys each version has edited."""
    return spark.read.parquet(path).groupBy(VERSION).agg(F.count("*").alias("edits"))


def read_edits(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], version: int | None = None) -> DataFrame:
    """The latest edit of each key up to a version, or of all; of edits that were made at one time the later version's. Versions beyond are not read."""
    rows = spark.read.parquet(path)
    upto = rows if version is None else rows.filter(F.col(VERSION) <= version)
    return latest_edits(upto, keys, [*order, VERSION]).drop(VERSION)
