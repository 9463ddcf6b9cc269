"""Human corrections as a table, and which frames are still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import longest_interval


def overlay(frames: DataFrame, edited: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """frames in which what an edited row has takes precedence, nulls too, which clear a value; `edited_by_human` says where.

    Of several edited rows with one key the greatest counts, column by column in turn, so that frames stay as many as they are; latest_edits()
    chooses by time. A null key is not edited.
    """
    chosen = edited.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"__{c}") for c in columns])).alias("__e")).select(*keys, "__e.*", F.lit(True).alias("__hit"))
    joined = frames.join(chosen, list(keys), "left")
    new = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns} | {"edited_by_human": F.coalesce("__hit", F.lit(False))}
    return joined.withColumns(new).drop("__hit", *[f"__{c}" for c in columns])


def latest_edits(edits: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last edit of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return edits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def apply_edits(words: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """words with the text and highlight of the edits that name their index; others stay."""
    return overlay(words, edits.select(*keys, "text", "highlight"), keys, ["text", "highlight"])


def editing_seconds(edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edits.groupBy(*keys).agg(F.sum("seconds").alias("seconds_spent"))


def pending(frames: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames without an output yet."""
    return frames.join(done.select(*keys).distinct(), list(keys), "left_anti")


def next_frame(pending_frames: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The first frame to do of each session."""
    return pending_frames.groupBy(*keys).agg(F.min(time).alias(time))


def report_frames(events: DataFrame, keys: Sequence[str], time: str, gid: str = "gid") -> DataFrame:
    """(keys, time, changes) of the frames in a change log, with the number of changes whose id was assigned: those to look at."""
    return events.groupBy(*keys, time).agg(F.count(F.when(F.col(gid) != -1, 1)).alias("changes"))


def longest_interval_frames(intervals: DataFrame, part: str, keys: Sequence[str], time: str = "t") -> DataFrame:
    """(keys, time): the transitions of the interval of a part whose transitions span most, the first on a tie."""
    chosen = longest_interval(intervals.filter(F.col("part") == part), keys)
    return chosen.select(*keys, F.explode("transitions").alias(time))


def usable_documents(documents: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents that parsed without an error and have a line."""
    fine = documents.filter(~F.coalesce("raised_error", F.lit(False)))
    return fine.join(lines.select(*keys).distinct(), list(keys), "left_semi")
