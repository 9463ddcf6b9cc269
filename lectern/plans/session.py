"""Planner settings that the deep plans of this library need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Says that a session was made here, and bytes of compressed input for a task of an exchange.
OWN, TASK_BYTES = "spark.lectern.own", 4 << 20


def configure(spark: SparkSession) -> SparkSession:
    """A session of the same application with the caller's settings and these; the caller's own session stays as it is.

    Constraint propagation grows exponentially with chains of aliases: plans of a second then take minutes to optimise.

    What it gives up, inferred null checks on join keys, the inner joins here do without.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.constraintPropagation.enabled", "false")
    # what is dealt by document is not dealt again to be joined by document and line
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set(OWN, "true")
    return own


def scale(spark: SparkSession, rows: DataFrame) -> None:
    """More exchange partitions for a session made by configure(), if these stored rows have more bytes than TASK_BYTES for each: what a task holds and
    sorts would grow with the input else, and spill. Adaptive execution joins those that turn out to be small."""
    if spark.conf.get(OWN, None) == "true":
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if (n := -(-size // TASK_BYTES)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
