"""Chains of rows, followed by pointer doubling: as many rounds as the logarithm of the longest chain, whatever a document holds.

Every round is a stage table, so a lost executor costs one round. Of numbers with one gap a key the chain is followed where the key's numbers are.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..sinks.scratch import cut


def roots(nodes: DataFrame, node: str, before: str) -> DataFrame:
    """(node, root): where each node's chain starts. `before` is the node that it follows, null at a start; no two follow the same one.

    A node that still moves points a power of two back, so the keys of a round's join are different ones, however long the chain.
    A predecessor that is not there counts as a start. Circles are not allowed.
    """
    table = cut(nodes.select(F.col(node).alias("node"), F.coalesce(before, node).alias("ptr"), F.col(before).isNull().alias("done")))
    while not table.filter("NOT done").isEmpty():
        ahead = table.select(F.col("node").alias("at"), F.col("ptr").alias("to"), F.col("done").alias("ends"))
        moved = table.filter("NOT done").join(ahead, F.col("ptr") == F.col("at"), "left")
        moved = moved.select("node", F.coalesce("to", "ptr").alias("ptr"), F.coalesce("ends", F.lit(True)).alias("done"))
        table = cut(table.filter("done").unionByName(moved))
    return table.select(F.col("node").alias(node), F.col("ptr").alias("root"))


@F.pandas_udf(ArrayType(DoubleType()))
def kept(values: pd.Series, gaps: pd.Series) -> pd.Series:
    """Of ascending values the first, and each that is its row's gap or more above the last one kept."""
    out = []
    for all_values, gap in zip(values, gaps, strict=True):
        found: list[float] = []
        for v in all_values.tolist():
            # undefined values are the greatest, as in Spark's order
            if not found or not v < found[-1] + gap:
                found.append(v)
        out.append(found)
    return pd.Series(out, dtype=object)


def distinct_values(values: DataFrame, keys: Sequence[str], value: Column, gap: Column) -> DataFrame:
    """(keys, values, gap): a key's distinct values, ascending, without nulls, and `gap`, an aggregate; without one nothing is far enough.

    One array in one task, of eight bytes a value. So nothing is written, and rows stay where they were dealt by key.
    """
    found = values.groupBy(*keys).agg(F.array_sort(F.collect_set(value.cast("double"))).alias("values"), F.coalesce(gap, F.lit(float("inf"))).alias("gap"))
    return found.filter(F.size("values") > 0)


def last_kept(values: DataFrame, keys: Sequence[str], value: str, gap: str) -> DataFrame:
    """(keys, value): from the least distinct value on, each that is `gap` (a column, one a key) or more above the last one kept.

    Nulls are not values. The chain is followed where the key's values are, one after the other.
    """
    found = distinct_values(values, keys, F.col(value), F.max(gap))
    return found.select(*keys, F.explode(kept("values", "gap")).alias(value)).withColumn(value, F.col(value).cast(values.schema[value].dataType))
