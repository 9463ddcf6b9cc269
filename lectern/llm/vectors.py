"""Embedding vectors as integers: which rows count, and their packed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Integers beyond this are held at it, so that sums of a block of rows fit a long.
LIMIT = 1 << 46


def finite(vector: Column) -> Column:
    """Whether a vector counts: it is there and no entry is null, infinite or not a number."""
    inside = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & inside, F.lit(False))


def usual_length(rows: DataFrame, vector: str = "v") -> int:
    """The commonest length among vectors that count, of equally common ones the greatest; 0 if there are none."""
    lengths = rows.filter(finite(F.col(vector))).groupBy(F.size(vector).alias("n")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return top[0]["n"] if top else 0


def vector_rows(table: DataFrame, vec_col: str, **columns: Column) -> DataFrame:
    """The given columns and the vector as `v`, an array of doubles."""
    return table.select(*[c.alias(name) for name, c in columns.items()], F.col(quoted(vec_col)).cast("array<double>").alias("v"))


def scaled(column: pa.Array, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, floor(scale * entry) of each) of the vectors that count and have the given length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)  # a null entry is nan
    ends = np.cumsum(sizes)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = np.flatnonzero((sizes == length) & (wrong[ends] == wrong[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False))
    places = (ends - sizes)[keep][:, None] + np.arange(length)
    return keep, np.clip(np.floor(values[places] * float(scale)), -float(LIMIT), float(LIMIT)).astype(np.int64)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row of integers in the fewest bytes an entry that hold all of its own: equal rows are equal bytes."""
    out: list[bytes] = [b""] * len(rows)
    if not rows.size:
        return out
    low, high = rows.min(axis=1), rows.max(axis=1)
    least = np.zeros(len(rows), np.int64)
    for size in (1, 2, 4):
        bound = 1 << (8 * size - 1)
        least += (low < -bound) | (high >= bound)
    for step, size in enumerate((1, 2, 4, 8)):
        at = np.flatnonzero(least == step)
        data, width = rows[at].astype(f"<i{size}").tobytes(), size * rows.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = data[k * width : (k + 1) * width]
    return out


def unpacked(column: pa.Array, length: int) -> np.ndarray:
    """The integers of packed rows."""
    values = column.to_pylist()
    out = np.empty((len(values), length), np.int64)
    sizes = np.array([len(v) // length for v in values])
    for size in (1, 2, 4, 8):
        at = np.flatnonzero(sizes == size)
        if len(at):
            out[at] = np.frombuffer(b"".join(values[i] for i in at.tolist()), f"<i{size}").reshape(-1, length)
    return out


def parts_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
