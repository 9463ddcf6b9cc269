"""Whitening of embeddings by a tiled covariance.

Entries become integers, x = floor(scale * entry), and the covariance is fitted on each distinct x vector once (an offset that every
x carries cancels everywhere and is left out). Its dimension pairs fall into tiles. Rows of the fit list are cut into row
blocks and those into column blocks; column blocks of one row block meet on it, each pair is multiplied for its tile, and
the products are summed per tile. The driver assembles the tiles into one matrix, which depends on the dimension only, and
decomposes it.

All sums of the fit list are exact integers. Products are of entries less their dimension's floored mean, so nothing is lost to an
offset; what the flooring leaves (under one) is corrected in the assembled matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, internal_id, external_id, materialise, quoted, record_batches
from .vectors import packed, parts_of, scaled, unpacked, usual_length, vector_rows

SCALE, COMPONENTS = 64, 16
#: Dimensions of a tile's side, and rows of a row block.
TILE, ROW_BLOCK = 32, 2048
#: The assembled matrix is of this many dimensions at most (128 MB of doubles).
MAX_DIMENSION = 4096
#: Components whose eigenvalue is a smaller part of the largest, times the dimension, have no whitened value.
LEAST = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n vectors with sums S, unit components by falling eigenvalue, their share of the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers, without offset, projected on the components over the root of the eigenvalue; nan for null components."""
        floor = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, ((x - floor).astype(np.float64) - rest) @ self.components / np.sqrt(self.values), np.nan)


def _pack(length: int, scale: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = scaled(batch.column(0), length, scale)
            yield pa.record_batch([pa.array(packed(x), pa.binary())], ["x"])

    return pack


def _sum(length: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * length
        for batch in parts_of(batches, ROW_BLOCK):
            x = unpacked(batch.column(0), length)
            n += len(x)
            total = [t + s for t, s in zip(total, x.sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.record_batch([pa.array(range(-1, length), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], ["i", "s"])

    return add


def _columns(length: int, floor: list[int], tile: int) -> Callable:
    """Row blocks of the fit list less the floored means, as column blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        means = np.array(floor, np.int64)
        starts = range(0, length, tile)
        for batch in parts_of(batches, ROW_BLOCK):
            z = unpacked(batch.column(0), length) - means
            blocks = [packed(z[:, a : a + tile].reshape(1, -1))[0] for a in starts]
            key = [(task << 32) + number] * len(starts)
            number += 1
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array([len(z)] * len(starts), pa.int32()), pa.array(blocks, pa.binary())], ["row_block", "c", "rows", "block"])

    return cut


def _emit(tiles: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (a, b), m in tiles.items():
        yield pa.record_batch([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["a", "b", "tile"])


def _multiply(length: int, tile: int) -> Callable:
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in parts_of(batches, 16):
            for r in batch.to_pylist():
                left, right = (unpacked(pa.array([r[x]], pa.binary()), r["rows"] * min(tile, length - r[c] * tile)).reshape(r["rows"], -1).astype(np.float64) for x, c in (("left", "a"), ("right", "b")))
                product = left.T @ right
                key = (r["a"], r["b"])
                tiles[key] = tiles[key] + product if key in tiles else product
        yield from _emit(tiles)

    return multiply


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles: dict[tuple[int, int], np.ndarray] = {}
    for batch in parts_of(batches, 16):
        for r in batch.to_pylist():
            key, m = (r["a"], r["b"]), np.frombuffer(r["tile"])
            tiles[key] = tiles[key] + m if key in tiles else m
    yield from _emit(tiles)


_TILES = "a int, b int, tile binary"


def tiled_covariance(fit: DataFrame, n: int, sums: list[int], tile: int = TILE) -> np.ndarray:
    """The covariance, divisor n, of packed rows `x`: n rows with the given sums.

    `fit` is a table that gives the same rows in the same order when a task is repeated: row blocks are numbered by task. A task
    holds one row block and one sum per tile, whatever the number of rows.
    """
    length = len(sums)
    floor = [s // n for s in sums]
    blocks = fit.select("x").mapInArrow(_columns(length, floor, tile), "row_block long, c int, rows int, block binary")
    left = blocks.select("row_block", F.col("c").alias("a"), "rows", F.col("block").alias("left"))
    right = blocks.select(F.col("row_block").alias("of"), F.col("c").alias("b"), F.col("block").alias("right"))
    pairs = left.join(right, (F.col("row_block") == F.col("of")) & (F.col("a") <= F.col("b"))).select("a", "b", "rows", "left", "right")
    partial = pairs.mapInArrow(_multiply(length, tile), _TILES)
    out = np.zeros((length, length))
    for r in partial.repartition("a", "b").mapInArrow(_add, _TILES).toLocalIterator():
        a, b = r["a"] * tile, r["b"] * tile
        m = np.frombuffer(r["tile"]).reshape(min(tile, length - a), min(tile, length - b))
        out[a : a + m.shape[0], b : b + m.shape[1]] = m
        out[b : b + m.shape[1], a : a + m.shape[0]] = m.T
    rest = np.array([(s - f * n) / n for s, f in zip(sums, floor, strict=True)])
    return out / n - np.outer(rest, rest)


def _spread(model: Whitening) -> Callable:
    """Sums and products of the whitened fit list."""
    k = len(model.values)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in parts_of(batches, ROW_BLOCK):
            w = model.whiten(unpacked(batch.column(0), len(model.sums)))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.divmod(np.arange(total.size), k)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    return measure


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity; null if no component can be whitened."""
    k = len(model.values)
    total = np.zeros((k + 1, k))
    for r in fit.select("x").mapInArrow(_spread(model), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"]
    mean = total[k] / model.n
    off = np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(model.values > 0, model.values > 0)]
    return float(off.max()) if off.size else None


def fit_whitening(rows: DataFrame, length: int, components: int = COMPONENTS, scale: int = SCALE, tile: int = TILE) -> Whitening | None:
    """The whitening of rows with a vector `v`; null if none counts."""
    if length > MAX_DIMENSION:
        raise ValueError(f"vectors of {length} entries: the covariance is assembled for {MAX_DIMENSION} at most")
    if not length:
        return None
    fit = materialise(rows.select("v").mapInArrow(_pack(length, scale), "x binary").distinct(), "fit", rows)
    sums = {r["i"]: int(r["s"]) for r in fit.mapInArrow(_sum(length), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n, of = sums[-1], [sums[i] for i in range(length)]
    covariance = tiled_covariance(fit, n, of, tile)
    values, vectors = np.linalg.eigh(covariance)
    k = min(components, length)
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(covariance))
    usable = np.where(values > max(float(values[0]), 0.0) * LEAST * length, values, 0.0)[:k]
    model = Whitening(n, tuple(of), np.ascontiguousarray(vectors[:, :k]), usable, np.maximum(values[:k], 0.0) / trace if trace > 0 else np.full(k, np.nan))
    model = Whitening(model.n, model.sums, model.components, model.values, model.explained, identity_error(fit, model))
    discard(fit)
    return model


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Exact sums of (n * x - S) ** 2."""
    floor = np.array([s // n for s in sums], np.int64)
    z, rest = x - floor, np.array([s % n for s in sums], np.int64)
    largest = n * (int(np.abs(z).max(initial=0)) + 1)
    if largest * largest * max(1, x.shape[1]) < 1 << 63:
        y = n * z - rest
        return (y * y).sum(axis=1).tolist()
    return [sum((n * v - r) ** 2 for v, r in zip(row, rest.tolist(), strict=True)) for row in z.tolist()]


_OUT = pa.schema([("did", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("deviation_text", pa.string())])
_DDL = "did long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def _apply(model: Whitening | None, length: int, scale: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, ROW_BLOCK):
            if model is None:
                return
            at, x = scaled(batch.column(1), length, scale)
            k, m = len(model.values), len(at)
            exact = _deviation(x, model.n, model.sums)
            whole = np.repeat(np.arange(m), k)
            fits = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            spilled = pa.array([None if v < 1 << 63 else str(v) for v in exact], pa.string())
            columns = {
                "did": batch.column(0).take(pa.array(at)).take(pa.array(whole)), "component": np.tile(np.arange(1, k + 1), m), "n": np.full(m * k, model.n), "deviation": fits.take(pa.array(whole)),
                "whitened": pa.array(model.whiten(x).ravel(), from_pandas=True), "explained": pa.array(np.tile(model.explained, m), from_pandas=True),
                "identity_error": pa.array([model.identity_error] * (m * k), pa.float64()), "deviation_text": spilled.take(pa.array(whole)),
            }
            yield from record_batches(_OUT, columns)

    return apply


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, tile: int = TILE) -> DataFrame:
    """For each row whose vector counts, a row per component: did, component, n, deviation, whitened, explained, identity_error, deviation_text.

    A vector counts if neither it nor an entry of it is null, infinite or not a number, and it has the table's commonest length (of
    equally common ones the greatest; empty vectors have no components). Scaled entries beyond 2**46 are held there. Repeated
    rows and null ids come out as they are; equal vectors count once in the fit.
    A deviation beyond a long is null there and in deviation_text. A component without spread (n = 1, or fewer
    different directions than components) has a null whitened; explained is null if nothing spreads. Equal eigenvalues leave their
    components' directions open: they are those of one decomposition, the same for all rows. An empty table gives no rows; names of
    other columns don't matter.
    """
    rows = vector_rows(table, vec_col, did=internal_id(quoted(id_col)))
    length = usual_length(rows)
    model = fit_whitening(rows, length, components, scale, tile)
    return rows.select("did", "v").mapInArrow(_apply(model, length, scale), _DDL)


def op11(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings).select(external_id("did").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
