"""Line segments by Hough voting, on tables of edge cells.

Every cell votes, for each angle, for the line through it: (theta, rho) with x * cos + y * sin = rho, rounded. A line with votes enough
that has no neighbour with more is a peak. The cells on a peak, in order along it, fall into segments where the gaps between them are too
wide. Only cells are shuffled, as runs of a raster's row, to the task that has their frame: votes, a row a cell and angle, are counted
there an angle at a time, so they are neither exchanged nor written, and a frame takes memory for its cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .match import spread

FIELDS = ["theta", "rho", "x1", "y1", "x2", "y2", "cells"]
SEGMENTS = "array<struct<theta:int,rho:int,x1:double,y1:double,x2:double,y2:double,cells:bigint>>"


def angles(steps: int) -> list[tuple[int, float, float]]:
    """(number, cosine, sine) of `steps` directions in half a turn."""
    return [(i, math.cos(math.pi * i / steps), math.sin(math.pi * i / steps)) for i in range(steps)]


def edge_cells(pixels: DataFrame, keys: Sequence[str], value: str, least: float) -> DataFrame:
    """(keys, x, y) of the cells whose value differs by `least` or more from that of the cell to the left or above."""
    left = F.lag(value).over(Window.partitionBy(*keys, "y").orderBy("x"))
    above = F.lag(value).over(Window.partitionBy(*keys, "x").orderBy("y"))
    near = lambda before: F.coalesce(F.abs(F.col(value) - before) >= least, F.lit(False))
    return pixels.withColumns({"__l": left, "__a": above}).filter(near(F.col("__l")) | near(F.col("__a"))).select(*keys, "x", "y")


def _peaks(x: np.ndarray, y: np.ndarray, steps: int, threshold: int) -> dict[int, list[int]]:
    """Distances by angle of the lines with `threshold` votes or more that none of their eight neighbours beats; of equal neighbours the first by
    angle and distance. The angle goes round: after the last one comes the first, with the distance's sign turned."""
    votes: dict[tuple[int, int], int] = {}
    for theta, c, s in angles(steps):
        rho, n = np.unique(_rho(x, y, c, s), return_counts=True)
        many = n >= threshold
        votes.update(((theta, r), v) for r, v in zip(rho[many].tolist(), n[many].tolist(), strict=True))
    found: dict[int, list[int]] = {}
    for (theta, rho), v in votes.items():
        own = (v, -theta, -rho)
        for dt in (-1, 0, 1):
            turned = not 0 <= theta + dt < steps
            t = (theta + dt) % steps
            for r in (rho - 1, rho, rho + 1):
                n = (t, -r if turned else r)
                if (dt or r != rho) and n in votes and (votes[n], -n[0], -n[1]) >= own:
                    break
            else:
                continue
            break
        else:
            found.setdefault(theta, []).append(rho)
    return found


def _rho(x: np.ndarray, y: np.ndarray, c: float, s: float) -> np.ndarray:
    return np.floor(x * c + y * s + 0.5).astype(np.int64)


def _frame_segments(x: np.ndarray, y: np.ndarray, steps: int, threshold: int, least_length: float, most_gap: float) -> list[np.ndarray]:
    """theta, rho, x1, y1, x2, y2, cells of one frame's segments, by angle, distance and place."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    if len(x):
        fresh = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        x, y = x[fresh], y[fresh]
    found = _peaks(x, y, steps, threshold) if len(x) >= threshold else {}
    parts = []
    for theta, c, s in angles(steps):
        if theta not in found:
            continue
        rho = _rho(x, y, c, s)
        on = np.flatnonzero(np.isin(rho, found[theta]))
        along = y[on] * c - x[on] * s
        order = np.lexsort((y[on], x[on], along, rho[on]))
        on, along = on[order], along[order]
        first = np.flatnonzero(np.r_[True, (rho[on][1:] != rho[on][:-1]) | (along[1:] - along[:-1] > most_gap)])
        last = np.r_[first[1:], len(on)] - 1
        long = along[last] - along[first] >= least_length
        a, b = on[first[long]], on[last[long]]
        parts.append([np.full(len(a), theta), rho[a], x[a], y[a], x[b], y[b], (last - first + 1)[long]])
    return [np.concatenate(column) for column in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 7


def run_segments(runs: DataFrame, keys: Sequence[str], steps: int = 180, threshold: int = 20, least_length: float = 10.0, most_gap: float = 2.0) -> DataFrame:
    """segments() of cells in runs (keys, x, y, more): the cell (x, y) and `more` cells to its right, one apart."""
    rows = runs.select(*keys, F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("more").cast("long").alias("more")).alias("run"))
    rows = rows.filter("run.x IS NOT NULL AND run.y IS NOT NULL").dropna(subset=list(keys))
    frames = spread(rows, *keys).groupBy(*keys).agg(F.collect_list("run").alias("runs"))

    @F.arrow_udf(SEGMENTS)
    def find(batch: pa.Array) -> pa.Array:
        ends, run = batch.offsets.to_numpy(), batch.values
        x, y, more = (run.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        found, sizes = [], [0]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            n = more[a:b] + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            segment = _frame_segments(np.repeat(x[a:b], n) + step, np.repeat(y[a:b], n), steps, threshold, least_length, most_gap)
            found.append(segment)
            sizes.append(sizes[-1] + len(segment[0]))
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int64()]
        columns = [pa.array(np.concatenate(c).astype(kind.to_pandas_dtype()), kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, FIELDS))

    each = frames.select(*keys, F.posexplode(find("runs")).alias("segment_id", "s"))
    return each.select(*keys, "segment_id", *[F.col(f"s.{f}").alias(f) for f in FIELDS])


def segments(cells: DataFrame, keys: Sequence[str], steps: int = 180, threshold: int = 20, least_length: float = 10.0, most_gap: float = 2.0) -> DataFrame:
    """(keys, segment_id, theta, rho, x1, y1, x2, y2, cells): the pieces of the peaks' lines, from the end that comes first along the line to the other.

    segment_id numbers a frame's segments by angle, distance and place. Repeated cells count once; cells without a place don't.
    """
    return run_segments(cells.select(*keys, "x", "y", F.lit(0).alias("more")), keys, steps, threshold, least_length, most_gap)
