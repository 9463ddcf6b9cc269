"""Gaze on the page: validity, the frame on screen, the map from screen to page; segments next to labelled ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import affine_2d, segment_distance
from .match import spread
from .temporal import asof

FAR, UNMATCHED = 1e7, 10_000.0


def valid_gaze(gaze: DataFrame, x: str = "gaze_x", y: str = "gaze_y") -> DataFrame:
    """Without samples that the tracker marks as lost: negative coordinates or none."""
    return gaze.filter((F.col(x) >= 0) & (F.col(y) >= 0))


def with_frames(gaze: DataFrame, frames: DataFrame, keys: Sequence[str], time: str = "time", frame_time: str = "t") -> DataFrame:
    """gaze with the latest frame at or before each sample."""
    shown = frames.select(*keys, frame_time, F.col(frame_time).alias("__shown"))
    return asof(gaze, shown, keys, time, frame_time, "__shown").drop("__shown")


def same_lines(frame_lines: DataFrame, page_lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_idx, bbox, page_box): frame lines with the first page line of equal text; frames need each of theirs to have one."""
    first = page_lines.groupBy("line").agg(F.min_by("bbox", "line_idx").alias("page_box"))
    return frame_lines.join(first, frame_lines["updated_line"] == first["line"]).select(*keys, "line_idx", "bbox", "page_box")


def frame_corners(pairs: DataFrame, keys: Sequence[str], least: int = 4) -> DataFrame:
    """(keys, a, b): the first line's upper left and the last line's lower right corner, on the frame and on the page; frames with fewer
    than `least` lines have none."""
    agg = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("line_idx", "bbox", "page_box")).alias("a"), F.max(F.struct("line_idx", "bbox", "page_box")).alias("b"))
    return agg.filter(F.col("n") >= least).drop("n")


def _mapped(points: DataFrame, corners: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    a, b = F.col("__c.a"), F.col("__c.b")
    upper, lower = lambda box: (box["left"], box["top"]), lambda box: (box["right"], box["bottom"])
    px, py = affine_2d(F.col(x), F.col(y), upper(a["bbox"]), lower(b["bbox"]), upper(a["page_box"]), lower(b["page_box"]))
    joined = points.join(corners.select(*keys, F.struct("a", "b").alias("__c")), list(keys))
    return joined.withColumn("mapped_x", px).withColumn("mapped_y", py).drop("__c")


def map_to_page(gaze: DataFrame, corners: DataFrame, keys: Sequence[str], width: float, height: float, x: str = "gaze_x", y: str = "gaze_y") -> DataFrame:
    """gaze with `mapped_x`, `mapped_y` on the page; samples that fall outside it are left out."""
    mapped = _mapped(gaze, corners, keys, x, y)
    return mapped.filter(F.col("mapped_x").between(0, width) & F.col("mapped_y").between(0, height))


def dwell_areas(corners: DataFrame, keys: Sequence[str], view_width: float, view_height: float) -> DataFrame:
    """(keys, left, top, right, bottom): the part of the page that each frame's view shows."""
    points = corners.select(*keys, F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(view_width)).alias("x1"), F.lit(float(view_height)).alias("y1"))
    low = _mapped(points, corners, keys, "x0", "y0").withColumnsRenamed({"mapped_x": "left", "mapped_y": "top"})
    return _mapped(low, corners, keys, "x1", "y1").select(*keys, "left", "top", F.col("mapped_x").alias("right"), F.col("mapped_y").alias("bottom"))


def nearest_segments(found: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label_id, segment_id, dist): for each labelled segment (label_id, x1, y1, x2, y2) of a frame the nearest found one
    (segment_id, ...), none if all are turned too far. A frame's found segments, which it bounds, are one row that its labelled ones meet: pairs are
    no rows, and are not sorted."""
    side = ("x1", "y1", "x2", "y2")
    per_frame = spread(found.select(*keys, "segment_id", *side), *keys).groupBy(*keys).agg(F.collect_list(F.struct("segment_id", *side)).alias("__found"))

    def near(b: Column) -> Column:
        return F.struct(segment_distance([F.col(s) for s in side], [b[s] for s in side], far=FAR).alias("dist"), b["segment_id"].alias("segment_id"))

    best = F.array_min(F.filter(F.transform("__found", near), lambda p: p["dist"] < FAR))
    met = spread(labelled.select(*keys, "label_id", *side), *keys).join(per_frame, list(keys), "left")
    return met.select(*keys, "label_id", best.alias("b")).select(*keys, "label_id", "b.segment_id", "b.dist")


def assignment_total(nearest: DataFrame) -> DataFrame:
    """One row, `total`: the sum of distances, with a fixed penalty for what has no match."""
    return nearest.agg(F.sum(F.coalesce("dist", F.lit(UNMATCHED))).alias("total"))
