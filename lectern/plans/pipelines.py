"""The stages end to end. What several steps read is cut off by a checkpoint; the caller writes what a stage returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import scale_bbox, tick
from ..operators import geometry, highlights, ids, match, repair, scroll, temporal
from ..sinks.scratch import cut

FRAME = ["session_id", "t"]


@dataclass
class Cleaned:
    """Corrected documents of sessions."""

    document: DataFrame  # (session_id, doc_name)
    lines: DataFrame  # (session_id, t, line_idx, updated_line, in_first_step, doc_name, bbox)
    words: DataFrame  # (session_id, t, line_idx, word_idx, ocr_text, text, pair_offset, bbox)


def find_intervals(frames: DataFrame, durations: DataFrame, label: str = "part") -> DataFrame:
    """(session_id, part, start_time, end_time, transitions) of classified frames (session_id, t, part, differs)."""
    spans = cut(temporal.part_intervals(frames, ["session_id"], "t", label, duration=durations))
    moved = frames.filter("differs").select("session_id", "t")
    starts = spans.select("session_id", F.col("start_time").alias("t"))
    return temporal.with_transitions(spans, moved.unionByName(starts).distinct(), ["session_id"], "t")


def clean_documents(lines: DataFrame, words: DataFrame, ref_lines: DataFrame, per: str = "session", stop_at_lines: bool = False, scale: float = 0.5) -> Cleaned:
    """Match every frame's lines with the session's text (or each frame's own, per="document") and repair their words.

    lines (session_id, t, line_idx, text, bbox), words (session_id, t, line_idx, word_idx, text, bbox). Boxes are scaled back from the
    enlarged images that were read. Frames in which no line is anchored are left out, as documents that could not be repaired.
    """
    evidence = match.document_evidence(words, match.document_dictionary(ref_lines), FRAME)
    best = cut(match.best_document(evidence, FRAME))
    if per == "session":
        chosen = match.session_document(best, "session_id", "t")
        best = cut(words.select(*FRAME).distinct().join(chosen, "session_id"))
    else:
        chosen = best.select("session_id", "doc_name").distinct()
    matched = cut(match.match_lines(lines, words, best, ref_lines, FRAME))
    boxes = lines.select(*FRAME, "line_idx", scale_bbox("bbox", scale).alias("bbox"))
    out_lines = matched.join(boxes, [*FRAME, "line_idx"]).join(best.select(*FRAME, "doc_name"), FRAME)
    if stop_at_lines:
        word_boxes = words.select(*FRAME, "line_idx", "word_idx", scale_bbox("bbox", scale).alias("bbox"))
        out_words = words.select(*FRAME, "line_idx", "word_idx", F.col("text").alias("ocr_text"), "text", F.lit(None).cast("int").alias("pair_offset")).join(word_boxes, [*FRAME, "line_idx", "word_idx"])
    else:
        out_words = repair.repair_words(words, lines, matched, FRAME).withColumn("bbox", scale_bbox("bbox", scale))
    return Cleaned(chosen, cut(out_lines), cut(out_words))


def with_ids(cleaned: Cleaned, ref_lines: DataFrame, fail_policy: str = "skip") -> DataFrame:
    """(session_id, t, line_idx, word_idx, text, bbox, global_ids, status) of the words with a text, in reading order."""
    lines = cleaned.lines.select(*FRAME, "line_idx", "bbox")
    ordered = cut(geometry.reading_order(cleaned.words.filter("text <> ''"), lines, FRAME).join(cleaned.lines.select(*FRAME, "doc_name").distinct(), FRAME))
    found = ids.assign_ids(ordered, ids.word_positions(ref_lines), FRAME, fail_policy).drop("text")
    return ordered.join(found, [*FRAME, "reading_idx"])


def highlight_report(words: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """The change log of words (session_id, t, text, global_ids, highlight), without frames that are mostly coloured.

    part (session_id, t) limits it to the frames of an interval.
    """
    rows = words.filter(F.col("highlight").isNotNull())
    if part is not None:
        rows = rows.join(part, FRAME, "left_semi")
    kept = highlights.usable_frames(rows, ["session_id"], "t", F.col("highlight") != highlights.DEFAULT_COLOUR)
    order = ["t", "line_idx", "word_idx"]
    return highlights.grouped_change_log(rows.join(kept, FRAME, "left_semi"), ["session_id"], order)


def highlight_matrix(events: DataFrame, spans: DataFrame, bounds: DataFrame) -> DataFrame:
    """(session_id, tick, start, end, color): the state of every word on every tick, as runs of one colour.

    spans (session_id, gid, start, end) of the words, bounds (session_id, lo, hi) in ticks.
    """
    ticked = events.withColumn("tick", tick("t"))
    per_word = spans.select("session_id", "gid").join(bounds, "session_id")
    grid = temporal.carried_grid(ticked, ["session_id", "gid"], "tick", "color", per_word, highlights.DEFAULT_COLOUR, ["t"])
    return highlights.highlight_runs(grid, spans, ["session_id"], "gid", "tick", "color")


def scrolling(cleaned: Cleaned, ref_lines: DataFrame, frame_height: float, normalise: bool = False) -> tuple[DataFrame, DataFrame]:
    """(page, scroll): each session's stitched page, and where each frame lies on it."""
    adjacent = scroll.adjacent_lines(cleaned.lines.drop("ref_idx"), ref_lines, ["session_id"], ["t"])
    page = cut(scroll.stitched_lines(adjacent, ref_lines, ["session_id"], normalise=normalise))
    maps = scroll.frame_maps(cleaned.lines, page, FRAME, ["session_id"])
    return page, scroll.scroll_positions(maps, frame_height)
