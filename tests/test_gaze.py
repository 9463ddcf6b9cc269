from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import gaze


def test_gaze_is_mapped_by_the_frame_on_screen(spark):
    samples = spark.createDataFrame([("s", 0.5, 10.0, 10.0), ("s", 1.5, 10.0, 10.0), ("s", 1.6, -1.0, 5.0)], "s string, time double, gaze_x double, gaze_y double")
    frames = spark.createDataFrame([("s", 0.0), ("s", 1.0)], "s string, t double")
    shown = gaze.with_frames(gaze.valid_gaze(samples), frames, ["s"])
    assert sorted((r["time"], r["t"]) for r in shown.collect()) == [(0.5, 0.0), (1.5, 1.0)]
    lines = spark.createDataFrame([("s", t, i, f"l{i}", 20.0 * i) for t in (0.0, 1.0) for i in range(4)], "s string, t double, line_idx int, updated_line string, top double").select("s", "t", "line_idx", "updated_line", S.bbox(F.lit(0), "top", F.lit(100), F.col("top") + 10).alias("bbox"))
    page = spark.createDataFrame([(i, f"l{i}", 40.0 * i) for i in range(4)], "line_idx int, line string, top double").select("line_idx", "line", S.bbox(F.lit(50), "top", F.lit(250), F.col("top") + 20).alias("bbox"))
    corners = gaze.frame_corners(gaze.same_lines(lines, page, ["s", "t"]), ["s", "t"])
    mapped = gaze.map_to_page(shown, corners, ["s", "t"], 300, 300)
    assert {(r["mapped_x"], r["mapped_y"]) for r in mapped.collect()} == {(70.0, 20.0)}
    areas = gaze.dwell_areas(corners, ["s", "t"], 100, 70).collect()
    assert {(r["left"], r["top"], r["right"], r["bottom"]) for r in areas} == {(50.0, 0.0, 250.0, 140.0)}
    assert gaze.frame_corners(gaze.same_lines(lines.filter("line_idx < 3"), page, ["s", "t"]), ["s", "t"]).count() == 0


def test_nearest_segments(spark):
    labelled = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 2, 0.0, 50.0, 0.0, 60.0)], "f int, label_id int, x1 double, y1 double, x2 double, y2 double")
    found = spark.createDataFrame([(1, 7, 0.0, 1.0, 10.0, 1.0), (1, 8, 0.0, 5.0, 10.0, 5.0)], "f int, segment_id int, x1 double, y1 double, x2 double, y2 double")
    near = gaze.nearest_segments(found, labelled, ["f"])
    assert {(r["label_id"], r["segment_id"], r["dist"]) for r in near.collect()} == {(1, 7, 2.0), (2, None, None)}
    assert gaze.assignment_total(near).first()[0] == 10_002.0


def test_pairs_of_segments_are_no_rows_and_the_first_id_wins_a_tie(spark):
    side = "x1 double, y1 double, x2 double, y2 double"
    labelled = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 0.0), (2, 1, 0.0, 0.0, 1.0, 0.0), (None, 1, 0.0, 0.0, 1.0, 0.0)], f"f int, label_id int, {side}")
    found = spark.createDataFrame([(1, 9, 0.0, 2.0, 1.0, 2.0), (1, 4, 0.0, -2.0, 1.0, -2.0), (1, 3, None, 0.0, 1.0, 0.0), (None, 5, 0.0, 0.0, 1.0, 0.0)], f"f int, segment_id int, {side}")
    near = gaze.nearest_segments(found, labelled, ["f"])
    assert near.columns == ["f", "label_id", "segment_id", "dist"]
    assert {(r["f"], r["segment_id"], r["dist"]) for r in near.collect()} == {(1, 4, 4.0), (2, None, None), (None, None, None)}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "array_min" in plan
