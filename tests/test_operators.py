import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import edits, geometry, highlights, ids, images, match, repair, scroll, temporal


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_part_intervals(spark):
    frames = spark.createDataFrame([("s", t, p) for t, p in zip([0, 10, 20, 30], "AABA", strict=True)], "s string, t int, part string")
    duration = spark.createDataFrame([("s", 34)], "s string, duration int")
    assert rows(temporal.part_intervals(frames, ["s"], "t", "part", duration=duration), "start_time", "end_time", "part") == [(0, 10, "A"), (20, 20, "B"), (30, 34, "A")]
    assert [r[0] for r in rows(temporal.changes(frames, ["s"], "t", "part"), "t")] == [0, 20, 30]


def test_gap_windows(spark):
    refs = spark.createDataFrame([("d", i, f"l{i}") for i in range(20)], "doc_name string, line_idx int, line string")
    lines = spark.createDataFrame([(1, i, "x") for i in range(6)], "doc_id int, line_idx int, text string")
    anchored = spark.createDataFrame([(1, 0, "d", 5, 2), (1, 3, "d", 8, 2)], "doc_id int, line_idx int, doc_name string, ref_idx int, anchors int")
    got = rows(match.gap_windows(lines, anchored, refs, ["doc_id"]), "line_idx", "lo", "hi")
    assert got == [(1, 6, 7), (2, 7, 7), (4, 9, 9), (5, 9, 10)]
    close = anchored.withColumn("ref_idx", F.when(F.col("line_idx") == 3, 0).otherwise(5))
    early = {r[0]: r[1:] for r in rows(match.gap_windows(lines, close, refs, ["doc_id"]), "line_idx", "lo", "hi")}
    assert early[1] == (0, -1)  # an empty window: no descending sequence comes of it
    assert match.gap_candidates(match.gap_windows(lines, close, refs, ["doc_id"]).filter("line_idx = 1"), lines, refs, ["doc_id"]).count() == 0


def test_evidence_and_ties(spark):
    refs = spark.createDataFrame([("a", 0, "red green"), ("b", 0, "green red"), ("c", 0, "blue x")], "doc_name string, line_idx int, line string")
    words = spark.createDataFrame([(1, 0, 0, "red"), (1, 0, 1, "red"), (1, 0, 2, "x"), (2, 0, 0, "x")], "doc_id int, line_idx int, word_idx int, text string")
    best = match.best_document(match.document_evidence(words, match.document_dictionary(refs), ["doc_id"]), ["doc_id"])
    assert rows(best, "doc_id", "doc_name", "score") == [(1, "a", 6)]


def test_lines_are_matched_repaired_and_one_each(spark):
    refs = spark.createDataFrame([("d", i, t) for i, t in enumerate(["the quick brown fox", "jumps over a lazy dog", "while rain falls down", "upon every roof"])], "doc_name string, line_idx int, line string")
    seen = ["the quick brown fox", "jump over a lazv dog", "while rain falls down", "upqn evry roof", "garbage"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(seen)], "doc_id int, line_idx int, text string")
    words = lines.select("doc_id", "line_idx", F.posexplode(S.tokens("text")).alias("word_idx", "text"))
    best = match.best_document(match.document_evidence(words, match.document_dictionary(refs), ["doc_id"]), ["doc_id"])
    matched = match.match_lines(lines, words, best, refs, ["doc_id"])
    assert rows(matched, "line_idx", "updated_line", "in_first_step") == [
        (0, "the quick brown fox", True), (1, "jumps over a lazy dog", True), (2, "while rain falls down", True), (3, "upon every roof", False), (4, "", False),
    ]
    boxed_lines = lines.select("doc_id", "line_idx", S.bbox(F.lit(0), F.col("line_idx") * 20, F.length("text") * 8, F.col("line_idx") * 20 + 16).alias("bbox"))
    text_of = {i: t for i, t in enumerate(seen)}
    boxes = []
    for i, t in text_of.items():
        at = 0
        for j, w in enumerate(t.split(" ")):
            boxes.append((1, i, j, w, float(at), i * 20.0, at + 8.0 * len(w), i * 20.0 + 16))
            at += 8 * (len(w) + 1)
    placed = spark.createDataFrame(boxes, "doc_id int, line_idx int, word_idx int, text string, l double, t double, r double, b double").select("doc_id", "line_idx", "word_idx", "text", S.bbox("l", "t", "r", "b").alias("bbox"))
    fixed = repair.repair_words(placed, boxed_lines, matched, ["doc_id"])
    got = {}
    for r in fixed.orderBy("line_idx", "word_idx").collect():
        got.setdefault(r["line_idx"], []).append(r["text"])
    assert got == {0: "the quick brown fox".split(), 1: "jumps over a lazy dog".split(), 2: "while rain falls down".split(), 3: "upon every roof".split(), 4: [""]}


def test_char_widths_rescale_repeats():
    assert repair.calibrate([("aab", 30.0)], 5.0) == pytest.approx({"a": 5 * 4.0, "b": 10.0})
    assert repair.calibrate([], 5.0) == {}


def test_repair_keeps_words_off_screen():
    job = repair.LineRepair(["quick", "brown"], [50, 110], [100, 160], "the quick brown fox")
    pairing, _ = job.solve(job.estimated_spans({}, 10.0, 50.0, 1.0))
    assert job.repaired(pairing) == ["quick", "brown"]
    blank = repair.LineRepair(["quick"], [0], [10], "")
    assert blank.repaired(blank.solve([])[0]) == [""]


def test_space_width_defaults(spark):
    lines = spark.createDataFrame([(1, 0)], "doc_id int, line_idx int").withColumn("bbox", S.bbox(F.lit(0), F.lit(0), F.lit(9), F.lit(16)))
    words = lines.withColumn("word_idx", F.lit(0)).withColumn("text", F.lit("x"))
    assert rows(geometry.space_width(lines, words, ["doc_id"]), "space_width") == [(5.0,)]


def test_line_centres_skip_close_ones(spark):
    tops = [0.0, 3.0, 7.0, 11.0, 40.0]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(tops)], "doc_id int, line_idx int, top double").select("doc_id", "line_idx", S.bbox(F.lit(0), "top", F.lit(9), F.col("top") + 16).alias("bbox"))
    assert rows(geometry.line_centres(lines, ["doc_id"]), "centre") == [(8.0,), (19.0,), (48.0,)]


def test_frames_with_many_coloured_words_are_rejected(spark):
    words = spark.createDataFrame([("s", t, i < n) for t, n in ((1, 7), (2, 6)) for i in range(10)], "s string, t int, c boolean")
    assert rows(highlights.usable_frames(words, ["s"], "t", F.col("c")), "t") == [(2,)]


def log_by_hand(frames, default="white"):
    state, out = {}, []
    for t, group, colour in frames:
        former = [state.get(g, default) for g in group]
        if all(f != colour for f in former):
            out += [(t, g, colour, f) for g, f in zip(group, former, strict=True)]
            state.update({g: colour for g in group})
    return out


def test_change_logs(spark):
    single = [(t, [1], c) for t, c in enumerate(["white", "yellow", "yellow", "white"])]
    df = spark.createDataFrame([("s", t, g, c, "w") for t, g, c in single], "s string, t int, global_ids array<int>, highlight string, text string")
    flat = df.withColumn("gid", F.col("global_ids")[0])
    native = rows(highlights.change_log(flat, ["s"], "gid", "highlight", ["t"]), "t", "former")
    assert native == [(1, "white"), (3, "yellow")]
    assert rows(highlights.grouped_change_log(df, ["s"], ["t"]), "t", "gid", "color") == [(1, 1, "yellow"), (3, 1, "white")]
    grouped = [(0, [1], "yellow"), (1, [1, 2], "yellow"), (2, [2], "yellow"), (3, [1, 2], "blue")]
    df = spark.createDataFrame([("s", t, g, c, "w") for t, g, c in grouped], "s string, t int, global_ids array<int>, highlight string, text string")
    got = rows(highlights.grouped_change_log(df, ["s"], ["t"]), "t", "gid", "color")
    assert got == sorted((t, g, c) for t, g, c, _ in log_by_hand(grouped))
    assert (1, 2, "yellow") not in got


def test_native_and_grouped_logs_agree(spark):
    rng = random.Random(4)
    data = [("s", t, rng.randrange(5), rng.choice(["white", "yellow", "blue"])) for t in range(300)]
    df = spark.createDataFrame(data, "s string, t int, gid int, highlight string").withColumn("global_ids", F.array("gid")).withColumn("text", F.lit("w"))
    a = rows(highlights.change_log(df, ["s"], "gid", "highlight", ["t"]), "t", "gid", "highlight", "former")
    b = [(t, g, c, f[0]) for t, g, c, f in rows(highlights.grouped_change_log(df, ["s"], ["t"]), "t", "gid", "color", "former")]
    assert a == b


def test_carried_grid_ignores_what_is_before_it(spark):
    events = spark.createDataFrame([("s", 1, "yellow"), ("s", 5, "blue"), ("s", 7, "white")], "s string, tick int, c string")
    bounds = spark.createDataFrame([("s", 3, 8)], "s string, lo int, hi int")
    assert rows(temporal.carried_grid(events, ["s"], "tick", "c", bounds, "white"), "tick", "c") == [(3, "white"), (4, "white"), (5, "blue"), (6, "blue"), (7, "white"), (8, "white")]


def test_sample_grid_ends_at_the_duration(spark):
    df = spark.createDataFrame([("a", 25.5), ("b", 20.0), ("c", 0.0)], "s string, d double")
    got = rows(temporal.sample_grid(df, ["s"], "d"), "s", "t")
    assert got == [("a", 0.0), ("a", 10.0), ("a", 20.0), ("a", 25.5), ("b", 0.0), ("b", 10.0), ("b", 20.0), ("c", 0.0)]


def test_asof_step_and_clip(spark):
    left = spark.createDataFrame([("s", t) for t in (0, 5, 9)], "s string, t int")
    right = spark.createDataFrame([("s", 1, "a"), ("s", 5, "b")], "s string, u int, v string")
    got = {r["t"]: r["v"] for r in temporal.asof(left, right, ["s"], "t", "u", "v").collect()}
    assert got == {0: None, 5: "b", 9: "b"}
    series = spark.createDataFrame([("s", 1.0, 1.0), ("s", 2.0, 5.0)], "s string, t double, v double")
    assert rows(temporal.step_series(series, ["s"], "t", ["v"]), "t", "v") == [(1.0, 1.0), (1.95, 1.0), (2.0, 5.0)]
    assert rows(temporal.clip(series, ["s"], "t", 1.5, 1.8), "t", "v") == [(1.5, 1.0), (1.8, 5.0)]


def test_bisection_finds_lasting_changes():
    value = lambda t: "a" if t < 12.34 else "b" if t < 50 else "c"
    assert temporal.bisect_changes(value, 0, 100) == [12.4, 50.0]


def test_stitching_and_maps(spark):
    refs = spark.createDataFrame([("d", i, f"line {i}") for i in range(4)], "doc_name string, line_idx int, line string")
    boxes = [(f, i, f"line {i}", shift + 20.0 * i, shift + 20.0 * i + 16) for f, shift in ((1, 0.0), (2, -20.0)) for i in range(4)]
    lines = spark.createDataFrame([("s", "d", f, i, t, a, b) for f, i, t, a, b in boxes], "s string, doc_name string, f int, line_idx int, updated_line string, top double, bottom double").select("s", "doc_name", "f", "line_idx", "updated_line", S.bbox(F.lit(0), "top", F.lit(9), "bottom").alias("bbox"))
    page = scroll.stitched_lines(scroll.adjacent_lines(lines, refs, ["s"], ["f"]), refs, ["s"])
    got = [(r["top"], r["bottom"]) for r in page.orderBy("line_idx").collect()]
    assert got == [(-10.0, 6.0), (10.0, 26.0), (30.0, 46.0), (50.0, 66.0)]
    maps = scroll.scroll_positions(scroll.frame_maps(lines, page, ["s", "f"], ["s"]), 100)
    assert [(r["f"], pytest.approx(r["multiplier"]), pytest.approx(r["top"])) for r in maps.orderBy("f").collect()] == [(1, 1.0, -10.0), (2, 1.0, 10.0)]
    assert scroll.frame_maps(lines.filter("line_idx < 3"), page, ["s", "f"], ["s"]).count() == 0


def test_missing_lines_leave_nulls_behind(spark):
    refs = spark.createDataFrame([("d", i, f"line {i}") for i in range(3)], "doc_name string, line_idx int, line string")
    lines = spark.createDataFrame([("s", "d", 1, i, f"line {i}", 20.0 * i) for i in (0, 2)], "s string, doc_name string, f int, line_idx int, updated_line string, top double").select("s", "doc_name", "f", "line_idx", "updated_line", S.bbox(F.lit(0), "top", F.lit(9), F.col("top") + 16).alias("bbox"))
    page = scroll.stitched_lines(scroll.adjacent_lines(lines, refs, ["s"], ["f"]), refs, ["s"]).orderBy("line_idx").collect()
    assert [r["top"] for r in page] == [0.0, None, None]


def test_ids_by_bounds_and_guesses(spark):
    positions = ids.word_positions(spark.createDataFrame([("d", 0, "a b a"), ("d", 1, "c  a")], "doc_name string, line_idx int, line string"))
    assert rows(positions, "gid", "word") == [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, ""), (5, "a")]
    index = {"a": [0, 2, 5], "b": [1], "c": [3]}
    job = ids.Assignment(["a", "b", "a", "c", "a"], index)
    assert job.solve() == "solved"
    assert job.ids == [[0], [1], [2], [3], [5]]
    guess = ids.Assignment(["a", "a"], index)
    assert guess.solve() == "solved"
    assert guess.ids == [[0], [2]]
    lost = ids.Assignment(["a", "zzz", "c", "a"], index)
    assert lost.solve() in ("failed words", "unsolved")
    assert lost.ids[1] == [-1]
    assert lost.ids[2:] == [[3], [5]]
    pair = ids.Assignment(["b a"], index)
    pair.solve()
    assert pair.ids == [[1, 2]]


def test_assign_ids(spark):
    words = spark.createDataFrame([(1, "d", i, w) for i, w in enumerate(["a", "b", " ", "a", "c"])], "doc_id int, doc_name string, reading_idx int, text string")
    positions = ids.word_positions(spark.createDataFrame([("d", 0, "a b a c")], "doc_name string, line_idx int, line string"))
    assert rows(ids.assign_ids(words, positions, ["doc_id"]), "reading_idx", "global_ids", "status") == [(0, [0], "solved"), (1, [1], "solved"), (3, [2], "solved"), (4, [3], "solved")]


def test_equal_mass_bins(spark):
    df = spark.createDataFrame([(v,) for v in [0, 0, 0, 1, 1, 2, 3, 9]], "v int")
    assert geometry.equal_mass_cutoffs(df, "v", 2).first()[0] == [1.0]
    assert rows(geometry.equal_mass_labels(df, "v", 2), "v", "label")[-1] == (9, 1)


def test_heatmap_fills_zeros(spark):
    df = spark.createDataFrame([(5.0, 5.0), (250.0, 5.0), (None, 3.0)], "x double, y double")
    assert rows(geometry.heatmap(df, "x", "y"), "y_idx", "x_idx", "count") == [(0, 0, 1), (0, 1, 0), (0, 2, 1)]


def test_heatmap_keeps_negative_cells(spark):
    df = spark.createDataFrame([(5.0, -150.0), (-1.0, 5.0)], "x double, y double")
    got = rows(geometry.heatmap(df, "x", "y"), "y_idx", "x_idx", "count")
    assert got == [(-2, -1, 0), (-2, 0, 1), (-1, -1, 0), (-1, 0, 0), (0, -1, 1), (0, 0, 0)]


def test_transitions_within_intervals(spark):
    """Touching and overlapping intervals each get the times within their ends, whatever the buckets."""
    rng = random.Random(9)
    spans = [("s", f"p{i}", a, a + d) for i, (a, d) in enumerate((rng.uniform(0, 900), rng.choice([0.0, 5.0, 400.0])) for _ in range(25))] + [("s", "x", 100.0, 160.0), ("s", "y", 160.0, 160.0), ("t", "z", 0.0, 9.0)]
    times = [("s", rng.uniform(0, 1000)) for _ in range(60)] + [("s", 100.0), ("s", 160.0)]
    a = spark.createDataFrame(spans, "s string, part string, start_time double, end_time double")
    b = spark.createDataFrame(times, "s string, t double")
    want = {p: sorted(t for k, t in times if k == s and lo <= t <= hi) for s, p, lo, hi in spans}
    for bucket in (60.0, 7.0, 5000.0):
        assert {r["part"]: r["transitions"] for r in temporal.with_transitions(a, b, ["s"], "t", bucket).collect()} == want


def test_a_line_that_cannot_be_repaired_is_a_row(spark):
    lines = spark.createDataFrame([(1, 0), (2, 0)], "doc_id int, line_idx int").withColumn("bbox", S.bbox(F.lit(0), F.lit(0), F.lit(99), F.lit(16)))
    box = S.bbox(F.when(F.col("doc_id") == 1, F.col("word_idx") * 50.0), F.lit(0.0), F.when(F.col("doc_id") == 1, F.col("word_idx") * 50.0 + 40), F.lit(16.0))
    words = spark.createDataFrame([(d, 0, i, w) for d in (1, 2) for i, w in enumerate(["quick", "brown"])], "doc_id int, line_idx int, word_idx int, text string").withColumn("bbox", box)
    matched = spark.createDataFrame([(1, 0, "quick brown"), (2, 0, "quick brown")], "doc_id int, line_idx int, updated_line string")
    fixed = repair.repair_words(words, lines, matched, ["doc_id"])
    got = {(r["doc_id"], r["word_idx"]): (r["text"], r["error"] is None) for r in fixed.collect()}
    assert got == {(1, 0): ("quick", True), (1, 1): ("brown", True), (2, 0): (None, False), (2, 1): (None, False)}
    status = {r["doc_id"]: r["status"] for r in repair.document_status(fixed, ["doc_id"]).collect()}
    assert status[1] == "repaired"
    assert status[2].startswith("failed: ")


def test_reports_are_read_as_they_are_written(spark):
    events = spark.createDataFrame([("s", 1.5, g, "w", [g], "yellow", ["white"]) for g in (-1, 3)] + [("s", 2.0, 4, None, [4], "blue", ["white"])], "s string, t double, gid int, text string, id_group array<int>, color string, former array<string>")
    report = highlights.report_json(events, ["s"], "t").select(F.from_json("report", highlights.REPORT).alias("r"))
    kept = report.select(F.transform_values("r", lambda _, v: highlights.without_failed(v)).alias("r")).first()["r"]
    assert {k: [(e["id"], e["former colors"]) for e in v] for k, v in kept.items()} == {"1.5": [(3, ["white"])], "2.0": [(4, ["white"])]}


def test_edits(spark):
    words = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "white")], "d int, index int, text string, highlight string")
    changed = spark.createDataFrame([(1, 1, "B", "yellow")], "d int, index int, text string, highlight string")
    assert rows(edits.apply_edits(words, changed, ["d", "index"]), "index", "text", "edited_by_human") == [(0, "a", False), (1, "B", True)]
    log = spark.createDataFrame([(1, 1, "old", 1), (1, 1, "new", 2)], "d int, index int, text string, n int")
    assert rows(edits.latest_edits(log, ["d", "index"], ["n"]), "text") == [("new",)]


def test_geometry_json_and_text(spark):
    words = spark.createDataFrame([(1, 0, 0, "a", 0.0, 20.0), (1, 0, 1, "b", 30.0, 90.0), (1, 1, 0, "c", 2000.0, 2010.0)], "d int, line_idx int, word_idx int, text string, l double, r double")
    words = words.select("d", "line_idx", "word_idx", "text", F.lit(None).cast("string").alias("highlight"), S.bbox("l", F.lit(0), "r", F.lit(16)).alias("bbox"))
    listed = geometry.editable_words(words, ["d"], 1280, 720)
    assert rows(listed, "index", "text", "highlight") == [(0, "b", "white"), (1, "a", "white")]
    assert '"text":"b"' in geometry.words_json(listed, ["d"]).first()["words"]
    assert geometry.document_text(words, ["d"]).first()["text"] == "a b\nc"


# images


def test_frames_differ():
    a = np.full((100, 200, 3), 200, np.uint8)
    b = a.copy()
    assert not images.frames_differ(a, b)
    b[30:31, :, :] = 0
    assert not images.frames_differ(a, b)
    b[20:60, 50:120, :] = 0
    assert images.frames_differ(a, b)


def test_word_highlight():
    image = np.full((40, 80, 3), 253, np.uint8)
    image[:, :] = (253, 250, 193)
    image[12:20, 20:40] = (10, 10, 10)
    found = images.word_highlight(image, 15, 8, 50, 30)
    assert found["highlight"] == "yellow"
    assert found["background"] == [253, 250, 193]
    assert images.word_highlight(image, 15, 8, 80, 30) is None
    assert images.light_by_threshold(image).sum() == 40 * 80 - 160
    assert images.nearest_pair((71, 148, 241), (245, 245, 245)) == ("dark blue", True)


def test_colour_share_does_not_wrap():
    image = np.zeros((2, 2, 3), np.uint8)
    assert images.colour_share(image, (1, 1, 1), 3) == 1.0
    assert images.colour_share(image, (255, 255, 255), 2) == 0.0
    assert images.upscale(image).shape == (4, 4, 3)
    assert images.classify_frame(np.full((800, 900, 3), 255, np.uint8)) == "paper or splash page"


def test_image_udfs(spark):
    image = np.full((40, 80, 3), 245, np.uint8)
    image[10:20, 20:40] = 10
    df = spark.createDataFrame(pd.DataFrame({"content": [image.tobytes()], "previous": [None], "height": [40], "width": [80]}), "content binary, previous binary, height int, width int")
    assert images.differing_frames(df).first()["differs"]
    part = images.cropped(df, x=(10, 30), y=(None, 20)).first()
    assert (part["height"], part["width"]) == (20, 20)
    assert (images.to_array(part["content"], 20, 20) == image[:20, 10:30]).all()
    boxed = df.withColumn("boxes", F.array(S.bbox(F.lit(15), F.lit(8), F.lit(50), F.lit(30))))
    assert images.highlight_words(boxed).first()["found"][0]["highlight"] == "white"
