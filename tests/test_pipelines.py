from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.plans import pipelines

TEXT = ["the quick brown fox", "jumps over a lazy dog", "while rain falls down", "upon every slate roof", "and nobody hears anything"]


def test_recording_to_report_and_scroll(spark):
    refs = spark.createDataFrame([("d", i, t) for i, t in enumerate(TEXT)], "doc_name string, line_idx int, line string")
    boxes = []
    for k, t in enumerate((0.0, 10.0, 20.0)):
        for i, line in enumerate(TEXT):
            at = 0.0
            for j, w in enumerate(line.split(" ")):
                noisy = w.replace("z", "2") if k == 1 else w
                boxes.append(("s", t, i, j, noisy, at, i * 40.0 - k * 10, at + 16.0 * len(w), i * 40.0 - k * 10 + 32, "yellow" if k == 2 and w == "rain" else "white"))
                at += 16 * (len(w) + 1)
    raw = spark.createDataFrame(boxes, "session_id string, t double, line_idx int, word_idx int, text string, l double, top double, r double, b double, highlight string")
    words = raw.select("session_id", "t", "line_idx", "word_idx", "text", S.bbox("l", "top", "r", "b").alias("bbox"))
    lines = raw.groupBy("session_id", "t", "line_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("l").alias("l"), F.min("top").alias("top"), F.max("r").alias("r"), F.max("b").alias("b"))
    lines = lines.select("session_id", "t", "line_idx", "text", S.bbox("l", "top", "r", "b").alias("bbox"))
    cleaned = pipelines.clean_documents(lines, words, refs)
    assert cleaned.document.first()["doc_name"] == "d"
    fixed = {(r["t"], r["line_idx"], r["word_idx"]): r["text"] for r in cleaned.words.collect()}
    assert {t for (_, i, j), t in fixed.items() if (i, j) == (1, 3)} == {"lazy"}
    assigned = pipelines.with_ids(cleaned, refs)
    assert {r["status"] for r in assigned.collect()} == {"solved"}
    coloured = assigned.join(raw.select("session_id", "t", "line_idx", "word_idx", "highlight"), ["session_id", "t", "line_idx", "word_idx"])
    events = pipelines.highlight_report(coloured)
    assert [(r["t"], r["gid"], r["text"], r["color"], r["former"]) for r in events.collect()] == [(20.0, 10, "rain", "yellow", ["white"])]
    spans = spark.createDataFrame([("s", g, 2 * g, 2 * g + 2) for g in range(8, 12)], "session_id string, gid int, start int, end int")
    bounds = spark.createDataFrame([("s", 199, 200)], "session_id string, lo int, hi int")
    runs = sorted(tuple(r)[1:] for r in pipelines.highlight_matrix(events, spans, bounds).collect())
    assert runs == [(199, 16, 24, "white"), (200, 16, 20, "white"), (200, 20, 22, "yellow"), (200, 22, 24, "white")]
    page, positions = pipelines.scrolling(cleaned, refs, 100)
    assert page.filter("top IS NULL").count() == 0
    tops = [r["top"] for r in positions.orderBy("t").collect()]
    assert len(tops) == 3
    assert tops[0] < tops[1] < tops[2]


def test_intervals(spark):
    frames = spark.createDataFrame([("s", float(t), p, d) for t, p, d in [(0, "a", True), (10, "a", False), (20, "b", True), (30, "b", True)]], "session_id string, t double, part string, differs boolean")
    durations = spark.createDataFrame([("s", 34.0)], "session_id string, duration double")
    got = sorted(tuple(r)[1:] for r in pipelines.find_intervals(frames, durations).collect())
    assert got == [("a", 0.0, 10.0, [0.0]), ("b", 20.0, 34.0, [20.0, 30.0])]
