import json

import pytest
from pyspark.sql import functions as F

from lectern.operators.temporal import with_transitions
from lectern.sinks import writers
from lectern.sources import hocr, sessions

PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en"><head><title></title></head><body>
<div class='ocr_page' id='page_1' title='image "x"; bbox 0 0 100 100'><div class='ocr_carea'><p class='ocr_par'>
<span class='ocr_line' id='line_1_1' title="bbox 1 2 30 12; baseline 0 -6"><span class='ocrx_word' id='word_1_1' title='bbox 1 2 10 12; x_wconf 93'>The</span> <span class='ocrx_word' id='word_1_2' title='bbox 12 2 30 12; x_wconf 80'><strong>café—x</strong></span></span>
<span class='ocr_line' id='line_1_2' title="bbox 1 20 30 32"><span class='ocrx_word' id='word_1_3' title='bbox 1 20 30 32; x_wconf 1'>A&amp;B</span></span>
</p></div></div></body></html>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "00-10.5.hocr").write_text(PAGE)
    return tmp_path


def test_hocr(spark, folder):
    pages = hocr.read_hocr(spark, f"file://{folder}")
    assert pages.first()["t"] == 10.5
    lines = hocr.hocr_lines(pages).orderBy("line_idx").collect()
    assert [(r["line_id"], tuple(r["bbox"])) for r in lines] == [("line_1_1", (1.0, 2.0, 30.0, 12.0)), ("line_1_2", (1.0, 20.0, 30.0, 32.0))]
    assert lines[0]["title"]["baseline"] == "0 -6"
    words = hocr.hocr_words(pages).orderBy("line_idx", "word_idx").collect()
    assert [(r["line_idx"], r["word_idx"], r["text"], r["text_ascii"], r["word_id"]) for r in words] == [(0, 0, "The", "The", "word_1_1"), (0, 1, "café-x", "caf-x", "word_1_2"), (1, 0, "A&B", "A&B", "word_1_3")]
    assert words[0]["title"]["x_wconf"] == "93"


def test_elements_depth_first(spark, folder):
    pages = hocr.read_hocr(spark, f"file://{folder}")
    every = hocr.hocr_elements(pages).orderBy("idx").collect()
    assert [r["name"] for r in every] == ["html", "head", "title", "body", "div", "div", "p", "span", "span", "span", "strong", "span", "span"]
    words = hocr.hocr_elements(pages, F.col("kind") == "ocrx_word").orderBy("idx").collect()
    assert [(r["element_id"], r["title"]) for r in words] == [("word_1_1", "bbox 1 2 10 12; x_wconf 93"), ("word_1_2", "bbox 12 2 30 12; x_wconf 80"), ("word_1_3", "bbox 1 20 30 32; x_wconf 1")]
    assert [r["title"] for r in every if r["kind"] == "ocr_page"] == ['image "x"; bbox 0 0 100 100']


@pytest.mark.parametrize(("n_lines", "n_words"), [(45, 453), (52, 687)])
def test_pages_of_usual_size(spark, tmp_path, n_lines, n_words):
    """Two columns of paragraphs: every line and word is found, with its box and in its place."""
    share = [n_words // n_lines + (i < n_words % n_lines) for i in range(n_lines)]
    parts, want = [], []
    for i, n in enumerate(share):
        x, y = (0, i * 20) if i < n_lines // 2 else (900, (i - n_lines // 2) * 20)
        spans = []
        for j in range(n):
            text = f"w{i}-{j}" if j % 5 else f"<em>n{i}&amp;{j}</em>"
            spans.append(f"<span class='ocrx_word' id='word_1_{len(want) + 1}' title='bbox {x + j * 50} {y} {x + j * 50 + 40} {y + 14}; x_wconf {60 + j}'>{text}</span>")
            want.append((i, j, f"w{i}-{j}" if j % 5 else f"n{i}&{j}", (float(x + j * 50), float(y), float(x + j * 50 + 40), float(y + 14))))
        line = f"<span class='ocr_line' id='line_1_{i + 1}' title=\"bbox {x} {y} {x + 800} {y + 14}; baseline 0 -3\">{' '.join(spans)}\n</span>"
        parts.append(f"<p class='ocr_par'>{line}" if i % 6 == 0 else line)
        if i % 6 == 5 or i == n_lines - 1:
            parts.append("</p>")
        if i == n_lines // 2:
            parts.append("</p></div><div class='ocr_carea'><p class='ocr_par'>" if i % 6 != 5 else "</div><div class='ocr_carea'>")
    body = "\n".join(parts)
    page = PAGE[: PAGE.index("<p class='ocr_par'>")] + body + "</div></div></body></html>"
    (tmp_path / "01-02.5.hocr").write_text(page)
    pages = hocr.read_hocr(spark, f"file://{tmp_path}")
    words = hocr.hocr_words(pages).orderBy("line_idx", "word_idx").collect()
    assert [(r["line_idx"], r["word_idx"], r["text"], tuple(r["bbox"])) for r in words] == want
    assert len({r["line_idx"] for r in words}) == n_lines
    assert {r["t"] for r in words} == {62.5}


def test_hocr_round_trip(spark, folder, tmp_path):
    words = hocr.hocr_words(hocr.read_hocr(spark, f"file://{folder}"))
    out = writers.hocr_text(words, ["path"]).first()["value"]
    again = tmp_path / "again"
    again.mkdir()
    (again / "00-01.0.hocr").write_text(out)
    back = hocr.hocr_words(hocr.read_hocr(spark, f"file://{again}")).orderBy("line_idx", "word_idx").collect()
    assert [r["text"] for r in back] == ["The", "café-x", "A&B"]
    assert tuple(back[0]["bbox"]) == (1.0, 2.0, 10.0, 12.0)


def test_first_attribute(spark, folder):
    words = hocr.hocr_words(hocr.read_hocr(spark, f"file://{folder}"))
    found = hocr.first_attribute(words, ["path"], ["line_idx", "word_idx"], F.col("title")["x_wconf"], "conf")
    assert found.first()["conf"] == "93"


def test_videos_and_metadata(spark, tmp_path):
    for name in ("a/one.mp4", "two.MOV", ".hidden.mp4", "note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {r["session_id"] for r in sessions.video_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a_one", "two"}
    (tmp_path / "s1").mkdir()
    (tmp_path / "s2").mkdir()
    (tmp_path / "s1" / "metadata.json").write_text(json.dumps([{"part": "form", "start_time": 0, "end_time": 5.5, "transitions": [1.0, 2.0]}], indent=2))
    (tmp_path / "s2" / "metadata.json").write_text("[")
    rows = sessions.read_metadata(spark, f"file://{tmp_path}").collect()
    assert [tuple(r) for r in rows] == [("s1", "form", 0.0, 5.5, [1.0, 2.0])]


def test_corpus_and_lengths(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one two \n\n three\n")
    lines = sessions.read_corpus(spark, f"file://{tmp_path}")
    assert [(r["doc_name"], r["line_idx"], r["line"]) for r in lines.orderBy("line_idx").collect()] == [("d.txt", 0, "one two"), ("d.txt", 1, ""), ("d.txt", 2, "three")]
    assert [r["line"] for r in sessions.filled_lines(lines).orderBy("line_idx").collect()] == ["one two", "three"]
    assert [r["length"] for r in sessions.word_lengths(lines).orderBy("word_idx").collect()] == [3, 3, 5]
    assert [r["length"] for r in sessions.word_lengths(lines, compat=True).orderBy("word_idx").collect()] == [3, 4, 1, 5]


def test_session_documents(spark):
    transitions = spark.createDataFrame([("s", 1.0), ("s", 2.0), ("s", 3.0)], "session_id string, t double")
    files = spark.createDataFrame([("s", 1.0, "a"), ("s", 2.0, "b")], "session_id string, t double, path string")
    edited = spark.createDataFrame([("s", 2.0, "B")], "session_id string, t double, path string")
    done = spark.createDataFrame([("s", 1.0)], "session_id string, t double")
    assert [r["path"] for r in sessions.session_documents(transitions, files, edited, done).collect()] == ["B"]
    assert writers.last_frames(files, transitions.filter("t < 3")).first()["path"] == "b"


def test_reports_and_caches(spark, tmp_path):
    (tmp_path / "report.json").write_text(json.dumps({"1.5": [{"id": 3, "text": "w", "id_group": [3, 4], "color": "yellow", "former colors": ["white"]}]}))
    r = sessions.read_report(spark, f"file://{tmp_path}/report.json").first()
    assert (r["time"], r["gid"], r["id_group"], r["former"]) == (1.5, 3, [3, 4], ["white"])
    (tmp_path / "scroll.csv").write_text("Time,Top,Bottom\n1.0,2.0,3.0\n")
    assert tuple(sessions.read_scroll(spark, f"file://{tmp_path}/scroll.csv").first()) == (1.0, 2.0, 3.0)
    (tmp_path / "stitched.json").write_text('[["a", 1.0, 2.5], ["b", 3, 4]]')
    assert [tuple(x) for x in sessions.read_stitched(spark, f"file://{tmp_path}/stitched.json").collect()] == [(0, "a", 1.0, 2.5), (1, "b", 3.0, 4.0)]


def test_stages_run_once(spark, tmp_path):
    all_sessions = spark.createDataFrame([("a",), ("b",)], "session_id string")
    seen = []
    for _ in range(2):
        writers.run_stage(spark, f"file://{tmp_path}/ledger", "ocr", all_sessions, lambda todo: seen.append(sorted(r[0] for r in todo.collect())))
    assert seen == [["a", "b"], []]


def test_stage_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, v int")
    writers.write_stage(df, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2
    writers.write_csv(df, f"file://{tmp_path}/c")
    writers.write_json(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2


def test_transitions_of_intervals(spark):
    spans = spark.createDataFrame([("s", "a", 0.0, 5.0), ("s", "b", 6.0, 9.0)], "session_id string, part string, start_time double, end_time double")
    times = spark.createDataFrame([("s", 5.0), ("s", 1.0), ("s", 7.0)], "session_id string, t double")
    got = {r["part"]: r["transitions"] for r in with_transitions(spans, times, ["session_id"], "t").collect()}
    assert got == {"a": [1.0, 5.0], "b": [7.0]}


def test_interchange_files_round_trip(spark, tmp_path):
    page = spark.createDataFrame([("s", 0, 'say "a", b', 1.0, 2.5), ("s", 1, "c", 3.0, None)], "session_id string, line_idx int, line string, top double, bottom double")
    (tmp_path / "p.json").write_text(writers.stitched_json(page, ["session_id"]).first()["value"])
    assert [tuple(r) for r in sessions.read_stitched(spark, f"file://{tmp_path}/p.json").collect()] == [(0, 'say "a", b', 1.0, 2.5), (1, "c", 3.0, None)]
    spans = spark.createDataFrame([("s", "b", 6.0, 9.0, [7.0]), ("s", "a", 0.0, 5.0, [1.0])], "session_id string, part string, start_time double, end_time double, transitions array<double>")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "metadata.json").write_text(writers.metadata_json(spans).first()["value"])
    assert sorted(tuple(r) for r in sessions.read_metadata(spark, f"file://{tmp_path}").collect()) == sorted(tuple(r) for r in spans.collect())
    from lectern.operators.highlights import report_json

    events = spark.createDataFrame([("s", 1.5, 3, "w", [3, 4], "yellow", ["white", "white"])], "s string, t double, gid int, text string, id_group array<int>, color string, former array<string>")
    (tmp_path / "r.json").write_text(report_json(events, ["s"], "t").first()["report"])
    assert [tuple(r) for r in sessions.read_report(spark, f"file://{tmp_path}/r.json").collect()] == [(1.5, 3, "w", [3, 4], "yellow", ["white", "white"])]
    (tmp_path / "g.csv").write_text("GazeX,GazeY,Timestamp,MediaTime\n1,-2,12:00,0.5\n")
    assert tuple(sessions.read_gaze(spark, f"file://{tmp_path}/g.csv").first()) == (1.0, -2.0, "12:00", 0.5)
