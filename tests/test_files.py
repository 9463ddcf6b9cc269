"""hOCR files as a data source, and named files as a sink that commits."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringStartsWith

from lectern.sinks import frame_files, writers
from lectern.sources import hocr, hocr_files

PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml"><body><div class='ocr_page' title='bbox 0 0 100 100'><p class='ocr_par'>
<span class='ocr_line' id='l1' title="bbox 1 2 30 12; baseline 0 -6"><span class='ocrx_word' id='w1' title='bbox 1 2 10 12; x_wconf 93'>The</span> <span class='ocrx_word x' id='w2' title='bbox 12 2 30 12'><strong>café</strong>-%d</span></span>
<span class='ocr_line' id='l2' title="no box"><span class='ocrx_word' id='w3' title='bbox -1 20.5 30 32'>A&amp;B</span></span>
</p></div></body></html>"""


@pytest.fixture
def folder(tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        for k in range(6):
            (tmp_path / s / f"0{k % 2}-{k * 10}.5.hocr").write_text(PAGE % k)
    (tmp_path / "s1" / "09-00.0.hocr").write_text(PAGE[: len(PAGE) // 2])
    (tmp_path / "s1" / "notes.txt").write_text("no page")
    (tmp_path / "s1" / "nameless.hocr").write_text("<html/>")
    return tmp_path


def test_pages_are_read(spark, folder):
    hocr_files.register(spark)
    rows = spark.read.format("hocr").load(str(folder))
    assert rows.filter("kind = 'ocr_line'").count() == 24 and rows.filter("kind = 'ocrx_word'").count() == 36
    page = rows.filter("t = 10.5 + 60").orderBy("path", "line_idx", "word_idx").limit(5).collect()
    assert [(r["kind"], r["line_idx"], r["word_idx"], r["element_id"], r["text"], r["left"], r["bottom"]) for r in page] == [
        ("ocr_line", 0, None, "l1", None, 1.0, 12.0), ("ocrx_word", 0, 0, "w1", "The", 1.0, 12.0), ("ocrx_word", 0, 1, "w2", "café-1", 12.0, 12.0), ("ocr_line", 1, None, "l2", None, None, None), ("ocrx_word", 1, 0, "w3", "A&B", -1.0, 32.0),
    ]
    wrong = rows.filter("kind = 'error'").collect()
    assert len(wrong) == 1 and wrong[0]["path"].endswith("09-00.0.hocr") and wrong[0]["error"] and wrong[0]["text"] is None


def test_words_are_those_of_the_text_reader(spark, folder):
    """The same words as from whole texts, page by page."""
    hocr_files.register(spark)
    mine = spark.read.format("hocr").load(str(folder)).filter("kind = 'ocrx_word'").select("t", "line_idx", "word_idx", "element_id", "text")
    other = hocr.hocr_words(hocr.read_hocr(spark, f"file://{folder}").filter("t < 500")).select("t", "line_idx", "word_idx", "word_id", "text")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, other.collect()))


def test_character_references_and_nested_words():
    import io

    page = PAGE.replace("The", "&#84;h&nbsp;e &lt;") % 1
    assert [r[5] for r in hocr_files.parse(io.BytesIO(page.encode())) if r[0] == "ocrx_word"] == ["The <", "café-1", "A&B"]
    assert [r[5] for r in hocr_files.parse(io.BytesIO(page.encode()), words=False)] == [None, None]


def test_a_filter_opens_only_its_files(spark, folder, monkeypatch):
    reader = hocr_files.HocrReader({"path": f"file://{folder}"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("t",), 70.0), LessThan(("t",), 100.0), StringStartsWith(("path",), "x"), EqualTo(("kind",), "ocr_line")]))
    assert [type(f) for f in left] == [StringStartsWith]
    planned = [p for part in reader.partitions() for p in part.paths]
    assert sorted(os.path.basename(p) for p in planned) == ["01-10.5.hocr", "01-10.5.hocr", "01-30.5.hocr", "01-30.5.hocr"]
    rows = list(reader.read(hocr_files.Files(tuple(planned[:1]))))
    assert [r[2] for r in rows] == ["ocr_line", "ocr_line"]
    hocr_files.register(spark)
    got = spark.read.format("hocr").load(str(folder)).filter("t >= 70 AND t < 100 AND kind = 'ocrx_word'")
    assert got.count() == 12 and {r["t"] for r in got.select("t").collect()} == {70.5, 90.5}
    assert spark.read.format("hocr").load(str(folder)).filter("t IN (70.5, 20.5)").filter("kind = 'ocr_line'").count() == 8
    assert spark.read.format("hocr").load(str(folder)).filter("t IS NULL").count() == 0  # a page without lines


def test_files_are_dealt_by_size(folder):
    whole = hocr_files.HocrReader({"path": f"file://{folder}"}).partitions()
    assert len(whole) == 1 and len(whole[0].paths) == 14
    split = hocr_files.HocrReader({"path": f"file://{folder}", "taskbytes": 3 * (hocr_files.OPEN_BYTES + 2000)}).partitions()
    assert max(len(p.paths) for p in split) <= 3 and sum(len(p.paths) for p in split) == 14


def files_below(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f)).read() for d, _, fs in os.walk(path) for f in fs if not f.startswith((".", "_"))}


def frames(spark, n, tag):
    return spark.range(n).repartition(3).select(F.format_string("s%d/0%d-0.hocr", F.col("id") % 2, "id").alias("name"), F.format_string(f"{tag} %d", "id").alias("value"))


def test_named_files_are_written_and_rewritten(spark, tmp_path):
    frame_files.register(spark)
    out = str(tmp_path / "out")
    for _ in range(2):
        frames(spark, 6, "a").write.format("frames").mode("overwrite").save(out)
        assert files_below(out) == {f"s{i % 2}/0{i}-0.hocr": f"a {i}" for i in range(6)}
    frames(spark, 2, "b").write.format("frames").mode("append").save(out)
    assert files_below(out)["s1/01-0.hocr"] == "b 1" and len(files_below(out)) == 6
    frames(spark, 3, "c").write.format("frames").mode("overwrite").save(out)
    assert files_below(out) == {f"s{i % 2}/0{i}-0.hocr": f"c {i}" for i in range(3)}
    assert not os.path.exists(f"{out}/_staging")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    frame_files.register(spark)
    out = str(tmp_path / "out")
    frames(spark, 3, "a").write.format("frames").mode("overwrite").save(out)
    before = files_below(out)
    late = frames(spark, 40, "x").repartition(8).withColumn("value", F.when(F.col("value") == "x 39", F.raise_error(F.lit("stopped"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stopped"):
        late.write.format("frames").mode("overwrite").save(out)
    with pytest.raises(Exception, match="two rows are named"):
        frames(spark, 3, "y").unionByName(frames(spark, 3, "z")).write.format("frames").mode("append").save(out)
    with pytest.raises(Exception, match="not a file name"):
        spark.createDataFrame([("../x", "v")], "name string, value string").write.format("frames").mode("append").save(out)
    assert files_below(out) == before
    assert not os.path.exists(f"{out}/_staging") and not os.path.exists(str(tmp_path / "x"))


def test_pages_go_out_and_come_back(spark, folder, tmp_path):
    hocr_files.register(spark)
    frame_files.register(spark)
    words = hocr.hocr_words(hocr.read_hocr(spark, f"file://{folder}").filter("t < 500 AND path LIKE '%s1%'"))
    pages = writers.hocr_text(words, ["t"]).select(F.format_string("%02d-%04.1f.hocr", F.floor(F.col("t") / 60).cast("int"), F.col("t") % 60).alias("name"), "value")
    pages.write.format("frames").mode("append").save(str(tmp_path / "again"))
    back = spark.read.format("hocr").load(str(tmp_path / "again")).filter("kind = 'ocrx_word'").select("t", "line_idx", "word_idx", "text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, words.select("t", "line_idx", "word_idx", "text").collect()))
