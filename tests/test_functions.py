import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.functions.align import alignment_cost, alignment_costs, line_distance, line_distance_udf, word_distance
from lectern.operators import repair


@pytest.mark.parametrize(("a", "b", "edge", "want"), [("aba", "aba", 10, 0), ("aba", "abba", 10, 100), ("aba", "abab", 10, 10), ("aba", "c abba c", 0, 100), ("aba", "c abba c", 10, 140)])
def test_known_alignments(a, b, edge, want):
    assert alignment_cost(a, b, edge) == want


def test_letters_at_the_ends_cost_an_edge_each():
    rng = random.Random(0)
    for _ in range(50):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        left, right = rng.randrange(4), rng.randrange(4)
        assert alignment_cost(word, "x" * left + word + "y" * right, 10) == 10 * (left + right)
    assert line_distance("", "anything") == 1.0
    assert line_distance("  é", "anything") == 1.0


@given(st.lists(st.tuples(st.text("abc ", max_size=12), st.text("abcd ", max_size=15)), max_size=40), st.sampled_from([0, 1, 10, 80]))
@settings(max_examples=60, deadline=None)
def test_batches_align_as_single_pairs(pairs, edge):
    got = alignment_costs([a for a, _ in pairs], [b for _, b in pairs], edge)
    assert list(got) == [alignment_cost(a, b, edge) for a, b in pairs]


def full_table(a, b, edge):
    rows = [[j * edge for j in range(len(b) + 1)]]
    for c in a:
        row = [rows[-1][0] + 100]
        for j, d in enumerate(b, 1):
            row.append(min(rows[-1][j - 1] + (0 if c == d else 100), rows[-1][j] + 100, row[-1] + 100))
        rows.append(row)
    return min(x + (len(b) - j) * edge for j, x in enumerate(rows[-1]))


@given(st.text("ab ", max_size=8), st.text("ab ", max_size=10), st.sampled_from([1, 80, 100]))
@settings(max_examples=200, deadline=None)
def test_equal_characters_are_matched_at_no_loss(a, b, edge):
    assert alignment_cost(a, b, edge) == full_table(a, b, edge)


def test_words_ignore_case_and_blank_text_costs_edges():
    assert word_distance("HELLO", "hello") == 0
    assert word_distance("abc", "") == pytest.approx(2.4)
    assert word_distance("abcd", "ab") == pytest.approx(1.6)


def test_line_distance_udf(spark):
    df = spark.createDataFrame([("abc", "xabcx"), (None, "a"), ("", "a"), ("abc", None)], "a string, b string")
    assert [r[0] for r in df.select(line_distance_udf("a", "b")).collect()] == pytest.approx([0.02 / 3, 1.0, 1.0, 1.0])


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_time_codec(spark):
    assert one(spark, S.time_to_filename(F.lit(10.0))) == "00-10.0.jpg"
    assert one(spark, S.time_to_filename(F.lit(754.25), "xml")) == "12-34.25.xml"
    assert one(spark, S.time_to_filename(F.lit(6000.5))) == "100-00.5.jpg"
    assert one(spark, S.filename_to_time(F.lit("a/b/00-10.0.jpg"))) == 10.0
    assert one(spark, S.filename_to_time(F.lit("12-34.25.xml"))) == 754.25
    assert one(spark, S.filename_to_time(F.lit("12-34.jpg"))) == 754.0
    assert one(spark, S.filename_to_time(F.lit("other.jpg"))) is None
    assert one(spark, S.tick(F.lit(0.3))) == 3
    assert one(spark, S.tick_of_bound(F.lit(0.3))) == 2
    assert one(spark, S.tick_of_event(F.lit(0.3))) == 3
    assert one(spark, S.tick_label(F.lit(754))) == "01:15"


def test_text_functions(spark):
    assert one(spark, S.clean_text(F.lit("a—b"))) == "a-b"
    assert one(spark, S.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, S.ascii_text(F.lit("caféx"))) == "cafx"
    assert one(spark, S.tokens(F.lit("a  b "))) == ["a", "", "b", ""]
    assert one(spark, S.letters_for_digits(F.lit(1904))) == "bjae"
    assert one(spark, S.session_name(F.lit("x/y/rec.MP4"))) == "x_y_rec"
    with pytest.raises(Exception, match="not a recording"):
        one(spark, S.session_name(F.lit("x/y.txt")))


def test_geometry_and_colour(spark):
    box = S.bbox(F.lit(10), F.lit(20), F.lit(30), F.lit(60))
    assert tuple(one(spark, S.scale_bbox(box))) == (5.0, 10.0, 15.0, 30.0)
    assert one(spark, S.point_box_distance(box, F.lit(20.0), F.lit(20.0))) == 10.0
    assert one(spark, S.width(box)) == 20.0
    assert one(spark, S.rgb_hex(F.lit(253), F.lit(250), F.lit(1))) == "#fdfa01"
    assert one(spark, S.colour_difference([F.lit(1), F.lit(2), F.lit(3)], [F.lit(2), F.lit(0), F.lit(3)])) == pytest.approx(0.299 + 2 * 0.587)
    x, y = S.affine_2d(F.lit(5.0), F.lit(5.0), (F.lit(0), F.lit(0)), (F.lit(10), F.lit(10)), (F.lit(100), F.lit(0)), (F.lit(200), F.lit(20)))
    assert (one(spark, x), one(spark, y)) == (150.0, 10.0)
    assert one(spark, S.repeat_for_tokens(F.array(F.lit(1.5), F.lit(2.5)), F.array(F.lit(2), F.lit(1)))) == [1.5, 1.5, 2.5]
    assert one(spark, S.epoch_micros(F.lit("2024-01-02 03:04:05.678901").cast("timestamp_ntz"))) == 1704164645678901
    seg = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, S.segment_distance(seg(0, 0, 10, 0), seg(0, 1, 10, 1))) == pytest.approx(2.0)
    assert one(spark, S.segment_distance(seg(0, 0, 10, 0), seg(0, 0, 0, 10))) == 1e7


def test_costs_of_runs_of_words_are_those_of_each_alone():
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abAB?\xff é\u212a".replace(" ", "")) for _ in range(n))
    lines = []
    for boxes, words in ((0, 3), (3, 0), (1, 1), (5, 4), (40, 9), (2, 6)):
        lines.append(([some(rng.choice((0, 1, 3, 8, 24, 25, 60))) for _ in range(boxes)], [some(rng.choice((0, 1, 2, 5, 31, 32, 33))) for _ in range(words)]))
    known = list(repair.priced([*lines, (["ab"] * 200, ["a"] * 200), *lines]))
    assert known[: len(lines)] == known[len(lines) + 1 :] and known[len(lines)] is None
    seen = 0
    for (texts, words), costs in zip(lines, known, strict=False):
        for k in range(repair.RUN if costs else 0):
            for a in range(len(words)):
                for b, text in enumerate(texts):
                    cost = costs[k][a * len(texts) + b]
                    run = words[a : a + k + 1]
                    if cost is not None:
                        assert len(run) == k + 1 and cost == round(word_distance(text, " ".join(run)) * 100)
                        seen += 1
    assert seen > 300


def test_lines_of_very_different_lengths_are_aligned_together():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abc") for _ in range(n))
    pairs = [(some(rng.choice((0, 1, 7, 40, 900))), some(rng.choice((0, 1, 9, 60, 400)))) for _ in range(60)] * 5 + [(some(3), some(4)) for _ in range(300)]
    for edge, middle, diagonal, vertical in ((1, 100, 100, 100), (90, 30, 20, 110)):
        got = alignment_costs([a for a, _ in pairs], [b for _, b in pairs], edge, middle, diagonal, vertical)
        each = {p: alignment_cost(*p, edge, middle, diagonal, vertical) for p in set(pairs)}
        assert got.tolist() == [each[p] for p in pairs]
