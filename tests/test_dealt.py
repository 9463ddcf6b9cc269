"""Words of documents are dealt by document once, as texts."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.scalar import ascii_text
from lectern.operators import geometry, repair
from lectern.plans import driver
from lectern.plans.inputs import KEYS, doc_lines, doc_words
from lectern.plans.session import configure

SF = "/root/testdata/sf0.001"


def test_words_are_exchanged_as_texts(spark):
    df = geometry.editable_words(doc_words(spark, "/root/testdata/sf0.001"), KEYS, 1280, 720)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "word_idx" not in plan[plan.index("Exchange hashpartitioning") :]


def test_only_wanted_documents_are_split_and_all_of_their_words_stay(spark):
    only = doc_lines(spark, SF).select("doc_id").distinct().filter("doc_id % 3 = 0")
    some = doc_words(spark, SF, only)
    want = doc_words(spark, SF).filter("doc_id % 3 = 0")
    assert some.count() == want.count() > 0 and some.exceptAll(want).isEmpty()
    # lines and words of the same documents meet without being dealt again, and what chooses the documents moves to them
    df = some.join(doc_lines(spark, SF, dealt=True, only=only).select("doc_id", "line_idx"), ["doc_id", "line_idx"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any("word_idx" in line or "line_idx" in line for line in plan.splitlines() if "Exchange" in line)


def exchanged(df):
    """What the exchanges of the plan that ran carry, without reused ones and those of the corpus, which have no doc_id."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if " Exchange " in line and "ReusedExchange" not in line and "doc_id" in line]


@pytest.mark.parametrize("name, times", [("char_width_means", 2), ("gap_fill_windows", 1), ("inner_affine_medians", 1), ("scroll_positions", 1), ("anchor_line_matches", 1)])
def test_matching_exchanges_texts_once_and_no_words(spark, name, times):
    """The choice of a text, the anchored lines and what follows from them are made where a document's text was dealt to. Of the widths this is the
    plan after the stage table: its anchored lines are dealt for their words, and for their corpus lines."""
    found = exchanged(driver.QUERIES[name](configure(spark), SF))
    assert len(found) == times and all("REPARTITION_BY_NUM" in line for line in found), found


def test_reading_order_exchanges_no_words_and_writes_no_stage_tables(spark, monkeypatch):
    """Texts are dealt once; besides them, a document's heights leave Python for the words. Nothing is checkpointed."""
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.checkpoint", lambda *_: pytest.fail("a stage table"))
    found = exchanged(driver.QUERIES["reading_order"](configure(spark), SF))
    assert sorted("REPARTITION_BY_NUM" in line for line in found) == [False, True], found


def test_reading_order_of_odd_places(spark):
    """Words of one line at several heights, on a tie, beyond both ends, without a box, and of documents without lines or id."""
    box = "struct(0D AS left, y - 1 AS top, x AS right, y + 1 AS bottom) AS bbox"
    lines = spark.createDataFrame([(1, 0, 10.0), (1, 1, 10.5), (1, 2, 20.0), (None, 0, 5.0)], "doc int, line_idx int, y double").selectExpr("doc", "line_idx", "0D AS x", "y").selectExpr("doc", "line_idx", box)
    places = [(1, 0, 15.0, 3.0), (1, 1, 15.25, 2.0), (1, 2, -7.0, 2.0), (1, 3, 99.0, 1.0), (1, 4, None, 1.0), (1, 5, 20.0, 0.0), (2, 0, 10.0, 0.0), (None, 0, 5.0, 0.0)]
    words = spark.createDataFrame(places, "doc int, word_idx int, y double, x double").selectExpr("doc", "0 AS line_idx", "word_idx", box)
    got = geometry.reading_order(words, lines, ["doc"]).orderBy("reading_idx").collect()
    assert [(r["doc"], r["word_idx"], r["reading_idx"]) for r in got] == [(1, w, i) for i, w in enumerate([4, 2, 0, 5, 3, 1])]


def test_rows_of_one_id_share_their_perfect_words(spark, tmp_path):
    """Two rows of a doc_id are lines of one document: their anchored line is matched once, its words are perfect as often as they stand there."""
    once = driver.perfect_words(configure(spark), SF)
    some = once.groupBy("doc_id").count().orderBy(F.desc("count"), "doc_id").first()["doc_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.filter(F.col("doc_id") == some).withColumn("text", F.lit("x"))
    docs.filter(F.col("doc_id") == some).unionByName(short).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = driver.perfect_words(configure(spark), str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, once.filter(F.col("doc_id") == some).collect())) != []


def test_empty_boxes_are_not_asked_one_by_one(monkeypatch):
    """Empty boxes between two filled ones have the same words on offer; starts that meet go on as one."""
    rng, asked = random.Random(7), []
    below = repair.Held.below
    monkeypatch.setattr(repair.Held, "below", lambda self, box: asked.append(box) or below(self, box))
    texts = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(600)]
    lefts = [60.0 * i for i in range(600)]
    job = repair.LineRepair(texts, lefts, [x + 50 for x in lefts], " ".join(texts[100:105]))
    found, _ = job.solve(job.estimated_spans({}, 8.0, 0.0, 1.0))
    assert 0 < len(asked) < 1200, len(asked)
    assert sum(map(len, found)) <= 5


def climb_by_hand(job, pairing):
    """Box by box, every empty one asks for itself."""
    boxes, n, words = list(pairing), job.n, len(job.correct)
    for _ in range(repair.SWEEPS):
        moved = False
        for box in range(n - 1, -1, -1):
            if own := boxes[box]:
                a, b = job._best_split(repair.Held(list(boxes)), box)
                if (a, b) != (0, len(own)):
                    if box:
                        boxes[box - 1] += own[:a]
                    if box + 1 < n:
                        boxes[box + 1] = own[b:] + boxes[box + 1]
                    boxes[box], moved = own[a:b], True
                continue
            held = [w for b in boxes for w in b]
            best = (0, None, None)
            for side, filled in ((1, [i for i in range(box + 1, n) if boxes[i]][:1]), (0, [i for i in range(box) if boxes[i]][-1:])):
                if filled:
                    donor, given = filled[0], boxes[filled[0]]
                    word = given[0] if side else given[-1]
                    gain = job.cost(box, ()) + job.cost(donor, given) - job.cost(box, (word,)) - job.cost(donor, given[1:])
                else:
                    donor, word = None, ((max(held) + 1 if held else 0) if side else (min(held) - 1 if held else words - 1))
                    gain = job.cost(box, ()) - job.cost(box, (word,)) if 0 <= word < words else 0
                if gain > best[0]:
                    best = (gain, word, donor)
            if best[1] is not None:
                _, word, donor = best
                boxes[box], moved = (word,), True
                if donor is not None:
                    boxes[donor] = boxes[donor][1:] if donor > box else boxes[donor][:-1]
        if not moved:
            break
    return boxes


def test_climbs_equal_a_loop():
    rng = random.Random(8)
    for k in range(150):
        words = ["".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 7))]
        texts = [rng.choice([*words, "".join(rng.choices("abcd", k=rng.randint(0, 6)))]) for _ in range(rng.randint(1, 14))]
        lefts = [20.0 * i for i in range(len(texts))]
        known = repair.run_costs([(texts, words)])[0] if k % 2 else None
        job = repair.LineRepair(texts, lefts, [x + 18 for x in lefts], " ".join(words), known)
        start = job.first_pairing(job.estimated_spans({}, rng.choice([1.0, 4.0, 9.0]), 0.0, 1.0))
        for by in repair.SHIFTS:
            assert job.climb(job.shifted(start, by)) == climb_by_hand(job, job.shifted(start, by)), (texts, words, by)


def test_ascii_text_of_odd_bytes(spark):
    df = spark.sql("SELECT explode(array(NULL, '', 'abc', 'caf\u00e9', '\u00e9', cast(x'6180' AS string), cast(x'C3' AS string), cast(x'FF41' AS string))) AS t")
    got = df.select(ascii_text("t").alias("a"), F.regexp_replace("t", r"[^\x00-\x7F]", "").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [None, "", "abc", "caf", "", "a", "", "A"]
