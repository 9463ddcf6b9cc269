"""The lower bound of a line's distance: never above it, and most pairs are told by it."""

import random

from pyspark.sql import functions as F

from lectern.functions.align import line_distance
from lectern.operators import match
from lectern.plans import driver
from lectern.plans.inputs import KEYS, corpus, doc_lines
from lectern.sinks.scratch import cut

SF = "/root/testdata/sf0.001"


def test_the_bound_is_admissible(spark):
    rng = random.Random(1)
    line = lambda n: "".join(rng.choice("aeinrst lodhuABCxyzé.,") for _ in range(n))
    pairs = [(line(rng.randint(0, 40)), line(rng.randint(0, 40))) for _ in range(600)]
    pairs += [(a, "".join(c for c in a if rng.random() < 0.8)) for a, _ in pairs] + [("", "x"), ("  ", "x"), ("é", "é"), ("abc", ""), ("abc", "abc"), ("b", "a" * 300 + "b")]
    df = spark.createDataFrame(pairs, "text string, line string")
    got = df.select("text", "line", match.least_distance(F.col("text"), F.col("line")).alias("least")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r["least"] <= line_distance(r["text"], r["line"]) + 1e-9, tuple(r)


def test_few_pairs_are_aligned_and_none_is_lost(spark):
    anchored = cut(driver._anchored(spark, SF))
    lines, refs = doc_lines(spark, SF), corpus(spark, SF)
    windows = cut(match.gap_windows(lines, anchored, refs, KEYS))
    every, some = (match.gap_candidates(windows, lines, refs, KEYS, limit) for limit in (None, match.MAX_LINE_DISTANCE))
    assert 0 < some.count() < every.count() / 2
    best = lambda c: sorted(map(tuple, match.best_candidate(c, KEYS).collect()))
    assert best(some) == best(every) != []


def test_words_meet_a_short_corpus_where_they_are(spark, monkeypatch):
    """Whatever the planner's own limit is, words are not exchanged to meet a short corpus; a longer one is, with the same rows."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        refs = spark.createDataFrame([("x", 0, "red green blue"), ("x", 1, "green tea"), ("y", 0, "blue sky"), ("y", 1, "red red wine")], "doc_name string, line_idx int, line string")
        words = spark.createDataFrame([(d, i, k, w) for d in range(6) for i, t in enumerate(["red blue sky of", "tea blue green red"]) for k, w in enumerate(t.split(" ")[d % 3 :])], "d int, line_idx int, word_idx int, text string").repartition(3)

        def both():
            evidence = match.document_evidence(words, match.document_dictionary(refs), ["d"])
            best = match.best_document(evidence, ["d"])
            return best, match.anchored_lines(words, best, match.unique_words(refs), ["d"])

        rows = lambda dfs: [sorted(map(tuple, df.collect())) for df in dfs]
        near = both()
        for df in near:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(d#" in plan and not any(w in line for line in plan.splitlines() for w in ("SortMergeJoin [word", "SortMergeJoin [text", "SortMergeJoin [d#1, doc_name"))
        got = rows(near)
        assert got[0] and got[1]
        monkeypatch.setattr(match, "MOST_SENT", 0)
        far = both()
        assert "SortMergeJoin [word" in far[0]._jdf.queryExecution().executedPlan().toString()
        assert rows(far) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
