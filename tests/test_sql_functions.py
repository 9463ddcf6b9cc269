"""User functions in SQL give what the DataFrame forms give."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import sql
from lectern.functions.align import line_distance_udf, word_distance_udf
from lectern.functions.scalar import tokens
from lectern.operators.highlights import grouped_change_log


@pytest.fixture
def named(spark):
    sql.register(spark)
    return spark


def test_tokens_with_positions(named):
    rows = [(1, "a bc  d"), (2, ""), (3, None), (4, "é ü"), (5, " x")]
    named.createDataFrame(rows, "id int, text string").createOrReplaceTempView("texts")
    got = named.sql("SELECT id, k.* FROM texts t, LATERAL line_tokens(t.text) k").collect()
    want = named.table("texts").select("id", F.posexplode(tokens("text")).alias("word_idx", "token")).collect()
    assert sorted((r["id"], r["word_idx"], r["token"]) for r in got) == sorted(map(tuple, want))
    text = dict(rows)
    assert all(text[r["id"]][r["start"] : r["start"] + len(r["token"])] == r["token"] for r in got)
    assert [r["token"] for r in named.sql("SELECT * FROM line_tokens('x, y', ', ')").collect()] == ["x", "y"]
    for wrong in ("SELECT * FROM line_tokens(1)", "SELECT * FROM line_tokens('a', '')"):
        with pytest.raises(Exception, match="line_tokens"):
            named.sql(wrong).collect()


def test_change_log_of_a_table(named):
    rng = random.Random(2)
    data = [(s, t, rng.sample([0, 1, 2, 3, -1], rng.randint(1, 2)), rng.choice(["white", "yellow", "blue", None])) for s in "abc" for t in range(40)]
    df = named.createDataFrame(data + [("d", 0, None, "blue")], "session string, t int, ids array<int>, color string").repartition(4)
    df.createOrReplaceTempView("words")
    got = named.sql("SELECT * FROM change_log(TABLE(words), 'session', 't', 'ids', 'color')").collect()
    batch = grouped_change_log(df.withColumnsRenamed({"ids": "global_ids", "color": "highlight"}).selectExpr("*", "'w' AS text"), ["session"], ["t"]).collect()
    want = sorted((r["session"], r["t"], r["gid"], r["color"], r["former"][r["id_group"].index(r["gid"])]) for r in batch)
    assert sorted(map(tuple, got)) == want and len(want) > 40
    assert named.sql("SELECT session, count(*) AS n FROM change_log(TABLE(words), 'session', 't', 'ids', 'color', 'blue') GROUP BY session").count() == 3
    with pytest.raises(Exception, match="no column 'nope'"):
        named.sql("SELECT * FROM change_log(TABLE(words), 'session', 'nope', 'ids', 'color')").collect()


def test_distances(named):
    pairs = [("The qu1ck", "The quick brown"), ("", "x"), ("abc", ""), (None, "x"), ("fox", "fox")]
    df = named.createDataFrame(pairs, "a string, b string")
    df.createOrReplaceTempView("pairs")
    got = named.sql("SELECT a, b, line_distance(a, b) AS d, word_distance(a, b) AS w FROM pairs").collect()
    want = df.select("a", "b", line_distance_udf("a", "b").alias("d"), word_distance_udf("a", "b").alias("w")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
