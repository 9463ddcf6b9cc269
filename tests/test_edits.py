"""Edits: what takes precedence, and a stream of them kept by version."""

from pyspark.sql import functions as F

from lectern.operators import edits
from lectern.streaming import edits as stream

SCHEMA = "doc string, i int, text string, highlight string, at long"
KEYS, ORDER = ["doc", "i"], ["at"]


def plain(df):
    return sorted(tuple(r) for r in df.select("doc", "i", "text", "highlight", "at").collect())


def test_an_edit_can_clear_and_never_multiplies(spark):
    words = spark.createDataFrame([("d", 0, "a", "white"), ("d", 1, "b", "white"), ("d", 2, None, "blue"), (None, 0, "n", "white")], "doc string, i int, text string, highlight string")
    changed = spark.createDataFrame([("d", 0, "A", None), ("d", 1, "x", "red"), ("d", 1, "y", "blue"), (None, 0, "no", "no"), ("d", 9, "z", "z")], "doc string, i int, text string, highlight string")
    got = sorted((str(r["doc"]), r["i"], r["text"], r["highlight"], r["edited_by_human"]) for r in edits.apply_edits(words, changed, KEYS).collect())
    assert got == [("None", 0, "n", "white", False), ("d", 0, "A", None, True), ("d", 1, "y", "blue", True), ("d", 2, None, "blue", False)]


def test_a_stream_of_edits_is_kept_by_version(spark, tmp_path):
    batches = [
        [("d", 0, "first", "white", 10), ("d", 1, "one", None, 11), ("d", 0, "second", "blue", 12)],
        [("d", 0, "late", "red", 5), ("e", 0, None, "yellow", 13)],
        [("d", 1, "two", "blue", 20), ("e", 0, "same time", "white", 13)],
    ]
    table, source, check = (f"file://{tmp_path}/{x}" for x in ("table", "in", "check"))

    def run():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.stream_edits(rows, table, KEYS, ORDER, check)
        query.awaitTermination()
        assert query.exception() is None

    def put(k):
        spark.createDataFrame(batches[k], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    put(0)
    put(1)
    run()
    second = plain(stream.read_edits(spark, table, KEYS, ORDER))
    assert second == [("d", 0, "second", "blue", 12), ("d", 1, "one", None, 11), ("e", 0, None, "yellow", 13)]
    put(2)
    run()  # goes on where it was
    assert sorted(r["version"] for r in stream.versions(spark, table).collect()) == [0, 1, 2]
    last = [("d", 0, "second", "blue", 12), ("d", 1, "two", "blue", 20), ("e", 0, "same time", "white", 13)]
    assert plain(stream.read_edits(spark, table, KEYS, ORDER)) == last
    assert plain(stream.read_edits(spark, table, KEYS, ORDER, version=1)) == second
    for number in (1, 2, 2):  # batches that are replayed
        stream.write_version(spark.createDataFrame(batches[number], SCHEMA), number, table, KEYS, ORDER)
    assert plain(stream.read_edits(spark, table, KEYS, ORDER)) == last and plain(stream.read_edits(spark, table, KEYS, ORDER, version=1)) == second
    words = spark.createDataFrame([("d", 0, "a", "white"), ("d", 1, "b", "white"), ("d", 2, "c", "white")], "doc string, i int, text string, highlight string")
    got = edits.apply_edits(words, stream.read_edits(spark, table, KEYS, ORDER, version=1), KEYS).orderBy("i")
    assert [(r["text"], r["highlight"]) for r in got.collect()] == [("second", "blue"), ("one", None), ("c", "white")]
    assert got.filter(F.col("edited_by_human")).count() == 2
