"""Recordings, their metadata, reference texts and frame files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import filename_to_time, session_name
from ..model import VIDEO_ENDINGS

_INTERVAL = "array<struct<part:string,start_time:double,end_time:double,transitions:array<double>>>"


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_path, session_id) of the recordings below a folder; dot files are skipped; contents are not read."""
    endings = "|".join(e[1:] for e in VIDEO_ENDINGS)
    root = re.sub("^file:/+", "/", path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.url_decode(F.regexp_replace("path", "^file:/+", "/")).alias("video_path"))
    wanted = files.filter(F.col("video_path").rlike(rf"\.({endings}|{endings.upper()})$") & ~F.substring_index("video_path", "/", -1).startswith("."))
    return wanted.select("video_path", session_name(F.expr(f"substring(video_path, {len(root) + 1})")).alias("session_id"))


def session_names(frames: DataFrame) -> DataFrame:
    return frames.select("session_id").distinct()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, part, start_time, end_time, transitions) of <session>/metadata.json; cut-off files have no rows."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(path, wholetext=True)
    session = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = files.filter(F.length("value") > 5).select(session.alias("session_id"), F.explode(F.from_json("value", _INTERVAL)).alias("i"))
    return rows.select("session_id", "i.*")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, line_idx, line) of every file of a folder, lines stripped."""
    files = spark.read.text(path, wholetext=True)
    name = F.url_decode(F.substring_index(F.col("_metadata.file_path"), "/", -1))
    body = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n$", "")
    return files.select(name.alias("doc_name"), F.posexplode(F.split(body, "\n", -1)).alias("line_idx", "line")).withColumn("line", F.trim("line"))


def filled_lines(ref_lines: DataFrame) -> DataFrame:
    """Lines that are not blank, numbered anew."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_name").orderBy("line_idx")
    kept = ref_lines.filter(F.trim("line") != "")
    return kept.withColumn("line_idx", F.row_number().over(order) - 1)


def word_lengths(ref_lines: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_name, word_idx, word, length) of a text's words; compat counts the line break that stays with a line's last word."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda r: r["line"]), "\n" if compat else " ")
    text = ref_lines.groupBy("doc_name").agg(joined.alias("text"))
    if compat:
        text = text.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n ")))
    words = F.filter(F.split("text", " ", -1), lambda w: w != "")
    return text.select("doc_name", F.posexplode(words).alias("word_idx", "word")).withColumn("length", F.length("word"))


def frame_files(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """(session_id, t, path) of frame files in a folder per session; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("session_id"), filename_to_time("path").alias("t"), "path")


def session_documents(transitions: DataFrame, files: DataFrame, edited: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """(session_id, t, path) of the frames at the transitions: an edited file takes precedence, frames with an output are left out."""
    frames = transitions.join(files, ["session_id", "t"])
    if edited is not None:
        frames = frames.join(edited.select("session_id", "t", F.col("path").alias("__e")), ["session_id", "t"], "left").withColumn("path", F.coalesce("__e", "path")).drop("__e")
    if done is not None:
        frames = frames.join(done.select("session_id", "t"), ["session_id", "t"], "left_anti")
    return frames


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(time, gid, text, id_group, color, former) of a highlight report in JSON."""
    entry = "map<string,array<struct<id:int,text:string,id_group:array<int>,color:string,`former colors`:array<string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("time", "events")).select(F.col("time").cast("double").alias("time"), F.explode("events").alias("e"))
    return rows.select("time", F.col("e.id").alias("gid"), "e.text", "e.id_group", "e.color", F.col("e.former colors").alias("former"))


def read_scroll(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Time double, Top double, Bottom double").option("header", True).csv(path).toDF("time", "top", "bottom")


def read_stitched(spark: SparkSession, path: str) -> DataFrame:
    """(line_idx, line, top, bottom) of a page in JSON: a list of [text, top, bottom]."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("line_idx", "r"))
    return rows.select("line_idx", F.get("r", 0).alias("line"), F.get("r", 1).cast("double").alias("top"), F.get("r", 2).cast("double").alias("bottom"))


def read_gaze(spark: SparkSession, path: str) -> DataFrame:
    """(gaze_x, gaze_y, timestamp, time) of an eye tracker's table; time in seconds of the recording."""
    rows = spark.read.schema("GazeX double, GazeY double, Timestamp string, MediaTime double").option("header", True).csv(path)
    return rows.select(F.col("GazeX").alias("gaze_x"), F.col("GazeY").alias("gaze_y"), F.col("Timestamp").alias("timestamp"), F.col("MediaTime").alias("time"))
