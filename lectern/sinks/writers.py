"""Stage tables in Parquet, interchange files, and the ledger that makes stages resumable."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("session_id",), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str, session: str = "session_id") -> None:
    """One JSON text per session, in a folder of its own."""
    report.select(session, F.col("report").alias("value")).write.mode("overwrite").partitionBy(session).text(path)


def metadata_json(intervals: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, value): a session's intervals as a JSON list, by start."""
    one = F.struct("start_time", "part", "end_time", "transitions")
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda r: F.struct(r["part"].alias("part"), r["start_time"].alias("start_time"), r["end_time"].alias("end_time"), r["transitions"].alias("transitions")))
    return intervals.groupBy(session).agg(F.to_json(ordered).alias("value"))


def stitched_json(page: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value): a page as a JSON list of [line, top, bottom]."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line", "top", "bottom"))), lambda r: F.concat(F.lit("["), F.concat_ws(", ", F.get(F.split(F.to_json(F.struct(r["line"].alias("x"))), r'^\{"x":|\}$'), 1), F.coalesce(r["top"].cast("string"), F.lit("null")), F.coalesce(r["bottom"].cast("string"), F.lit("null"))), F.lit("]")))
    return page.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]")).alias("value"))


def hocr_text(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value): pages as hOCR again, lines and words in order with their boxes and, where present, ids and highlight."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    box = F.format_string("bbox %s %s %s %s", *[F.col(f"bbox.{s}").cast("string") for s in ("left", "top", "right", "bottom")])
    extra = F.concat(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {c}="'), escape(F.col(c).cast("string")), F.lit('"'))).otherwise("") for c in ("ocr_text", "highlight") if c in words.columns] or [F.lit("")])
    one = F.concat(F.lit("<span class=\"ocrx_word\""), extra, F.lit(' title="'), box, F.lit('">'), escape(F.col("text")), F.lit("</span>"))
    ordered = lambda by, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda r: r[c]), "")
    line = words.select(*keys, "line_idx", "word_idx", one.alias("x")).groupBy(*keys, "line_idx").agg(ordered("word_idx", "x").alias("x"))
    line = line.withColumn("x", F.concat(F.lit('<span class="ocr_line">'), "x", F.lit("</span>\n")))
    page = line.groupBy(*keys).agg(ordered("line_idx", "x").alias("x"))
    return page.select(*keys, F.concat(F.lit('<html><body><div class="ocr_page">\n'), "x", F.lit("</div></body></html>")).alias("value"))


def run_stage(spark: SparkSession, ledger_path: str, stage: str, sessions: DataFrame, work: Callable[[DataFrame], None]) -> DataFrame:
    """Run `work` on the sessions that the ledger does not have for this stage, then enter them with the seconds it took."""
    try:
        done = spark.read.parquet(ledger_path).filter(F.col("stage") == stage)
    except Exception as error:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        todo = sessions.select("session_id").distinct()
    else:
        todo = sessions.select("session_id").distinct().join(done, "session_id", "left_anti")
    began = time.time()
    work(todo)
    entry = todo.select("session_id", F.lit(stage).alias("stage"), F.lit(time.time() - began).alias("seconds"))
    entry.write.mode("append").parquet(ledger_path)
    return entry


def last_frames(files: DataFrame, times: DataFrame) -> DataFrame:
    """(session_id, t, path) of each session's last transition: what to copy."""
    return times.groupBy("session_id").agg(F.max("t").alias("t")).join(files, ["session_id", "t"])
