"""The driver's tables in the roles of sessions, frames, lines, words and corpus, in DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import bbox, epoch_micros, lines, tokens
from ..operators.match import spread
from .session import scale

KEYS = ["doc_id"]
HIGHLIGHTS = ("signup", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    scale(spark, rows)
    return rows


def doc_lines(spark: SparkSession, sf_dir: str, dealt: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_idx, text, bbox): 20 pixels a line, heights from 12 to 20. Dealt by document where lines or words meet again afterwards:
    then texts are exchanged once, and their words, which take ten times the place, are not. `only` (doc_id) names the documents that are wanted."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = spread(texts, *KEYS) if dealt else texts
    docs = (texts if only is None else texts.join(only, KEYS, "left_semi")).select("doc_id", F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("line_idx", "text"))
    n = F.length("text")
    return docs.select("doc_id", "line_idx", "text", bbox(F.lit(0), F.col("line_idx") * 20, (n + 1) * 8, F.col("line_idx") * 20 + 12 + n % 9).alias("bbox"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_idx, word_idx, text): what matching needs of words. Dealt by document as texts, so that words are not exchanged."""
    return doc_lines(spark, sf_dir, dealt=True).select("doc_id", "line_idx", F.posexplode(tokens("text")).alias("word_idx", "text"))


def doc_words(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_idx, word_idx, text, bbox, highlight) of documents. `only` as in doc_lines(); rows leave partitioned by document and sorted by line."""
    return line_words(doc_lines(spark, sf_dir, dealt=True, only=only))


def line_words(rows: DataFrame) -> DataFrame:
    """(doc_id, line_idx, word_idx, text, bbox, highlight) of lines: 8 pixels a character and a space, moved by up to 2 pixels.

    A word's left edge is a running sum over its line, linear in the line.
    """
    words = rows.select("doc_id", "line_idx", F.col("bbox").alias("line_box"), F.posexplode(tokens("text")).alias("word_idx", "word"))
    upto = Window.partitionBy("doc_id", "line_idx").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = (F.sum(F.length("word") + 1).over(upto) - F.length("word") - 1) * 8 + F.col("word_idx") % 3
    placed = words.withColumn("l", left)
    box = bbox(F.col("l"), F.col("line_box.top"), F.col("l") + F.length("word") * 8, F.col("line_box.bottom"))
    return placed.select("doc_id", "line_idx", "word_idx", F.col("word").alias("text"), box.alias("bbox"), F.lit(None).cast("string").alias("highlight"))


#: Words of a screen's line, lines of a screen, and lines by which a frame has been scrolled on from the one before.
SCREEN_WORDS, SCREEN_LINES, SCREEN_STEP = 10, 9, 3


def screen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, frame, line_idx, text): a document as a recording of someone who scrolls through it, read with errors.

    Of some sightings letters are mistaken, of others the line is unreadable; a line is on screen in up to three frames.
    """
    text = F.translate(F.coalesce("text", F.lit("")), "\n", " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(text, " ").alias("ws"))
    n = F.ceil(F.size("ws") / SCREEN_WORDS).cast("int")
    lines_of = docs.select("doc_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(j.alias("j"), F.array_join(F.slice("ws", j * SCREEN_WORDS + 1, SCREEN_WORDS), " ").alias("text")))).alias("l"))
    last = F.ceil(F.greatest(F.col("n") - SCREEN_LINES, F.lit(0)) / SCREEN_STEP)
    j = F.col("l.j")
    first = F.greatest(F.ceil((j - SCREEN_LINES + 1) / SCREEN_STEP), F.lit(0))
    seen = lines_of.select("doc_id", j.alias("j"), F.col("l.text").alias("text"), F.explode(F.sequence(first.cast("int"), F.least(F.floor(j / SCREEN_STEP), last).cast("int"))).alias("frame"))
    noise = F.when((F.col("frame") * 5 + F.col("j")) % 7 == 0, F.reverse("text")).when((F.col("frame") * 3 + F.col("j") * 2) % 5 == 0, F.translate("text", "aeo", "ceq")).otherwise(F.col("text"))
    return seen.select("doc_id", "frame", (F.col("j") - F.col("frame") * SCREEN_STEP).alias("line_idx"), noise.alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_name, line_idx, line): benchmark items, a line per sentence."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("doc_name"), F.posexplode(lines(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")))).alias("line_idx", "line"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts_us, event_id, event_type, day, gid, value): events as frames of their user's session."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("int")
    return e.select("user_id", epoch_micros("ts").alias("ts_us"), "event_id", "event_type", day.alias("day"), (k % 8).alias("gid"), "value")


SQL_LINES = """L AS (
  SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS line_idx, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
)"""
SQL_WORDS = (
    SQL_LINES
    + """, W AS (
  SELECT doc_id, line_idx, CAST(unnest(range(len(ws))) AS INT) AS word_idx, unnest(ws) AS text
  FROM (SELECT doc_id, line_idx, string_split(text, ' ') AS ws FROM L)
)"""
)
SQL_BOXES = (
    SQL_WORDS
    + """, LB AS (
  SELECT doc_id, line_idx, text, CAST(line_idx * 20 AS DOUBLE) AS t, CAST(line_idx * 20 + 12 + length(text) % 9 AS DOUBLE) AS b FROM L
), WB AS (
  SELECT W.doc_id, W.line_idx, W.word_idx, W.text, LB.t, LB.b,
         CAST(8 * (sum(length(W.text) + 1) OVER (PARTITION BY W.doc_id, W.line_idx ORDER BY W.word_idx) - length(W.text) - 1) + W.word_idx % 3 AS DOUBLE) AS l
  FROM W JOIN LB ON W.doc_id = LB.doc_id AND W.line_idx = LB.line_idx
), B AS (SELECT *, l + 8 * length(text) AS r FROM WB)"""
)
SQL_SCREENS = f"""WS AS (SELECT doc_id, string_split(translate(coalesce(text, ''), chr(10), ' '), ' ') AS ws FROM documents),
SJ AS (SELECT doc_id, ws, CAST(ceil(len(ws) / {SCREEN_WORDS}.0) AS INT) AS n FROM WS),
SL AS (SELECT doc_id, n, j, array_to_string(ws[j * {SCREEN_WORDS} + 1:j * {SCREEN_WORDS} + {SCREEN_WORDS}], ' ') AS text FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS j FROM SJ)),
SS AS (
  SELECT doc_id, j, text, CAST(unnest(range(CAST(greatest(ceil((j - {SCREEN_LINES - 1}) / {SCREEN_STEP}.0), 0) AS INT), least(j // {SCREEN_STEP}, CAST(ceil(greatest(n - {SCREEN_LINES}, 0) / {SCREEN_STEP}.0) AS INT)) + 1)) AS INT) AS frame FROM SL
), S AS (
  SELECT doc_id, frame, j - frame * {SCREEN_STEP} AS line_idx, CASE WHEN (frame * 5 + j) % 7 = 0 THEN reverse(text) WHEN (frame * 3 + j * 2) % 5 = 0 THEN translate(text, 'aeo', 'ceq') ELSE text END AS text FROM SS
)"""
SQL_CORPUS = """R AS (
  SELECT doc_name, CAST(unnest(range(len(ls))) AS INT) AS line_idx, unnest(ls) AS line
  FROM (SELECT item_id AS doc_name, string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)) AS ls FROM benchmark)
), RW AS (
  SELECT doc_name, line_idx, unnest(string_split(line, ' ')) AS word FROM R
)"""
SQL_FRAMES = """F AS (
  SELECT user_id, epoch_us(ts) AS ts_us, event_id, event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS day,
         CAST(json_extract(props, '$.k') AS INT) % 8 AS gid, value
  FROM events
)"""
SQL_BEST = (
    SQL_WORDS
    + ", "
    + SQL_CORPUS
    + """, BEST AS (
  SELECT doc_id, doc_name, score FROM (
    SELECT doc_id, doc_name, CAST(sum(length(w)) AS BIGINT) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(w)) DESC, doc_name) AS k
    FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS w FROM W) x
    JOIN (SELECT DISTINCT word, doc_name FROM RW) d ON d.word = x.w WHERE length(w) >= 2 GROUP BY doc_id, doc_name
  ) WHERE k = 1
), U AS (
  SELECT doc_name, word, min(line_idx) AS ref_idx FROM RW GROUP BY doc_name, word HAVING count(*) = 1
), A AS (
  SELECT W.doc_id, W.line_idx, BEST.doc_name, min(U.ref_idx) AS ref_idx, CAST(count(*) AS BIGINT) AS anchors
  FROM W JOIN BEST ON W.doc_id = BEST.doc_id JOIN U ON U.doc_name = BEST.doc_name AND U.word = W.text
  GROUP BY W.doc_id, W.line_idx, BEST.doc_name HAVING count(*) >= 2 AND min(U.ref_idx) = max(U.ref_idx)
)"""
)
