"""Queries over the driver's tables: each applies operators to whole tables; most have an equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import edits, gaze, geometry, highlights, hough, ids, match, repair, scroll, temporal, tracks
from ..sinks.scratch import cut
from .inputs import HIGHLIGHTS, KEYS, SQL_BEST, SQL_BOXES, SQL_CORPUS, SQL_FRAMES, SQL_LINES, SQL_SCREENS, corpus, doc_lines, doc_tokens, doc_words, frames, line_words, screen_lines, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

USER = ["user_id"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# matching


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = match.document_evidence(doc_tokens(spark, sf_dir), match.document_dictionary(corpus(spark, sf_dir)), KEYS, dealt=True)
    return match.best_document(evidence, KEYS)


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are exchanged once, for the choice of a text and for the lines; rows leave partitioned by document."""
    return match.anchored_lines(doc_tokens(spark, sf_dir), _best(spark, sf_dir), match.unique_words(corpus(spark, sf_dir)), KEYS)


def _matched(spark: SparkSession, sf_dir: str, anchored: DataFrame | None = None) -> DataFrame:
    """A stage table: what follows reads it several times. So is `anchored`."""
    anchored = cut(_anchored(spark, sf_dir)) if anchored is None else anchored
    # documents without an anchored line have no matches
    lines = doc_lines(spark, sf_dir, dealt=True, only=anchored.select(*KEYS).distinct())
    return cut(match.match_lines(lines, None, None, corpus(spark, sf_dir), KEYS, anchored))


@query(f"WITH {SQL_BEST} SELECT doc_id, doc_name, score FROM BEST")
def best_matching_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@query(f"WITH {SQL_BEST} SELECT source, arg_min(doc_name, BEST.doc_id) AS doc_name FROM BEST JOIN documents ON BEST.doc_id = documents.doc_id GROUP BY source")
def session_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _best(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return match.session_document(placed, "source", "doc_id")


@query(f"WITH {SQL_BEST} SELECT doc_id, line_idx, doc_name, ref_idx, anchors FROM A")
def anchor_line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir)


@query(
    f"""WITH {SQL_BEST}, P AS (
  SELECT L.doc_id, L.line_idx, A.ref_idx,
         min(CASE WHEN A.ref_idx IS NOT NULL THEN L.line_idx END) OVER (PARTITION BY L.doc_id ORDER BY L.line_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n,
         max(CASE WHEN A.ref_idx IS NOT NULL THEN L.line_idx END) OVER (PARTITION BY L.doc_id ORDER BY L.line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM L LEFT JOIN A ON L.doc_id = A.doc_id AND L.line_idx = A.line_idx
), Q AS (
  SELECT P.doc_id, P.line_idx, coalesce(an.doc_name, ap.doc_name) AS doc_name,
         CASE WHEN P.n IS NOT NULL THEN an.ref_idx - (P.n - P.line_idx) ELSE ap.ref_idx + 1 END AS lo,
         CASE WHEN P.n IS NOT NULL THEN an.ref_idx - 1 ELSE ap.ref_idx + (P.line_idx - P.p) END AS hi
  FROM P LEFT JOIN A an ON an.doc_id = P.doc_id AND an.line_idx = P.n LEFT JOIN A ap ON ap.doc_id = P.doc_id AND ap.line_idx = P.p
  WHERE P.ref_idx IS NULL AND (P.n IS NOT NULL OR P.p IS NOT NULL)
)
SELECT doc_id, line_idx, Q.doc_name, CAST(greatest(lo, 0) AS INT) AS lo, CAST(least(hi, last_ref) AS INT) AS hi
FROM Q JOIN (SELECT doc_name, max(line_idx) AS last_ref FROM R GROUP BY doc_name) s ON s.doc_name = Q.doc_name"""
)
def gap_fill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.gap_windows(doc_lines(spark, sf_dir, dealt=True), _anchored(spark, sf_dir), corpus(spark, sf_dir), KEYS)


@query()
def fuzzy_line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)


@query()
def repaired_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).drop("bbox")


def _repaired(spark: SparkSession, sf_dir: str, anchored: DataFrame | None = None) -> DataFrame:
    matched = _matched(spark, sf_dir, anchored)
    only = matched.select(*KEYS).distinct()
    return repair.repair_words(doc_words(spark, sf_dir, only), doc_lines(spark, sf_dir, dealt=True, only=only), matched, KEYS)


@query("SELECT doc_id, 'repaired' AS status FROM documents WHERE doc_id IN (SELECT doc_id FROM A)".join([f"WITH {SQL_BEST} ", ""]))
def repair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with an anchored line; one whose repair fails would say so instead of ending the job."""
    return repair.document_status(_repaired(spark, sf_dir), KEYS)


@query(f"WITH {SQL_BEST} SELECT doc_id, CAST(avg(CASE WHEN d.line IS NULL THEN 0 ELSE 1 END) AS DOUBLE) AS rate FROM L LEFT JOIN (SELECT DISTINCT line FROM R) d ON d.line = L.text GROUP BY doc_id")
def exact_line_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.exact_line_rate(doc_lines(spark, sf_dir), corpus(spark, sf_dir), KEYS)


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.reading_order(doc_words(spark, sf_dir), doc_lines(spark, sf_dir, dealt=True), KEYS)


@query(
    f"""WITH {SQL_BOXES}, M AS (SELECT doc_id, median(b - t) AS m FROM LB GROUP BY doc_id),
CS AS (SELECT LB.doc_id, (t + b) / 2 AS c, m, row_number() OVER (PARTITION BY LB.doc_id ORDER BY (t + b) / 2) AS k FROM LB JOIN M ON M.doc_id = LB.doc_id),
KC AS (SELECT doc_id, c FROM (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM CS) WHERE before IS NULL OR c >= before + 0.5 * m),
WL AS (SELECT DISTINCT doc_id, line_idx, (t + b) / 2 AS y FROM B),
NEAR AS (SELECT doc_id, line_idx, c FROM (SELECT WL.*, c, row_number() OVER (PARTITION BY WL.doc_id, line_idx ORDER BY abs(c - y), c) AS k FROM WL JOIN KC ON KC.doc_id = WL.doc_id AND abs(c - y) <= 40) WHERE k = 1)
SELECT B.doc_id, B.line_idx, word_idx, text, CAST(row_number() OVER (PARTITION BY B.doc_id ORDER BY c, (l + r) / 2, B.line_idx, word_idx) - 1 AS INT) AS reading_idx
FROM B JOIN NEAR ON NEAR.doc_id = B.doc_id AND NEAR.line_idx = B.line_idx"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("doc_id", "line_idx", "word_idx", "text", "reading_idx")


@query(
    f"""WITH {SQL_CORPUS}, N AS (SELECT doc_name, line_idx, string_split(line, ' ') AS ws FROM R),
O AS (SELECT *, sum(len(ws)) OVER (PARTITION BY doc_name ORDER BY line_idx) - len(ws) AS base FROM N)
SELECT doc_name, word, CAST(base + i AS INT) AS gid FROM (SELECT doc_name, base, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM O)"""
)
def word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.word_positions(corpus(spark, sf_dir))


@query()
def global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the repaired words of every document with an anchored line, in reading order, in the document's best text."""
    anchored = cut(_anchored(spark, sf_dir))
    fixed = cut(_repaired(spark, sf_dir, anchored).select("doc_id", "line_idx", "word_idx", "text", "bbox").filter("text <> ''"))
    ordered = geometry.reading_order(fixed, doc_lines(spark, sf_dir), KEYS)
    return ids.assign_ids(ordered.join(anchored.select("doc_id", "doc_name").distinct(), "doc_id"), ids.word_positions(corpus(spark, sf_dir)), KEYS)


def _sql_links(hop: int) -> str:
    """Links of frames that are `hop` apart, of what has no link yet."""
    before = [f"K{h}" for h in range(1, hop)]
    open_ahead = "".join(f" AND NOT EXISTS (SELECT 1 FROM {k} WHERE {k}.doc_id = T.doc_id AND {k}.f = T.frame AND {k}.i = T.line_idx)" for k in before)
    open_behind = "".join(f" AND NOT EXISTS (SELECT 1 FROM {k} WHERE {k}.doc_id = T.doc_id AND {k}.g = T.frame AND {k}.j = T.line_idx)" for k in before)
    h = str(hop)
    words = "SELECT doc_id, frame, min(line_idx) AS line_idx, w FROM (SELECT doc_id, frame, line_idx, unnest(string_split(text, ' ')) AS w FROM {}) WHERE w <> '' GROUP BY doc_id, frame, w HAVING count(*) = 1"
    return f"""A{h} AS MATERIALIZED (SELECT T.*, to_frame FROM T JOIN (SELECT doc_id, frame, lead(frame, {hop}) OVER (PARTITION BY doc_id ORDER BY frame) AS to_frame FROM (SELECT DISTINCT doc_id, frame FROM S)) N USING (doc_id, frame) WHERE to_frame IS NOT NULL{open_ahead}),
B{h} AS MATERIALIZED (SELECT T.* FROM T WHERE true{open_behind}),
E{h} AS MATERIALIZED (
  SELECT a.doc_id, a.frame AS f, a.line_idx AS i, b.frame AS g, b.line_idx AS j FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, frame, text ORDER BY line_idx) AS k FROM A{h}) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, frame, text ORDER BY line_idx) AS k FROM B{h}) b ON b.doc_id = a.doc_id AND b.frame = a.to_frame AND b.text = a.text AND b.k = a.k
), AA{h} AS MATERIALIZED (SELECT a.* FROM A{h} a WHERE NOT EXISTS (SELECT 1 FROM E{h} e WHERE e.doc_id = a.doc_id AND e.f = a.frame AND e.i = a.line_idx)),
BB{h} AS MATERIALIZED (SELECT b.* FROM B{h} b WHERE NOT EXISTS (SELECT 1 FROM E{h} e WHERE e.doc_id = b.doc_id AND e.g = b.frame AND e.j = b.line_idx)),
P{h} AS (SELECT DISTINCT x.doc_id, x.frame AS f, x.line_idx AS i, y.frame AS g, y.line_idx AS j FROM ({words.format("AA" + h)}) x JOIN (SELECT DISTINCT doc_id, frame, to_frame FROM AA{h}) n USING (doc_id, frame) JOIN ({words.format("BB" + h)}) y ON y.doc_id = x.doc_id AND y.frame = n.to_frame AND y.w = x.w),
D{h} AS MATERIALIZED (SELECT P{h}.*, levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)) AS d FROM P{h} JOIN AA{h} a ON a.doc_id = P{h}.doc_id AND a.frame = f AND a.line_idx = i JOIN BB{h} b ON b.doc_id = P{h}.doc_id AND b.frame = g AND b.line_idx = j),
K{h} AS MATERIALIZED (
  SELECT doc_id, f, i, g, j FROM E{h} UNION ALL SELECT doc_id, f, i, g, j FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, f, i ORDER BY d, j) AS p, row_number() OVER (PARTITION BY doc_id, g, j ORDER BY d, i) AS q FROM D{h} WHERE d <= {tracks.MAX_TRACK_DISTANCE}) WHERE p = 1 AND q = 1
)"""


@query(
    f"""WITH RECURSIVE {SQL_SCREENS}, T AS MATERIALIZED (SELECT * FROM (SELECT doc_id, frame, line_idx, trim(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS text FROM S) WHERE text <> ''),
{_sql_links(1)}, {_sql_links(2)}, K AS MATERIALIZED (SELECT * FROM K1 UNION ALL SELECT * FROM K2), C AS (
  SELECT doc_id, frame, line_idx, frame AS track_time, line_idx AS track_line FROM S WHERE NOT EXISTS (SELECT 1 FROM K WHERE K.doc_id = S.doc_id AND g = frame AND j = line_idx)
  UNION ALL SELECT C.doc_id, g, j, track_time, track_line FROM C JOIN K ON K.doc_id = C.doc_id AND f = frame AND i = line_idx
)
SELECT doc_id, frame, line_idx, track_time, track_line FROM C"""
)
def line_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a recording without a known text are one line: documents as scrolled screens, read with errors."""
    return tracks.line_tracks(screen_lines(spark, sf_dir), KEYS, "frame")


# geometry


@query(
    f"""WITH {SQL_BOXES}, M AS (SELECT doc_id, median(b - t) AS med_height FROM LB GROUP BY doc_id),
G AS (
  SELECT B.doc_id, l - lag(r) OVER (PARTITION BY B.doc_id, B.line_idx ORDER BY word_idx) AS gap
  FROM B JOIN M ON B.doc_id = M.doc_id WHERE abs((b - t) - med_height) <= 0.1 * med_height
)
SELECT M.doc_id, M.med_height, coalesce(g.gap, 5.0) AS space_width FROM M LEFT JOIN (SELECT doc_id, median(gap) AS gap FROM G GROUP BY doc_id) g ON g.doc_id = M.doc_id"""
)
def median_height_space_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.space_width(doc_lines(spark, sf_dir), doc_words(spark, sf_dir), KEYS)


@query(f"WITH {SQL_BOXES} SELECT doc_id, line_idx, word_idx, l * 0.5 AS \"left\", t * 0.5 AS top, r * 0.5 AS \"right\", b * 0.5 AS bottom FROM B")
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_words(spark, sf_dir).select("doc_id", "line_idx", "word_idx", S.scale_bbox("bbox").alias("b")).select("doc_id", "line_idx", "word_idx", "b.*")


@query(
    f"""WITH {SQL_BOXES} SELECT doc_id, line_idx, word_idx,
  round(sqrt(pow(least(abs(l - 100), abs(r - 100)), 2) + pow(least(abs(t - 100), abs(b - 100)), 2)), 6) AS dist FROM B"""
)
def point_box_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_words(spark, sf_dir).select("doc_id", "line_idx", "word_idx", F.round(S.point_box_distance("bbox", F.lit(100.0), F.lit(100.0)), 6).alias("dist"))


@query(
    f"""WITH {SQL_BOXES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY (r - l) * (b - t) DESC, line_idx, word_idx) - 1 AS INT) AS index,
  line_idx, word_idx, text, 'white' AS highlight, CAST(floor(l) AS INT) AS "left", CAST(floor(t) AS INT) AS top, CAST(floor(r) AS INT) AS "right", CAST(floor(b) AS INT) AS bottom
FROM B WHERE NOT (l >= 1280 OR r >= 1280 OR t >= 720 OR b >= 720) AND b - t > 5 AND b - t < 70"""
)
def editable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.editable_words(doc_words(spark, sf_dir), KEYS, 1280, 720)


@query(f"WITH {SQL_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM L GROUP BY doc_id")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.document_text(doc_words(spark, sf_dir), KEYS)


_POINTS = "l_extendedprice / 100"


@query(
    f"""WITH C AS (SELECT CAST(floor(l_quantity * 10 / 100) AS INT) AS y_idx, CAST(floor({_POINTS} / 100) AS INT) AS x_idx, count(*) AS n FROM lineitem GROUP BY 1, 2),
Y AS (SELECT CAST(unnest(range((SELECT max(y_idx) + 1 FROM C))) AS INT) AS y_idx), X AS (SELECT CAST(unnest(range((SELECT max(x_idx) + 1 FROM C))) AS INT) AS x_idx)
SELECT Y.y_idx, X.x_idx, CAST(coalesce(n, 0) AS BIGINT) AS count FROM Y CROSS JOIN X LEFT JOIN C ON C.y_idx = Y.y_idx AND C.x_idx = X.x_idx"""
)
def heatmap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 100).alias("x"), (F.col("l_quantity") * 10).alias("y"))
    return geometry.heatmap(points, "x", "y")


@query(
    f"""WITH RECURSIVE C AS (SELECT CAST(floor(l_quantity * 10 / 100) AS INT) AS y_idx, CAST(floor({_POINTS} / 100) AS INT) AS x_idx, count(*) AS n FROM lineitem GROUP BY 1, 2),
Y AS (SELECT CAST(unnest(range((SELECT max(y_idx) + 1 FROM C))) AS INT) AS y_idx), X AS (SELECT CAST(unnest(range((SELECT max(x_idx) + 1 FROM C))) AS INT) AS x_idx),
H AS (SELECT Y.y_idx, X.x_idx, CAST(coalesce(n, 0) AS BIGINT) AS count FROM Y CROSS JOIN X LEFT JOIN C ON C.y_idx = Y.y_idx AND C.x_idx = X.x_idx),
V AS (SELECT v, n, row_number() OVER (ORDER BY v) AS k, sum(n) OVER () AS total FROM (SELECT count AS v, count(*) AS n FROM H GROUP BY 1)),
R AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS run, CAST(NULL AS BIGINT) AS cut
  UNION ALL SELECT V.k, CASE WHEN R.run + n >= total / 4.0 THEN 0 ELSE R.run + n END, CASE WHEN R.run + n >= total / 4.0 THEN v END FROM R JOIN V ON V.k = R.k + 1
)
SELECT y_idx, x_idx, count, CAST((SELECT count(*) FROM R WHERE cut < H.count) AS INT) AS label FROM H"""
)
def equal_mass_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat map's cells with one of four labels of about equal mass."""
    return geometry.equal_mass_labels(heatmap_bins(spark, sf_dir), "count", 4)


# time


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    duration = rows.groupBy("user_id").agg((F.max("ts_us") + 60_000_000).alias("duration"))
    return temporal.part_intervals(rows, USER, "ts_us", "event_type", ["event_id"], duration)


_SQL_INTERVALS = (
    SQL_FRAMES
    + """, C AS (
  SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM F WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)
), N AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM C),
G AS (SELECT user_id, run, min(event_type) AS part, min(ts_us) AS start_time, max(ts_us) AS end_time FROM N GROUP BY user_id, run),
I AS (
  SELECT user_id, part, start_time, CASE WHEN run = max(run) OVER (PARTITION BY user_id) THEN max(end_time) OVER (PARTITION BY user_id) + 60000000 ELSE end_time END AS end_time FROM G
)"""
)


@query(f"WITH {_SQL_INTERVALS} SELECT user_id, part, start_time, end_time FROM I")
def part_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir)


@query(
    f"""WITH {SQL_FRAMES}, C AS (SELECT user_id, ts_us, event_id, event_type, lag(event_type) OVER w AS previous, row_number() OVER w AS k FROM F WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id))
SELECT user_id, ts_us, event_id, event_type, previous FROM C WHERE k = 1 OR event_type IS DISTINCT FROM previous"""
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("user_id", "ts_us", "event_id", "event_type")
    return temporal.changes(rows, USER, "ts_us", "event_type", ["event_id"])


@query(f"WITH {_SQL_INTERVALS} SELECT c_custkey AS user_id, min(start_time) AS start_time, max(end_time) AS end_time FROM customer LEFT JOIN I ON I.user_id = c_custkey AND part = 'purchase' GROUP BY c_custkey")
def reading_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return temporal.reading_spans(sessions, _intervals(spark, sf_dir), "purchase", USER)


def _with_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's parts of a user as one interval of days, with the times of the events of that part as its transitions."""
    rows = frames(spark, sf_dir)
    spans = rows.groupBy("user_id", F.col("event_type").alias("part")).agg(F.min("ts_us").alias("start_time"), F.max("ts_us").alias("end_time"))
    times = rows.groupBy("user_id", F.col("event_type").alias("part")).agg(F.array_sort(F.collect_list("ts_us")).alias("transitions"))
    return spans.join(times, ["user_id", "part"])


@query(
    f"""WITH {SQL_FRAMES}, T AS (SELECT user_id, event_type AS part, min(ts_us) AS start_time, max(ts_us) AS end_time FROM F GROUP BY user_id, event_type)
SELECT user_id, part, start_time, end_time, end_time - start_time AS span FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY end_time - start_time DESC, start_time) AS k FROM T) WHERE k = 1"""
)
def longest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.longest_interval(_with_transitions(spark, sf_dir), USER).drop("transitions")


@query(f"WITH {SQL_FRAMES} SELECT user_id, max(ts_us) AS t FROM F WHERE event_type = 'purchase' GROUP BY user_id")
def last_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.last_transition(_with_transitions(spark, sf_dir), "purchase", USER)


@query(
    f"""WITH {SQL_FRAMES}, D AS (SELECT user_id, (max(ts_us) - min(ts_us)) / 1000000 AS d FROM F GROUP BY user_id), S AS (SELECT user_id, CAST(floor(d) AS DOUBLE) AS d FROM D)
SELECT user_id, CAST(k * 21600 AS DOUBLE) AS t FROM (SELECT user_id, d, unnest(range(CAST(ceil(d / 21600) AS BIGINT))) AS k FROM S) UNION ALL SELECT user_id, d FROM S"""
)
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = frames(spark, sf_dir).groupBy("user_id").agg(F.floor((F.max("ts_us") - F.min("ts_us")) / 1_000_000).cast("double").alias("d"))
    return temporal.sample_grid(spans, USER, "d", 21_600)


@query(
    f"""WITH {SQL_FRAMES}, E AS (SELECT user_id, day, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts_us DESC, event_id DESC) AS k FROM F) WHERE k = 1),
B AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM F GROUP BY user_id), T AS (SELECT user_id, CAST(unnest(range(lo, hi + 1)) AS INT) AS day FROM B)
SELECT user_id, day, coalesce(last_value(E.event_type IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'view') AS event_type
FROM T LEFT JOIN E USING (user_id, day)"""
)
def locf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    bounds = rows.groupBy("user_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return temporal.carried_grid(rows, USER, "day", "event_type", bounds, "view", ["ts_us", "event_id"])


@query(
    f"""WITH RECURSIVE {SQL_FRAMES}, H AS (SELECT user_id, ts_us // 3600000000 AS hour, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts_us // 3600000000 ORDER BY ts_us DESC, event_id DESC) AS k FROM F) WHERE k = 1),
EN AS (SELECT user_id, min(hour) AS lo, max(hour) AS hi FROM H GROUP BY user_id), T AS (SELECT user_id, unnest(range(lo, hi + 1)) AS hour FROM EN),
G AS MATERIALIZED (SELECT user_id, hour, last_value(H.event_type IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM T LEFT JOIN H USING (user_id, hour)),
SP AS (
  SELECT EN.user_id, lo, hi, x.v AS va, y.v AS vb FROM EN JOIN G x ON x.user_id = EN.user_id AND x.hour = lo JOIN G y ON y.user_id = EN.user_id AND y.hour = hi
  UNION ALL
  SELECT SP.user_id, CASE WHEN s = 0 THEN lo ELSE m.hour END, CASE WHEN s = 0 THEN m.hour ELSE hi END, CASE WHEN s = 0 THEN va ELSE m.v END, CASE WHEN s = 0 THEN m.v ELSE vb END
  FROM SP JOIN G m ON m.user_id = SP.user_id AND m.hour = (lo + hi) // 2, (SELECT unnest([0, 1]) AS s) WHERE hi - lo > 1 AND va <> vb
)
SELECT user_id, hi AS hour FROM SP WHERE hi - lo = 1 AND va <> vb"""
)
def change_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a user's last event is found to be of another kind, by halving the spans of all users at once."""
    rows = frames(spark, sf_dir).select("user_id", F.floor(F.col("ts_us") / 3_600_000_000).cast("long").alias("at"), "ts_us", "event_id", "event_type")
    latest = cut(rows.groupBy("user_id", "at").agg(F.max(F.struct("ts_us", "event_id", "event_type")).alias("e")).select("user_id", "at", F.col("e.event_type").alias("value")))
    spans = latest.groupBy("user_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return temporal.frontier_changes(spans, USER, lambda asked: temporal.asof(asked, latest, USER, "hour", "at", "value"), tick="hour")


_SQL_DELTAS = (
    SQL_FRAMES
    + """, K AS (SELECT user_id, day, event_type, count(*) AS n FROM F GROUP BY 1, 2, 3), D AS (SELECT DISTINCT user_id, day FROM F),
O AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM D),
T AS (SELECT DISTINCT event_type FROM F WHERE event_type <> 'view'),
X AS (
  SELECT O.user_id, O.day, O.before, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS d FROM O CROSS JOIN T
  LEFT JOIN K a ON a.user_id = O.user_id AND a.day = O.day AND a.event_type = T.event_type LEFT JOIN K b ON b.user_id = O.user_id AND b.day = O.before AND b.event_type = T.event_type
), DELTA AS (SELECT user_id, day, CAST(sum(CASE WHEN before IS NULL THEN 0 ELSE d END) AS BIGINT) AS delta FROM X GROUP BY user_id, day)"""
)


@query(f"WITH {_SQL_DELTAS} SELECT user_id, day, delta, CAST(row_number() OVER (PARTITION BY user_id ORDER BY delta DESC, day DESC) AS INT) AS rank FROM DELTA WHERE delta > 0")
def frame_delta_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.ranked_deltas(temporal.frame_deltas(frames(spark, sf_dir), USER, "day", "event_type", "view"), USER, "day")


@query(f"WITH {SQL_FRAMES} SELECT user_id, day, event_type, count(*) AS count FROM F GROUP BY 1, 2, 3")
def highlight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.frame_counts(frames(spark, sf_dir), USER, "day", "event_type")


@query(
    f"""WITH {SQL_FRAMES}, O AS (SELECT o_orderkey, o_custkey AS user_id, (o_orderkey * 7919) % 30 AS day FROM orders), E AS (
  SELECT user_id, day, min(event_id) AS first_id, max(event_id) AS event_id FROM F GROUP BY user_id, day)
SELECT o_orderkey, O.user_id, CAST(O.day AS INT) AS tick, arg_max(E.day, E.day) AS day, arg_max(E.event_id, E.day) AS event_id
FROM O LEFT JOIN E ON E.user_id = O.user_id AND E.day <= O.day GROUP BY o_orderkey, O.user_id, O.day"""
)
def asof_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), ((F.col("o_orderkey") * 7919) % 30).cast("int").alias("tick"))
    right = frames(spark, sf_dir).groupBy("user_id", "day").agg(F.max("event_id").alias("event_id"))
    return temporal.asof(left, right, USER, "tick", "day", "event_id")


@query(
    f"""WITH {SQL_FRAMES}, D AS (SELECT user_id, CAST(day AS DOUBLE) AS t, max(value) AS v FROM F GROUP BY user_id, day)
SELECT user_id, t, v FROM D UNION ALL SELECT user_id, t - 0.05, p FROM (SELECT user_id, t, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS p, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM D) WHERE k > 1"""
)
def step_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).groupBy("user_id", F.col("day").cast("double").alias("t")).agg(F.max("value").alias("v"))
    return temporal.step_series(rows, USER, "t", ["v"])


@query(
    f"""WITH {SQL_FRAMES}, D AS (SELECT user_id, CAST(day AS DOUBLE) AS t, max(value) AS v FROM F GROUP BY user_id, day)
SELECT user_id, t, v FROM D WHERE t > 5.5 AND t < 20.5
UNION ALL SELECT user_id, 5.5, arg_max(v, t) FROM D WHERE t <= 5.5 GROUP BY user_id UNION ALL SELECT user_id, 20.5, arg_min(v, t) FROM D WHERE t >= 20.5 GROUP BY user_id"""
)
def clipped_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).groupBy("user_id", F.col("day").cast("double").alias("t")).agg(F.max("value").alias("v"))
    return temporal.clip(rows, USER, "t", 5.5, 20.5)


@query(
    """WITH E AS (SELECT event_id, event_id * 3 AS hundredths FROM events)
SELECT event_id, CAST(hundredths // 6000 AS VARCHAR) AS minutes, CAST(hundredths / 100.0 AS DOUBLE) AS seconds,
  lpad(CAST(hundredths // 6000 AS VARCHAR), CAST(greatest(2, length(CAST(hundredths // 6000 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST((hundredths // 100) % 60 AS VARCHAR), 2, '0') AS label,
  CAST(floor(hundredths / 10.0 + 0.5) AS INT) AS tick FROM E"""
)
def time_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as file names and back: minutes of the name, the seconds that it decodes to, label and tick."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 3).alias("h"))
    named = rows.select("event_id", "h", S.time_to_filename(F.col("h") / 100).alias("name"))
    minutes = F.substring_index("name", "-", 1).cast("int").cast("string")
    return named.select("event_id", minutes.alias("minutes"), F.round(S.filename_to_time("name"), 2).alias("seconds"), S.tick_label(F.floor(F.col("h") / 10)).alias("label"), F.floor(F.col("h") / 10 + 0.5).cast("int").alias("tick"))


# highlights


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    kept = highlights.usable_frames(rows, USER, "day", F.col("event_type").isin(*HIGHLIGHTS))
    return rows.join(kept, ["user_id", "day"], "left_semi")


_SQL_USABLE = SQL_FRAMES + ", OK AS (SELECT user_id, day FROM F GROUP BY user_id, day HAVING avg(CASE WHEN event_type IN ('signup', 'purchase') THEN 1.0 ELSE 0.0 END) <= 0.6), V AS (SELECT F.* FROM F JOIN OK USING (user_id, day))"


@query(f"WITH {_SQL_USABLE} SELECT user_id, day FROM OK")
def usable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlights.usable_frames(frames(spark, sf_dir), USER, "day", F.col("event_type").isin(*HIGHLIGHTS))


@query(
    f"""WITH {_SQL_USABLE}, C AS (SELECT user_id, ts_us, event_id, gid, event_type, lag(event_type, 1, 'view') OVER (PARTITION BY user_id, gid ORDER BY ts_us, event_id) AS former FROM V)
SELECT user_id, ts_us, event_id, gid, event_type, former FROM C WHERE event_type <> former"""
)
def highlight_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = highlights.change_log(_usable(spark, sf_dir), USER, "gid", "event_type", ["ts_us", "event_id"], "view")
    return out.select("user_id", "ts_us", "event_id", "gid", "event_type", "former")


@query(
    f"""WITH RECURSIVE {_SQL_USABLE}, N AS (SELECT *, (gid + 1) % 8 AS other, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS k FROM V),
S AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ts_us, CAST(0 AS BIGINT) AS event_id, NULL::VARCHAR AS color, NULL::INT[] AS id_group, NULL::VARCHAR[] AS former, ['view', 'view', 'view', 'view', 'view', 'view', 'view', 'view'] AS state FROM N
  UNION ALL
  SELECT N.user_id, N.k, N.ts_us, N.event_id,
    CASE WHEN state[gid + 1] <> event_type AND state[other + 1] <> event_type THEN event_type END, [gid, other], [state[gid + 1], state[other + 1]],
    CASE WHEN state[gid + 1] <> event_type AND state[other + 1] <> event_type THEN [CASE WHEN i IN (gid, other) THEN event_type ELSE state[i + 1] END FOR i IN range(8)] ELSE state END
  FROM S JOIN N ON N.user_id = S.user_id AND N.k = S.k + 1
)
SELECT user_id, ts_us, event_id, unnest(id_group) AS gid, color AS text, array_to_string(id_group, ',') AS id_group, color, array_to_string(former, ',') AS former FROM S WHERE color IS NOT NULL"""
)
def highlight_events_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two ids: an event's id and the next."""
    rows = _usable(spark, sf_dir).select("user_id", "ts_us", "event_id", F.array("gid", ((F.col("gid") + 1) % 8)).cast("array<int>").alias("global_ids"), F.col("event_type").alias("highlight"), F.col("event_type").alias("text"))
    log = highlights.grouped_change_log(rows, USER, ["ts_us", "event_id"], default="view")
    return log.withColumns({"id_group": F.array_join(F.col("id_group").cast("array<string>"), ","), "former": F.array_join("former", ",")})


_PAIR_SQL = ", ".join(f"('{n}', {i}, {', '.join(f'{float(v)}' for v in (*bg, *fg))})" for i, (n, (bg, fg)) in enumerate(highlights.COLOUR_PAIRS.items()))


@query(
    f"""WITH E AS (SELECT vec_id, [CAST(floor(least(greatest((CAST(embedding[i] AS DOUBLE) + 1) * 127.5, 0), 255)) AS DOUBLE) FOR i IN [1, 2, 3, 4, 5, 6]] AS c FROM embeddings),
P(name, i, b1, b2, b3, f1, f2, f3) AS (VALUES {_PAIR_SQL}),
D AS (
  SELECT vec_id, name, i,
    (abs(c[1] - b1) * 0.299 + abs(c[2] - b2) * 0.587 + abs(c[3] - b3) * 0.114) + (abs(c[4] - f1) * 0.299 + abs(c[5] - f2) * 0.587 + abs(c[6] - f3) * 0.114) AS straight,
    (abs(c[1] - f1) * 0.299 + abs(c[2] - f2) * 0.587 + abs(c[3] - f3) * 0.114) + (abs(c[4] - b1) * 0.299 + abs(c[5] - b2) * 0.587 + abs(c[6] - b3) * 0.114) AS turned
  FROM E CROSS JOIN P
)
SELECT vec_id, name AS highlight, straight > turned AS swapped, round(least(straight, turned), 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(least(straight, turned), 9), i) AS k FROM D) WHERE k = 1"""
)
def nearest_colour_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.floor(F.least(F.greatest((F.get("embedding", i).cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("double").alias(f"c{i}") for i in range(6)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *c)
    found = highlights.nearest_pair(rows, ["c0", "c1", "c2"], ["c3", "c4", "c5"])
    return found.select("vec_id", "highlight", "swapped", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {SQL_CORPUS}, S AS (
  SELECT doc_name AS conv_id, CAST(row_number() OVER (PARTITION BY doc_name ORDER BY line_idx) - 1 AS INT) AS gid, line AS text FROM R
), P AS (
  SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY gid) - length(text) AS s FROM S
), G AS (SELECT conv_id, gid, CAST(s AS BIGINT) AS s, CAST(s + length(text) AS BIGINT) AS e FROM P),
C AS (SELECT conv_id, turn, gid, s, e, CASE WHEN (turn + gid // 2) % 3 = 0 THEN 'yellow' ELSE 'white' END AS color FROM G JOIN (SELECT conv_id, turn FROM conversations) USING (conv_id)),
N AS (SELECT *, CASE WHEN color IS DISTINCT FROM lag(color) OVER (PARTITION BY conv_id, turn ORDER BY s, gid) THEN 1 ELSE 0 END AS fresh FROM C WHERE e > s),
X AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM N)
SELECT conv_id, turn, min(s) AS "start", max(e) AS "end", color FROM X GROUP BY conv_id, turn, run, color"""
)
def highlight_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    words = rows.select(F.col("doc_name").alias("conv_id"), F.col("line_idx").alias("gid"), F.col("line").alias("text"))
    spans = highlights.char_spans(words, ["conv_id"], "gid").filter(F.col("end") > F.col("start"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    color = F.when((F.col("turn") + F.floor(F.col("gid") / 2)) % 3 == 0, "yellow").otherwise("white")
    states = turns.join(spans.select("conv_id", "gid"), "conv_id").withColumn("color", color)
    return highlights.highlight_runs(states, spans, ["conv_id"], "gid", "turn", "color")


# edits


@query(
    f"""WITH {SQL_BOXES}, X AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY (r - l) * (b - t) DESC, line_idx, word_idx) - 1 AS index, text FROM B
  WHERE NOT (l >= 1280 OR r >= 1280 OR t >= 720 OR b >= 720) AND b - t > 5 AND b - t < 70)
SELECT X.doc_id, CAST(X.index AS INT) AS index, coalesce(q.new_text, X.text) AS text, CASE WHEN q.doc_id IS NULL THEN 'white' WHEN quality = 1 THEN 'yellow' ELSE 'light blue' END AS highlight, q.doc_id IS NOT NULL AS edited_by_human
FROM X LEFT JOIN (SELECT doc_id, toxic AS index, 'edited' AS new_text, quality FROM labels) q ON q.doc_id = X.doc_id AND q.index = X.index"""
)
def edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as edits: the word whose index is `toxic` gets a new text and a colour."""
    words = geometry.editable_words(doc_words(spark, sf_dir), KEYS, 1280, 720).select("doc_id", "index", "text", "highlight")
    changed = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("index"), F.lit("edited").alias("text"), F.when(F.col("quality") == 1, "yellow").otherwise("light blue").alias("highlight"))
    return edits.apply_edits(words, changed, ["doc_id", "index"])


@query("SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.pending(table(spark, sf_dir, "documents").select("source", "doc_id"), table(spark, sf_dir, "labels"), KEYS)


@query("SELECT source, min(doc_id) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def next_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.next_frame(pending_frames(spark, sf_dir), ["source"], "doc_id")


# scrolling


def _session_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Anchored lines as a recording: a corpus item is a session, the documents that match it are its frames."""
    boxes = doc_lines(spark, sf_dir, dealt=True).select("doc_id", "line_idx", "bbox", *more)
    refs = corpus(spark, sf_dir).select("doc_name", F.col("line_idx").alias("ref_idx"), F.col("line").alias("updated_line"))
    found = _anchored(spark, sf_dir).join(match.beside(refs), ["doc_name", "ref_idx"])
    return found.join(boxes, ["doc_id", "line_idx"]).select("doc_name", "doc_id", "line_idx", "updated_line", "bbox", *more)


def _static_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("line_idx")
    return corpus(spark, sf_dir).select("doc_name", "line_idx", "line", (i * 24.0).alias("top"), (i * 24.0 + 16).alias("bottom"))


_SQL_MAPS = (
    SQL_BEST
    + """, PG AS (SELECT doc_name, line, max(line_idx) AS i FROM R GROUP BY doc_name, line),
SL AS (
  SELECT A.doc_id, A.doc_name, A.line_idx, PG.i * 24.0 AS top, PG.i * 24.0 + 16 AS bottom, L.line_idx * 20.0 AS ft, L.line_idx * 20.0 + 12 + length(L.text) % 9 AS fb
  FROM A JOIN L ON L.doc_id = A.doc_id AND L.line_idx = A.line_idx JOIN R ON R.doc_name = A.doc_name AND R.line_idx = A.ref_idx AND R.line <> '' JOIN PG ON PG.doc_name = R.doc_name AND PG.line = R.line
), PR AS (
  SELECT a.doc_name, a.doc_id, (b.bottom - a.top) / (b.fb - a.ft) AS m, a.top - a.ft * ((b.bottom - a.top) / (b.fb - a.ft)) AS a
  FROM SL a JOIN SL b ON a.doc_name = b.doc_name AND a.doc_id = b.doc_id AND a.line_idx < b.line_idx
), MAPS AS (SELECT doc_name, doc_id, median(m) AS multiplier, median(a) AS adder FROM PR GROUP BY doc_name, doc_id)"""
)


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scroll.frame_maps(_session_lines(spark, sf_dir), _static_page(spark, sf_dir), ["doc_name", "doc_id"], ["doc_name"], include_edges=True)


@query(f"WITH {_SQL_MAPS} SELECT doc_name, doc_id, round(multiplier, 6) AS multiplier, round(adder, 6) AS adder FROM MAPS")
def affine_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).select("doc_name", "doc_id", F.round("multiplier", 6).alias("multiplier"), F.round("adder", 6).alias("adder"))


@query(f"WITH {_SQL_MAPS} SELECT doc_name, doc_id, round(adder, 6) AS top, round(720 * multiplier + adder, 6) AS bottom FROM MAPS")
def scroll_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scroll.scroll_positions(_maps(spark, sf_dir), 720).select("doc_name", "doc_id", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query(
    f"""WITH RECURSIVE {SQL_BEST}, ML AS (
  SELECT A.doc_name, A.doc_id, A.line_idx, R.line, A.line_idx * 20.0 AS t, A.line_idx * 20.0 + 12 + length(L.text) % 9 AS b
  FROM A JOIN R ON R.doc_name = A.doc_name AND R.line_idx = A.ref_idx JOIN L ON L.doc_id = A.doc_id AND L.line_idx = A.line_idx WHERE R.line <> ''
), FI AS (SELECT doc_name, line, min(line_idx) AS ref_idx FROM R GROUP BY doc_name, line), LA AS (SELECT doc_name, max(line_idx) AS last_idx FROM R GROUP BY doc_name),
CH AS (
  SELECT ML.*, ref_idx, lag(t) OVER w AS pt, lag(b) OVER w AS pb, lag(ML.line) OVER w AS pl FROM ML JOIN FI ON FI.doc_name = ML.doc_name AND FI.line = ML.line
  WINDOW w AS (PARTITION BY ML.doc_name, doc_id ORDER BY line_idx)
), AD AS (
  SELECT CH.* FROM CH JOIN LA ON LA.doc_name = CH.doc_name JOIN R ON R.doc_name = CH.doc_name AND R.line_idx = CASE WHEN ref_idx > 0 THEN ref_idx - 1 ELSE last_idx END
  WHERE CASE WHEN pl IS NULL THEN ref_idx = 0 ELSE pl = R.line END
), ME AS (
  SELECT doc_name, ref_idx, avg(CASE WHEN pt IS NULL THEN t END) AS t0, avg(CASE WHEN pt IS NULL THEN b END) AS b0, avg((t - pt) * (pb - pt)) AS ma, avg((b - pt) * (pb - pt)) AS mb FROM AD GROUP BY doc_name, ref_idx
), PG AS (
  SELECT R.doc_name, R.line_idx, R.line, t0, b0, ma, mb FROM R LEFT JOIN ME ON ME.doc_name = R.doc_name AND ME.ref_idx = R.line_idx WHERE R.doc_name IN (SELECT doc_name FROM AD)
), ST AS (
  SELECT doc_name, line_idx, line, t0 AS top, b0 AS bottom FROM PG WHERE line_idx = 0
  UNION ALL SELECT PG.doc_name, PG.line_idx, PG.line, ST.top + ma / (ST.bottom - ST.top), ST.top + mb / (ST.bottom - ST.top) FROM ST JOIN PG ON PG.doc_name = ST.doc_name AND PG.line_idx = ST.line_idx + 1
)
SELECT doc_name AS item, doc_name, line_idx, line, round(top, 6) AS top, round(bottom, 6) AS bottom FROM ST"""
)
def stitched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _session_lines(spark, sf_dir).withColumn("item", F.col("doc_name"))
    adjacent = cut(scroll.adjacent_lines(lines, corpus(spark, sf_dir), ["item"], ["doc_id"]))  # read twice
    page = scroll.stitched_lines(adjacent, corpus(spark, sf_dir), ["item"])
    return page.withColumns({c: F.round(c, 6) for c in ("top", "bottom")})


# more of geometry, text and colour


@query(f"WITH {SQL_BOXES} SELECT doc_id, line_idx, word_idx FROM B WHERE l >= 1280 OR r >= 1280 OR t >= 720 OR b >= 720")
def words_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.out_of_image(doc_words(spark, sf_dir), 1280, 720).select("doc_id", "line_idx", "word_idx")


@query(
    f"""WITH {SQL_BOXES}, E AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY (r - l) * (b - t) DESC, line_idx, word_idx) - 1 AS INT) AS index,
  text, 'white' AS highlight, CAST(floor(l) AS INT) AS "left", CAST(floor(t) AS INT) AS top, CAST(floor(r) AS INT) AS "right", CAST(floor(b) AS INT) AS bottom
FROM B WHERE NOT (l >= 1280 OR r >= 1280 OR t >= 720 OR b >= 720) AND b - t > 5 AND b - t < 70)
SELECT doc_id, '[' || string_agg(CAST(to_json({{'index': index, 'text': text, 'highlight': highlight, 'left': "left", 'top': top, 'right': "right", 'bottom': bottom}}) AS VARCHAR), ',' ORDER BY index) || ']' AS words FROM E GROUP BY doc_id"""
)
def editable_words_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.words_json(editable_words(spark, sf_dir), KEYS)


_SQL_PERFECT = (
    SQL_BEST
    + """, ML AS (SELECT A.doc_id, A.line_idx, R.line FROM A JOIN R ON R.doc_name = A.doc_name AND R.line_idx = A.ref_idx),
ONCE AS (SELECT doc_id, line_idx, text FROM (SELECT doc_id, line_idx, unnest(string_split(line, ' ')) AS text FROM ML) GROUP BY ALL HAVING count(*) = 1),
PW AS (SELECT W.doc_id, W.line_idx, W.word_idx, W.text FROM W JOIN ONCE USING (doc_id, line_idx, text))"""
)


def _perfect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only anchored lines are split into words; they are few, and dealt by document for words and corpus lines."""
    matched = match.spread(cut(_session_lines(spark, sf_dir, "text")), *KEYS)
    # rows of one doc_id share their anchored lines: distinct
    return match.perfect_words(line_words(matched), matched.select("doc_id", "line_idx", "updated_line").distinct(), KEYS)


@query(f"WITH {_SQL_PERFECT} SELECT doc_id, line_idx, word_idx, text FROM PW")
def perfect_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perfect(spark, sf_dir).select("doc_id", "line_idx", "word_idx", "text")


@query(
    f"""WITH {_SQL_PERFECT}, CH AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?s).')) AS char FROM PW WHERE length(text) > 0)
SELECT doc_id, char, CAST(8.0 AS DOUBLE) AS width FROM CH GROUP BY doc_id, char HAVING count(*) >= 5"""
)
def char_width_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All characters are eight pixels wide in the driver's boxes."""
    return geometry.char_width_means(_perfect(spark, sf_dir), KEYS).select("doc_id", "char", F.round("width", 6).alias("width"))


@query(f"WITH {SQL_CORPUS} SELECT doc_name, max(line_idx) * 24.0 + 16 AS extent FROM R GROUP BY doc_name")
def page_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scroll.page_extent(_static_page(spark, sf_dir), ["doc_name"])


@query("SELECT doc_id, source || '_' || lang || '_' || doc_id AS session_id FROM documents")
def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".mp4").otherwise(".MKV")))
    return table(spark, sf_dir, "documents").select("doc_id", S.session_name(path).alias("session_id"))


@query(f"WITH {SQL_BOXES} SELECT doc_id, line_idx, word_idx, CAST(l AS DOUBLE) AS \"left\", CAST(b AS DOUBLE) AS bottom, CAST(word_idx % 100 AS VARCHAR) AS conf FROM B")
def title_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as title attributes and parsed again."""
    from ..sources.hocr import title_attributes, title_bbox

    sides = [F.col(f"bbox.{side}").cast("long").cast("string") for side in ("left", "top", "right", "bottom")]
    title = F.concat(F.lit("bbox "), F.concat_ws(" ", *sides), F.lit("; x_wconf "), (F.col("word_idx") % 100).cast("string"))
    rows = doc_words(spark, sf_dir).select("doc_id", "line_idx", "word_idx", title.alias("title"))
    box = title_bbox(F.col("title"))
    return rows.select("doc_id", "line_idx", "word_idx", box["left"].alias("left"), box["bottom"].alias("bottom"), title_attributes(F.col("title"))["x_wconf"].alias("conf"))


@query("SELECT p_partkey, printf('#%02x%02x%02x', p_partkey % 256, p_size * 5 % 256, CAST(floor(p_retailprice) AS BIGINT) % 256) AS hex, round(p_partkey % 256 * 0.299 + p_size * 5 % 256 * 0.587 + CAST(floor(p_retailprice) AS BIGINT) % 256 * 0.114, 6) AS grey FROM part")
def part_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.floor("p_retailprice") % 256
    return table(spark, sf_dir, "part").select("p_partkey", S.rgb_hex(r, g, b).alias("hex"), F.round(S.grey(r, g, b), 6).alias("grey"))


@query(
    f"""WITH {SQL_BEST}, G AS (SELECT doc_id, greatest(count(*) FILTER (WHERE length(text) > 0), 1) AS n FROM L GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(1 + (doc_id * 31) % 100 AS DOUBLE) AS gaze_x, CAST(2 * (1 + (doc_id * 31) % 100) + 50 AS DOUBLE) AS mapped_x FROM G"""
)
def mapped_gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gaze sample a document, mapped from a frame box to one twice its size, fifty pixels to the right."""
    lines = doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.greatest(F.count(F.when(F.length("text") > 0, 1)), F.lit(1)).alias("n"))
    frame, page = S.bbox(F.lit(0), F.lit(0), F.lit(100), F.lit(100)), S.bbox(F.lit(50), F.lit(0), F.lit(250), F.lit(200))
    corner = F.struct(frame.alias("bbox"), page.alias("page_box"))
    corners = lines.select("doc_id", corner.alias("a"), corner.alias("b"))
    samples = lines.select("doc_id", "n", (1 + (F.col("doc_id") * 31) % 100).cast("double").alias("gaze_x"), F.lit(10.0).alias("gaze_y"))
    return gaze.map_to_page(gaze.valid_gaze(samples), corners, KEYS, 1000, 1000).select("doc_id", "n", "gaze_x", "mapped_x")


@query(
    """WITH S AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_linenumber * 10 AS DOUBLE) AS y, l_quantity AS x FROM lineitem),
P AS (SELECT a.k, a.i AS label_id, b.i AS segment_id, abs(a.y - b.y - 3) * 2 AS d FROM S a JOIN S b ON a.k = b.k)
SELECT k AS l_orderkey, label_id, segment_id, CAST(d AS DOUBLE) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY k, label_id ORDER BY d, segment_id) AS n FROM P) WHERE n = 1"""
)
def nearest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal segments, a line item each, next to the same ones moved by three pixels."""
    base = match.spread(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), (F.col("l_linenumber") * 10.0).alias("y")), "l_orderkey").distinct()
    side = lambda dy: [F.lit(0.0).alias("x1"), (F.col("y") + dy).alias("y1"), F.lit(1.0).alias("x2"), (F.col("y") + dy).alias("y2")]
    labelled, found = base.select("l_orderkey", F.col("i").alias("label_id"), *side(0)), base.select("l_orderkey", F.col("i").alias("segment_id"), *side(3))
    return gaze.nearest_segments(found, labelled, ["l_orderkey"])


_ANGLES = 6
_SQL_ANGLES = ", ".join(f"({i}, CAST('{c!r}' AS DOUBLE), CAST('{s!r}' AS DOUBLE))" for i, c, s in hough.angles(_ANGLES))
_SQL_BESIDE = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))


@query(
    f"""WITH {SQL_LINES}, E AS (SELECT doc_id, CAST(unnest(range(length(text) // 8 + 1)) AS DOUBLE) AS x, line_idx * 4.0 AS y FROM L),
V AS MATERIALIZED (SELECT doc_id, x, y, theta, CAST(floor(x * c + y * s + 0.5) AS INT) AS rho, y * c - x * s AS along FROM E CROSS JOIN (VALUES {_SQL_ANGLES}) t(theta, c, s)),
N AS MATERIALIZED (SELECT doc_id, theta, rho, count(*) AS votes FROM V GROUP BY ALL HAVING count(*) >= 10),
T AS (SELECT doc_id, votes, -theta AS nt, -rho AS nr, theta + dt AS u, rho + dr AS w FROM N CROSS JOIN (VALUES {_SQL_BESIDE}) b(dt, dr)),
S AS (SELECT doc_id, CASE WHEN u < 0 THEN u + {_ANGLES} WHEN u >= {_ANGLES} THEN u - {_ANGLES} ELSE u END AS theta, CASE WHEN u < 0 OR u >= {_ANGLES} THEN -w ELSE w END AS rho, max((votes, nt, nr)) AS rival FROM T GROUP BY ALL),
P AS MATERIALIZED (SELECT N.doc_id, N.theta, N.rho FROM N LEFT JOIN S ON S.doc_id = N.doc_id AND S.theta = N.theta AND S.rho = N.rho WHERE rival IS NULL OR (votes, -N.theta, -N.rho) > rival),
O AS (SELECT V.*, along - lag(along) OVER w AS step FROM V JOIN P USING (doc_id, theta, rho) WINDOW w AS (PARTITION BY doc_id, theta, rho ORDER BY along, x, y)),
Q AS (SELECT *, sum(CASE WHEN step > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, theta, rho ORDER BY along, x, y) AS piece FROM O),
G AS (SELECT doc_id, theta, rho, piece, min((along, x, y)) AS a, max((along, x, y)) AS b, count(*) AS cells FROM Q GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY theta, rho, piece) - 1 AS INT) AS segment_id, CAST(theta AS INT) AS theta, rho, a[2] AS x1, a[3] AS y1, b[2] AS x2, b[3] AS y2, cells FROM G WHERE b[1] - a[1] >= 8"""
)
def hough_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments on a raster of each document's lines, a cell for eight characters."""
    lines = doc_lines(spark, sf_dir)
    runs = lines.select("doc_id", F.lit(0).alias("x"), (F.col("line_idx") * 4).alias("y"), F.floor(F.length("text") / 8).alias("more"))
    return hough.run_segments(runs, KEYS, _ANGLES, 10, 8.0, 1.5)


@query("SELECT user_id, CAST(window_start AS BIGINT) AS day, n FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS window_start, count(*) AS n FROM events GROUP BY 1, 2)")
def daily_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("user_id", F.col("day").cast("long").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT doc_name, line_idx, line FROM (SELECT doc_name, CAST(row_number() OVER (PARTITION BY doc_name ORDER BY line_idx) - 1 AS INT) AS line_idx, line FROM R WHERE trim(line) <> '')".join([f"WITH {SQL_CORPUS} ", ""]))
def filled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sessions import filled_lines

    return filled_lines(corpus(spark, sf_dir)).select("doc_name", "line_idx", "line")


@query(
    f"""WITH {_SQL_MAPS.replace("PR AS (", """IL AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_name, doc_id ORDER BY line_idx) AS up, row_number() OVER (PARTITION BY doc_name, doc_id ORDER BY line_idx DESC) AS down FROM SL) WHERE up > 1 AND down > 1
), PR AS (""").replace("FROM SL a JOIN SL b", "FROM IL a JOIN IL b")} SELECT doc_name, doc_id, round(multiplier, 6) AS multiplier, round(adder, 6) AS adder FROM MAPS"""
)
def inner_affine_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from the lines within each frame, without the first and last, which a screen's edge may cut."""
    maps = scroll.frame_maps(_session_lines(spark, sf_dir), _static_page(spark, sf_dir), ["doc_name", "doc_id"], ["doc_name"])
    return maps.select("doc_name", "doc_id", F.round("multiplier", 6).alias("multiplier"), F.round("adder", 6).alias("adder"))


@query(
    f"""WITH {_SQL_USABLE}, C AS (SELECT user_id, CASE WHEN gid = 0 THEN -1 ELSE gid END AS id, event_type, lag(event_type, 1, 'view') OVER (PARTITION BY user_id, gid ORDER BY ts_us, event_id) AS former FROM V)
SELECT user_id, count(*) AS written, count(*) FILTER (WHERE id <> -1) AS kept FROM C WHERE event_type <> former GROUP BY user_id"""
)
def report_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON, read again: their entries, and those that are left without the failed id."""
    rows = _usable(spark, sf_dir).withColumn("gid", F.when(F.col("gid") == 0, -1).otherwise(F.col("gid")))
    log = highlights.change_log(rows, USER, "gid", "event_type", ["ts_us", "event_id"], "view", exclude_failed=False)
    events = log.select("user_id", "ts_us", "gid", F.col("event_type").alias("text"), F.array("gid").alias("id_group"), F.col("event_type").alias("color"), F.array("former").alias("former"))
    report = F.from_json("report", highlights.REPORT)
    entries = highlights.report_json(events, USER, "ts_us").select("user_id", F.flatten(F.map_values(report)).alias("entries"))
    return entries.select("user_id", F.size("entries").cast("long").alias("written"), F.size(highlights.without_failed("entries")).cast("long").alias("kept"))


@query(
    """WITH E AS (SELECT event_id, (event_id % 1000) / 100.0 AS t FROM events)
SELECT event_id, CAST(round(t * 10) AS INT) AS tick, CAST(floor(t / CAST(0.1 AS DOUBLE)) AS INT) AS of_bound, CAST(floor(t * 10) AS INT) AS of_event FROM (SELECT event_id, CAST(t AS DOUBLE) AS t FROM E)"""
)
def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 1000) / 100.0).alias("t"))
    return rows.select("event_id", S.tick(t).alias("tick"), S.tick_of_bound(t).alias("of_bound"), S.tick_of_event(t).alias("of_event"))


@query(
    f"""WITH {SQL_CORPUS}, SP AS (SELECT doc_name, line_idx AS word, CAST(sum(length(line)) OVER (PARTITION BY doc_name ORDER BY line_idx) - length(line) AS BIGINT) AS s, length(line) AS n FROM R),
P AS (SELECT doc_name, CAST(unnest(range(0, total, 7)) AS BIGINT) AS position FROM (SELECT doc_name, CAST(sum(n) AS BIGINT) AS total FROM SP GROUP BY doc_name))
SELECT P.doc_name, position, word FROM P JOIN SP ON SP.doc_name = P.doc_name AND position >= s AND position < s + n"""
)
def words_of_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh character of a text, with the line of its page that it lies in."""
    spans = highlights.char_spans(corpus(spark, sf_dir).withColumnRenamed("line_idx", "word"), ["doc_name"], "word", "line").filter(F.col("end") > F.col("start"))
    totals = spans.groupBy("doc_name").agg(F.max("end").alias("total"))
    positions = totals.select("doc_name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(7).cast("long"))).alias("position"))
    return highlights.word_of_char(positions, spans, ["doc_name"], "position", "word")


@query(
    f"""WITH {_SQL_USABLE}, C AS (SELECT user_id, ts_us, CASE WHEN gid = 0 THEN -1 ELSE gid END AS id, event_type, lag(event_type, 1, 'view') OVER (PARTITION BY user_id, gid ORDER BY ts_us, event_id) AS former FROM V)
SELECT user_id, ts_us, count(*) FILTER (WHERE id <> -1) AS changes FROM C WHERE event_type <> former GROUP BY user_id, ts_us"""
)
def report_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to edit because a highlight changed in them; id 0 stands for failed assignments."""
    rows = _usable(spark, sf_dir).withColumn("gid", F.when(F.col("gid") == 0, -1).otherwise(F.col("gid")))
    return edits.report_frames(highlights.change_log(rows, USER, "gid", "event_type", ["ts_us", "event_id"], "view", exclude_failed=False), USER, "ts_us")


@query(
    f"""WITH {SQL_FRAMES}, T AS (SELECT user_id, day, max(ts_us) - min(ts_us) AS span, min(ts_us) AS start FROM F WHERE event_type = 'view' GROUP BY user_id, day),
B AS (SELECT user_id, day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY span DESC, start) AS k FROM T) WHERE k = 1)
SELECT F.user_id, ts_us AS t FROM F JOIN B ON B.user_id = F.user_id AND B.day = F.day WHERE event_type = 'view'"""
)
def longest_interval_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to edit: those of the longest interval of viewing, a day being an interval."""
    rows = frames(spark, sf_dir)
    spans = rows.groupBy("user_id", F.col("event_type").alias("part"), "day").agg(F.min("ts_us").alias("start_time"), F.max("ts_us").alias("end_time"), F.array_sort(F.collect_list("ts_us")).alias("transitions"))
    return edits.longest_interval_frames(spans, "view", USER)


@query(f"WITH {SQL_FRAMES} SELECT event_id, user_id, ts_us FROM F WHERE ts_us BETWEEN epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND epoch_us(TIMESTAMP '2024-01-07 00:00:00')")
def frames_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two days, both ends included, in order of time."""
    start = 1_704_412_800_000_000  # 2024-01-05 in microseconds
    return temporal.in_span(frames(spark, sf_dir).select("event_id", "user_id", "ts_us"), "ts_us", start, start + 2 * 86_400_000_000)
