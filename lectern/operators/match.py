"""Matching noisy lines to a known corpus.

Inputs: `words` (doc keys..., line_idx, word_idx, text), `lines` (doc keys..., line_idx, text) and the corpus as
`ref_words` (word, doc_name) or `ref_lines` (doc_name, line_idx, line). `keys` names the columns of a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import UNIT, line_distance_udf
from ..functions.scalar import ascii_text, tokens

#: Longest word length that carries no evidence; most distance a gap-filled line may have.
MIN_EVIDENCE_LENGTH, MAX_LINE_DISTANCE = 2, 0.6
#: Rows of an index of the corpus that are sent to every task: some 10 MB.
MOST_SENT = 1 << 17


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over as many tasks as the session has: what comes next costs much a row, and few bytes would be coalesced into few tasks."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *columns)


def beside(index: DataFrame) -> DataFrame:
    """An index of the corpus, sent to every task if it is counted to be short: then the words of documents meet it where they are. A longer one is exchanged."""
    return F.broadcast(index) if index.limit(MOST_SENT + 1).count() <= MOST_SENT else index


def ref_tokens(ref_lines: DataFrame) -> DataFrame:
    """(doc_name, line_idx, word) for every token of the corpus."""
    return ref_lines.select("doc_name", "line_idx", F.explode(tokens("line")).alias("word"))


def document_dictionary(ref_lines: DataFrame) -> DataFrame:
    """The inverted index: distinct (word, doc_name)."""
    return ref_tokens(ref_lines).select("word", "doc_name").distinct()


def document_evidence(words: DataFrame, dictionary: DataFrame, keys: Sequence[str], dealt: bool = False) -> DataFrame:
    """(keys, doc_name, score): every occurrence of a word of two or more characters counts its length for each text that has it.

    Words that no text has are dropped first, and what is left is counted before the join, so a frequent word meets its texts once a document.
    A document's words come to one task, where all of this is done; `dealt` words are there already.
    """
    word = ascii_text("text")
    long_enough = words.select(*keys, word.alias("word")).filter(F.length("word") >= MIN_EVIDENCE_LENGTH)
    dictionary = beside(dictionary)
    known = long_enough.join(beside(dictionary.select("word").distinct()), "word", "left_semi")
    known = known if dealt else spread(known, *keys)
    counted = known.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return counted.join(dictionary, "word").groupBy(*keys, "doc_name").agg(F.sum(F.length("word") * F.col("n")).cast("long").alias("score"))


def best_document(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The text with the greatest score; of equal ones the first by name. A grouped maximum, no sort."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("doc_name").alias("d")))
    return evidence.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.d").alias("doc_name"), (-F.col("b.s")).alias("score"))


def session_document(best: DataFrame, session: str, time: str) -> DataFrame:
    """(session, doc_name): the choice of the first frame that has one."""
    return best.groupBy(session).agg(F.min(F.struct(time, "doc_name")).alias("b")).select(session, F.col("b.doc_name").alias("doc_name"))


def unique_words(ref_lines: DataFrame) -> DataFrame:
    """(doc_name, word, ref_idx) of the words that occur once in their text."""
    found = ref_tokens(ref_lines).groupBy("doc_name", "word").agg(F.count("*").alias("n"), F.min("line_idx").alias("ref_idx"))
    return found.filter("n = 1").drop("n")


def anchored_lines(words: DataFrame, best: DataFrame, unique: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_idx, doc_name, ref_idx, anchors): lines with two or more unique words that all stand in one line of the text."""
    # the words that are unique somewhere are few: they are found first, and only they move to their document, before they meet every text that has them
    marks = unique.select(F.col("word").alias("text"), "doc_name", "ref_idx")
    known = words.select(*keys, "line_idx", "text").join(beside(marks.select("text").distinct()), "text", "left_semi")
    hits = known.join(best.select(*keys, "doc_name"), list(keys)).join(beside(marks), ["doc_name", "text"])
    agreed = hits.groupBy(*keys, "line_idx", "doc_name").agg(F.count("*").alias("anchors"), F.min("ref_idx").alias("ref_idx"), F.max("ref_idx").alias("other"))
    return agreed.filter("anchors >= 2 AND ref_idx = other").select(*keys, "line_idx", "doc_name", "ref_idx", "anchors")


def gap_windows(lines: DataFrame, anchored: DataFrame, ref_lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_idx, doc_name, lo, hi): where the text's lines for an unmatched line may lie.

    With a matched line after it, as many lines before that one's match as there are between; else as many lines after the last match.
    Clamped to the text. Documents without a matched line have no windows. The anchored lines are read once: a line has its text's name from its neighbour.
    """
    sizes = ref_lines.groupBy("doc_name").agg(F.max("line_idx").alias("last_ref"))
    placed = lines.select(*keys, "line_idx").join(anchored.select(*keys, "line_idx", "doc_name", "ref_idx"), [*keys, "line_idx"], "left")
    order = Window.partitionBy(*keys).orderBy("line_idx")
    here = F.when(F.col("ref_idx").isNotNull(), F.struct("line_idx", "ref_idx", "doc_name"))
    ahead = F.first(here, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    behind = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = placed.select("*", ahead.alias("a"), behind.alias("b")).filter("ref_idx IS NULL AND (a IS NOT NULL OR b IS NOT NULL)")
    i = F.col("line_idx")
    lo = F.coalesce(F.col("a.ref_idx") - (F.col("a.line_idx") - i), F.col("b.ref_idx") + 1)
    hi = F.when(F.col("a").isNotNull(), F.col("a.ref_idx") - 1).otherwise(F.col("b.ref_idx") + (i - F.col("b.line_idx")))
    windows = gaps.select(*keys, "line_idx", F.coalesce("a.doc_name", "b.doc_name").alias("doc_name"), lo.alias("lo"), hi.alias("hi")).join(beside(sizes), "doc_name")
    return windows.select(*keys, "line_idx", "doc_name", F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", "last_ref").alias("hi"))


def least_distance(text: Column, line: Column) -> Column:
    """No line_distance of these is less: what the text is longer by has no counterpart and costs one a character; what it is shorter by is left
    out at the line's edges at least. From lengths alone: counting characters too costs more in the JVM than the alignments it saves."""
    return _least_distance(F.length(ascii_text(text)), F.trim(ascii_text(text)) == "", line)


def _least_distance(n: Column, blank: Column, line: Column) -> Column:
    """least_distance() of a text of n characters in ASCII."""
    gap = F.length(line) - n
    return F.when(blank, 1.0).when(gap < 0, -gap / n).otherwise(gap / UNIT / n)


def gap_pairs(windows: DataFrame, lines: DataFrame, ref_lines: DataFrame, keys: Sequence[str], limit: float | None = None) -> DataFrame:
    """(keys, line_idx, doc_name, ref_idx, text, line): the lines of each window; with a limit only those whose distance may be less.

    The range join is an equi-join: a window is spread over its line numbers, which an anchor's distance bounds.
    """
    wanted = windows.filter("lo <= hi").select(*keys, "line_idx", "doc_name", F.explode(F.sequence("lo", "hi")).alias("ref_idx"))
    refs = ref_lines.select("doc_name", F.col("line_idx").alias("ref_idx"), "line")
    # measured once a line, not once a pair
    ascii_lines = lines.select(*keys, "line_idx", "text", ascii_text("text").alias("__ascii"))
    texts = ascii_lines.select(*keys, "line_idx", "text", F.length("__ascii").alias("__n"), (F.trim("__ascii") == "").alias("__blank"))
    pairs = wanted.join(refs, ["doc_name", "ref_idx"]).join(texts, [*keys, "line_idx"])
    if limit is not None:
        # a hair above the limit, as the bound is a quotient of floating-point numbers
        pairs = pairs.filter(_least_distance(F.col("__n"), F.col("__blank"), F.col("line")) < limit + 1e-9)
    return pairs.select(*keys, "line_idx", "doc_name", "ref_idx", "text", "line")


def gap_candidates(windows: DataFrame, lines: DataFrame, ref_lines: DataFrame, keys: Sequence[str], limit: float | None = None) -> DataFrame:
    """(keys, line_idx, doc_name, ref_idx, dist): the lines of each window with their distance; empty windows have none. With a limit only
    those are aligned, and given, whose lower bound is less."""
    pairs = gap_pairs(windows, lines, ref_lines, keys, limit)
    return spread(pairs, *keys, "line_idx").select(*keys, "line_idx", "doc_name", "ref_idx", line_distance_udf("text", "line").alias("dist"))


def best_candidate(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The nearest candidate of each line, the first on a tie, if it is near enough."""
    best = F.min(F.struct("dist", "ref_idx", "doc_name"))
    return candidates.groupBy(*keys, "line_idx").agg(best.alias("b")).select(*keys, "line_idx", "b.doc_name", "b.ref_idx", "b.dist").filter(F.col("dist") < MAX_LINE_DISTANCE)


def one_line_each(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the lines matched to the same line of the text, the nearest; the first on a tie."""
    best = F.min(F.struct("dist", "line_idx"))
    kept = matches.groupBy(*keys, "ref_idx").agg(best.alias("b")).select(*keys, F.col("b.line_idx").alias("line_idx"))
    return matches.join(kept, [*keys, "line_idx"], "left_semi")


def match_lines(lines: DataFrame, words: DataFrame, best: DataFrame, ref_lines: DataFrame, keys: Sequence[str], anchored: DataFrame | None = None) -> DataFrame:
    """(keys, line_idx, updated_line, in_first_step, ref_idx, dist) for every line of a document with at least one anchored line.

    updated_line is empty where nothing fits. The anchored lines are read three times: a caller may hand in a stage table of them.
    """
    if anchored is None:
        anchored = anchored_lines(words, best, unique_words(ref_lines), keys)
    gaps = best_candidate(gap_candidates(gap_windows(lines, anchored, ref_lines, keys), lines, ref_lines, keys, MAX_LINE_DISTANCE), keys)
    refs = ref_lines.select("doc_name", F.col("line_idx").alias("ref_idx"), "line")
    first = anchored.join(refs, ["doc_name", "ref_idx"]).join(lines.select(*keys, "line_idx", "text"), [*keys, "line_idx"])
    first = first.select(*keys, "line_idx", "doc_name", "ref_idx", line_distance_udf("text", "line").alias("dist"), F.lit(True).alias("in_first_step"))
    every = one_line_each(first.unionByName(gaps.withColumn("in_first_step", F.lit(False))), keys)
    with_text = every.join(refs, ["doc_name", "ref_idx"]).drop("doc_name")
    usable = anchored.select(*keys).distinct()
    out = lines.select(*keys, "line_idx").join(usable, list(keys), "left_semi").join(with_text, [*keys, "line_idx"], "left")
    return out.select(*keys, "line_idx", F.coalesce("line", F.lit("")).alias("updated_line"), F.coalesce("in_first_step", F.lit(False)).alias("in_first_step"), "ref_idx", "dist")


def perfect_words(words: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words whose text occurs exactly once in the line that theirs was matched to."""
    tokens_of = matched.select(*keys, "line_idx", F.explode(tokens("updated_line")).alias("text"))
    once = tokens_of.groupBy(*keys, "line_idx", "text").count().filter("count = 1").drop("count")
    return words.join(once, [*keys, "line_idx", "text"], "left_semi")


def exact_line_rate(matched_text: DataFrame, ref_lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rate): share of lines that stand in the corpus word for word."""
    known = ref_lines.select(F.col("line").alias("text"), F.lit(1.0).alias("hit")).distinct()
    return matched_text.join(known, "text", "left").groupBy(*keys).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("rate"))
