"""Quality rules by distribution divergence.

One scan counts, per document, characters by class and occurrences of common words. The language references are the
same counts summed over the language's documents that look like prose by fixed bounds (words enough, few repeats, mostly letters, some common words), so
they follow the corpus but not its junk, even where most of a language is junk. A document whose character classes or
common words diverge from its language's by more than a Jensen-Shannon distance is rejected. Common words are tested
twice: their share of all words (a text of word-like tokens lacks them) and their histogram (a text of another language
has the wrong ones). Each test needs a minimum length, below which too few symbols were drawn for the distance to mean
anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, external_id, internal_id, materialise, quoted, record_batches, slices
from .textscan import SPACE, Ranges, mix, range_hashes, unequal, words

#: The most frequent function words of the languages that the word histogram covers.
COMMON_WORDS = (
    "the of and to in is that for it with as was on be by this are from or an at not have but they you we his her which "
    "de la le les et des en un une du que est pour dans qui au par sur pas plus avec ce il ne se son ou sont "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "el y los del las por con no su para al lo como más pero sus o si este entre cuando muy sin sobre también me hasta hay"
).split()
#: Character classes: lower and upper ASCII letters, digits, white space, sentence marks, other marks, symbols, beyond ASCII.
CLASSES = 8
SYMBOLS = b"#*$%&|<>"

#: Base rule, and limits of the divergence tests: least words or characters, and greatest distance (base 2, 0 to 1).
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
MIN_CLASS_CHARS, MAX_CLASS_DISTANCE = 200, 0.34
#: Limits lie in gaps between the distances of all documents of sf0.1: those of classes have none in 0.334 to 0.357, those of the share none in
#: 0.138 to 0.191. The histogram is for texts of another language, which begin at 0.333; prose thins out up to there, and texts without common words
#: fail by their share.
MIN_COMMON_WORDS, MAX_COMMON_DISTANCE, MAX_SHARE_DISTANCE = 100, 0.33, 0.15
#: What a document of a reference has at least: this share of letters in what is not white space, and of common words in its words.
MIN_LETTERS, MIN_COMMON_SHARE = 0.6, 0.1
#: Such documents of a language below which there is no reference: they would mostly be compared with themselves.
MIN_REFERENCE_DOCS = 5

_STATS = pa.schema(
    [(c, pa.int64()) for c in ("row", "tag", "chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("lang", pa.string()), ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))]
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class_table() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[SPACE] = 3
    table[list(b".,;:!?'\"-()")] = 4
    table[list(SYMBOLS)] = 6
    table[0xC0:] = 7
    table[0x80:0xC0] = CLASSES  # continuation bytes are no characters
    return table


_CLASS = _class_table()


@lru_cache(maxsize=1)
def _common_index() -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, word number) of the common words."""
    encoded = [w.encode() for w in dict.fromkeys(COMMON_WORDS)]
    ends = np.cumsum([len(w) for w in encoded])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    hashes = range_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
    order = np.argsort(hashes)
    return hashes[order], order


def _repeats(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries whose key is one of several in their text, and for each the first of them."""
    both = mix(key + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(both)
    several = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(several):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(several[np.minimum(np.searchsorted(several, both), len(several) - 1)] == both)
    _, first, group = np.unique(both[at], return_index=True, return_inverse=True)
    return at, at[first[group]]


def _word_scan(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, text index, hash, common word's number) of every word; the number of other words comes after the last."""
    if len(off) == 2 and len(data) > SLICE_BYTES:  # one long text, a piece at a time, cut at white space
        parts, a = [], 0
        while a < len(data):
            b = min(a + SLICE_BYTES, len(data))
            while b < len(data) and not SPACE[data[b]]:
                gap = np.flatnonzero(SPACE[data[b : b + 4096]])
                b += int(gap[0]) if len(gap) else len(data[b : b + 4096])
            start, end, *others = _words_of(data[a:b], np.array([0, b - a]))
            parts.append((start + a, end + a, *others))
            a = b
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _words_of(data, off)


def _words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    start, end, text = words(data, off)
    index, number = _common_index()
    hashes = range_hashes(_LOWER[data], start, end)
    slot = np.minimum(np.searchsorted(index, hashes), len(index) - 1)
    return start, end, text.astype(np.int32), range_hashes(data, start, end), np.where(index[slot] == hashes, number[slot], len(index)).astype(np.int16)


def _classes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Characters of each text by class."""
    n = len(off) - 1
    if n == 1:
        return sum(np.bincount(_CLASS[data[a : a + SLICE_BYTES]], minlength=CLASSES + 1) for a in range(0, max(1, len(data)), SLICE_BYTES))[None, :CLASSES]
    of_byte = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(of_byte * (CLASSES + 1) + _CLASS[data], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def _recount(text: bytes) -> tuple[int, int]:
    """(repeated lines, words in repeated windows) of one text, by comparing them as they are."""
    lines = [x for x in text.split(b"\n") if x.split()]
    parts = text.split()
    seen: dict[tuple, list[int]] = {}
    for i in range(len(parts) - REPEAT_WINDOW + 1):
        seen.setdefault(tuple(parts[i : i + REPEAT_WINDOW]), []).append(i)
    return len(lines) - len(set(lines)), len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(REPEAT_WINDOW)})


def text_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a slice.

    Lines and windows are found by hashes; what is found is compared byte by byte, and a text in which hashes were wrong is
    counted once more without them.
    """
    n = len(off) - 1
    start, end, text, own, common_number = _word_scan(data, off)
    classes = _classes(data, off)
    width = len(_common_index()[0]) + 1
    n_words = np.bincount(text, minlength=n)
    common = np.bincount(text * width + common_number, minlength=n * width).reshape(n, width)
    del common_number
    wrong: set[int] = set()

    repeat = np.zeros(n, np.int64)
    w = REPEAT_WINDOW
    if len(text) >= w:
        at = np.flatnonzero(text[w - 1 :] == text[: len(text) - w + 1])  # windows that lie in one text
        again, head = _repeats(text[at], Ranges(own).windows(w)[at])
        found, head = at[again], at[head]
        for k in range(w):  # the words of a window and of the first one like it
            wrong.update(text[found[own[found + k] != own[head + k]]].tolist())
        edge = np.zeros(len(text) + 1, np.int32)
        np.add.at(edge, found, 1)
        np.add.at(edge, found + w, -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        repeat = np.bincount(text[inside], minlength=n)
        _, first, group = np.unique(own[inside], return_index=True, return_inverse=True)
        alike, size = inside[first[group]], (end - start)[inside]
        wrong.update(text[inside[size != (end - start)[alike]]].tolist())
        wrong.update(text[inside[unequal(data, start[inside], start[alike], np.minimum(size, (end - start)[alike]))]].tolist())

    cut = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([off, cut, cut + 1]))
    a, b = bounds[:-1], bounds[1:]
    keep = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b = a[keep], b[keep]
    dup = np.zeros(n, np.int64)
    if len(a):
        line_text = np.searchsorted(off, a, side="right") - 1
        later, head = _repeats(line_text, range_hashes(data, a, b))
        later, head = later[later != head], head[later != head]
        size = (b - a)[later]
        wrong.update(line_text[later[size != (b - a)[head]]].tolist())
        wrong.update(line_text[later[unequal(data, a[later], a[head], np.minimum(size, (b - a)[head]))]].tolist())
        dup = np.bincount(line_text[later], minlength=n)
    for i in wrong:
        dup[i], repeat[i] = _recount(data[off[i] : off[i + 1]].tobytes())
    word_chars = classes.sum(axis=1) - classes[:, 3]
    return {"chars": classes.sum(axis=1), "n_words": n_words, "word_chars": word_chars, "n_symbols": classes[:, 6], "n_dup_lines": dup, "n_repeat_words": repeat, "classes": classes, "common": common}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in slices(batches, "text"):
        out: dict = text_stats(data, off)
        for name in ("classes", "common"):
            m = out[name]
            ends = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
            out[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel().astype(np.int64)))
        yield from record_batches(_STATS, out | {"row": rows.column("row"), "tag": rows.column("tag"), "lang": rows.column("lang")}, 4096)


def divergence(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of an array of counts that add up to `total` and an array of shares; null if total is zero.

    Totals are columns, not expressions within the fold, which would be evaluated once an element.
    """
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    pairs = F.zip_with(counts, reference, lambda x, y: F.struct(F.try_divide(x.cast("double"), total.cast("double")).alias("x"), y.alias("y")))
    inner = F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + (part(s["x"], (s["x"] + s["y"]) / 2) + part(s["y"], (s["x"] + s["y"]) / 2)) / 2)
    return F.when(total > 0, F.sqrt(F.greatest(inner, F.lit(0.0))))


_DDL = "row long, tag long, chars long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, classes array<long>, common array<long>"


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def language_references(stats: DataFrame) -> DataFrame:
    """(ref_lang, docs, plausible, worded, ref_classes, ref_common), one row per language.

    References are shares over all documents of the language that are plausible (they pass the base rule and are mostly letters) and
    worded (they have common words). A language that the common words don't cover has too few of those: its classes are those of the plausible
    documents, and ref_common is null; so is ref_classes with less than MIN_REFERENCE_DOCS plausible ones.
    """
    widths = {"classes": CLASSES, "common": len(_common_index()[0]) + 1}
    letters = F.col("classes")[0] + F.col("classes")[1] + F.col("classes")[7]
    plausible = ~base_failed() & (letters >= MIN_LETTERS * (F.col("chars") - F.col("classes")[3]))
    worded = plausible & (F.col("n_words") - F.element_at("common", -1) >= MIN_COMMON_SHARE * F.col("n_words"))
    marked = stats.withColumns({"p": plausible.cast("long"), "w": worded.cast("long")})
    total = lambda value, of: F.sum(F.col(of) * value)
    sums = marked.groupBy("lang").agg(
        *[total(F.col("classes")[i], of).alias(f"{of}{i}") for of in "pw" for i in range(CLASSES)], *[total(F.col("common")[i], "w").alias(f"c{i}") for i in range(widths["common"])],
        F.sum("p").alias("plausible"), F.sum("w").alias("worded"), F.count("*").alias("docs"), total(F.col("chars"), "p").alias("p"), total(F.col("chars"), "w").alias("w"), total(F.col("n_words"), "w").alias("c"),
    )
    shares = lambda of, n: F.array(*[F.try_divide(F.col(f"{of}{i}").cast("double"), F.col(of).cast("double")) for i in range(n)])
    enough = lambda c: F.col(c) >= MIN_REFERENCE_DOCS
    return sums.select(
        F.col("lang").alias("ref_lang"), "docs", "plausible", "worded",
        F.when(enough("worded"), shares("w", CLASSES)).when(enough("plausible"), shares("p", CLASSES)).alias("ref_classes"), F.when(enough("worded"), shares("c", widths["common"])).alias("ref_common"),
    )


def reference_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, docs, plausible, worded, has_classes, has_words): what each language's documents can be compared with. Where has_words is
    false the common-word tests let everything pass, and where has_classes is, the base rule alone judges."""
    refs = language_references(_stats(docs, id_col, text_col, lang_col))
    return refs.select(F.col("ref_lang").alias("lang"), "docs", "plausible", "worded", F.col("ref_classes").isNotNull().alias("has_classes"), F.col("ref_common").isNotNull().alias("has_words"))


def _stats(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.col(quoted(text_col)).cast("string")
    base = docs.select(internal_id(quoted(id_col)).alias("row"), F.xxhash64(text).alias("tag"), F.col(quoted(lang_col)).cast("string").alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    return base.mapInArrow(_scan, _DDL)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: did, tag (hash of the text), the counts, class_distance, common_distance, share_distance, base_failed, kept.

    share_distance is of common words against all others, zero where a text has no smaller share of them than its language.

    A null text has no words and fails the base rule; a null id is held last; a null language is a language of its own; documents of
    a language without a reference (language_references, reported by reference_report) pass the tests that need it; repeated rows are counted each time; a
    text of more than a slice's 4 MB is scanned in pieces, which hold about twelve bytes a byte of it; an empty table gives no rows;
    names of other columns don't matter.
    """
    stats = materialise(_stats(docs, id_col, text_col, lang_col), "stats", compression="zstd")
    refs = materialise(language_references(stats).select("ref_lang", "ref_classes", "ref_common"), "references", stats)
    other, ref_other = F.element_at("common", -1), F.element_at("ref_common", -1)
    split = divergence(F.array(F.col("n_words") - other, other), F.col("n_words"), F.array(1 - ref_other, ref_other))
    joined = stats.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").select(
        *[c for c in stats.columns if c not in ("classes", "common")],
        divergence(F.col("classes"), F.col("chars"), F.col("ref_classes")).alias("class_distance"),
        divergence(F.col("common"), F.col("n_words"), F.col("ref_common")).alias("common_distance"),
        F.when(ref_other.isNull(), None).when(F.col("n_words") * ref_other >= other, 0.0).otherwise(split).alias("share_distance"),
    )
    # without a reference distances are null, and so is the test
    far = ((F.col("chars") >= MIN_CLASS_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        (F.col("n_words") >= MIN_COMMON_WORDS) & ((F.col("common_distance") > MAX_COMMON_DISTANCE) | (F.col("share_distance") > MAX_SHARE_DISTANCE))
    )
    return joined.withColumnRenamed("row", "did").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def op7(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select(external_id("did").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SHARES = "CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END"
OP7_SQL = rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), c AS (
  SELECT *, len(ws) AS n, length(text) AS chars, [length(regexp_replace(text, p, '', 'g')) FOR p IN ['[^a-z]', '[^A-Z]', '[^0-9]', '[^\x20\x09-\x0D]', '[^.,;:!?''"()\x2D]', '[^#*$%&|<>]', '[\x00-\x7F]']] AS k FROM w
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), win AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + {REPEAT_WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS s FROM w WHERE len(ws) >= {REPEAT_WINDOW})
), again AS (
  SELECT doc_id, count(DISTINCT i) AS words FROM (SELECT doc_id, unnest(range(s, s + {REPEAT_WINDOW})) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS m FROM win) WHERE m > 1) GROUP BY doc_id
), cls AS (
  SELECT doc_id, lang, chars, unnest(list_append(k, chars - list_sum(k))) AS v, unnest(range(8)) AS i FROM c
), vocabulary AS (
  SELECT unnest([{", ".join(f"'{v}'" for v in dict.fromkeys(COMMON_WORDS))}]) AS word
), seen AS (
  SELECT doc_id, lang, n, coalesce(v.word, '') AS word, count(*) AS m FROM (SELECT doc_id, lang, n, unnest(ws) AS word FROM c) x
  LEFT JOIN vocabulary v ON v.word = translate(x.word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') GROUP BY ALL
), plausible AS (
  SELECT c.doc_id, lang, n - coalesce(o.m, 0) >= {MIN_COMMON_SHARE} * n AS worded FROM c LEFT JOIN again USING (doc_id) LEFT JOIN (SELECT doc_id, m FROM seen WHERE word = '') o USING (doc_id)
  WHERE n >= {MIN_WORDS} AND 100 * coalesce(words, 0) <= {MAX_REPEAT_PERCENT} * n AND k[1] + k[2] + k[7] >= {MIN_LETTERS} * (chars - k[4])
), enough AS (
  SELECT lang, count(*) FILTER (worded) >= {MIN_REFERENCE_DOCS} AS by_words, count(*) >= {MIN_REFERENCE_DOCS} AS by_classes FROM plausible GROUP BY lang
), refcls AS (
  SELECT cls.lang, i, sum(v) / sum(sum(v)) OVER (PARTITION BY cls.lang) AS y FROM cls JOIN plausible p ON p.doc_id = cls.doc_id JOIN enough e ON e.lang IS NOT DISTINCT FROM cls.lang
  WHERE by_classes AND (worded OR NOT by_words) GROUP BY cls.lang, i
), cdist AS (
  SELECT doc_id, sqrt(greatest(sum({_SHARES}) / 2, 0)) AS d FROM (SELECT doc_id, v / chars AS x, y FROM cls JOIN refcls r ON r.i = cls.i AND r.lang IS NOT DISTINCT FROM cls.lang WHERE chars > 0) GROUP BY doc_id
), refword AS (
  SELECT seen.lang, word, sum(m) / sum(sum(m)) OVER (PARTITION BY seen.lang) AS y FROM seen JOIN plausible p ON p.doc_id = seen.doc_id JOIN enough e ON e.lang IS NOT DISTINCT FROM seen.lang WHERE by_words AND worded GROUP BY seen.lang, word
), wdist AS (
  SELECT doc_id, sqrt(greatest((sum({_SHARES}) + 1 - sum(y)) / 2, 0)) AS d FROM (
    SELECT doc_id, m / n AS x, coalesce(y, 0) AS y FROM seen JOIN enough e ON e.lang IS NOT DISTINCT FROM seen.lang AND by_words LEFT JOIN refword r ON r.word = seen.word AND r.lang IS NOT DISTINCT FROM seen.lang) GROUP BY doc_id
), other AS (
  SELECT c.doc_id, coalesce(m, 0) / c.n AS o, coalesce(y, 0) AS ro FROM c JOIN enough e ON e.lang IS NOT DISTINCT FROM c.lang AND by_words LEFT JOIN seen ON seen.doc_id = c.doc_id AND seen.word = '' LEFT JOIN refword r ON r.word = '' AND r.lang IS NOT DISTINCT FROM c.lang WHERE c.n > 0
), split AS (
  SELECT doc_id, unnest([o, 1 - o]) AS x, unnest([ro, 1 - ro]) AS y FROM other WHERE o > ro
), sdist AS (
  SELECT doc_id, sqrt(greatest(sum({_SHARES}) / 2, 0)) AS d FROM split GROUP BY doc_id
), f AS (
  SELECT c.doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(k[6] AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(words, 0) AS BIGINT) AS n_repeat_words, n < {MIN_WORDS} OR 100 * coalesce(words, 0) > {MAX_REPEAT_PERCENT} * n AS base_failed,
    (chars >= {MIN_CLASS_CHARS} AND coalesce(cdist.d, 0) > {MAX_CLASS_DISTANCE} OR n >= {MIN_COMMON_WORDS} AND (coalesce(wdist.d, 0) > {MAX_COMMON_DISTANCE} OR coalesce(sdist.d, 0) > {MAX_SHARE_DISTANCE})) AS far
  FROM c LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN cdist USING (doc_id) LEFT JOIN wdist USING (doc_id) LEFT JOIN sdist USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM f
"""
