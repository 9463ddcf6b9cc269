"""hOCR pages as lines and words, parsed in the JVM with XPath."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ascii_text, clean_text, filename_to_time

_LINE = '//*[contains(concat(" ", normalize-space(@class), " "), " ocr_line ")]'
_WORD = '*[contains(concat(" ", normalize-space(@class), " "), " ocrx_word ")]'


def title_attributes(title: Column) -> Column:
    """A title's properties: separated by "; ", the name up to the first space."""
    return F.str_to_map(title, F.lit("; "), F.lit(" "))


def title_bbox(title: Column) -> Column:
    sides = F.split(F.regexp_extract(title, r"bbox\s+([-0-9. ]+)", 1), r"\s+")
    return F.struct(*[F.get(sides, i).try_cast("double").alias(name) for i, name in enumerate(("left", "top", "right", "bottom"))])


def _prepare(content: Column) -> Column:
    """XML that XPath takes: no DOCTYPE, no default namespace."""
    return F.regexp_replace(F.regexp_replace(content, r"(?s)<!DOCTYPE.*?>", ""), r'\sxmlns="[^"]*"', "")


def read_hocr(spark: SparkSession, path: str, glob: str = "*.hocr") -> DataFrame:
    """(path, t, content) of every hOCR file below a folder; t from names like MM-S.s.hocr, else null."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), filename_to_time(F.col("_metadata.file_path")).alias("t"), F.col("value").alias("content"))


def hocr_elements(pages: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(path, t, idx, name, kind, element_id, title) of the elements of a page depth first, parents before children: the order of their
    opening tags. `predicate` is over these columns."""
    tags = F.regexp_extract_all(_prepare(F.col("content")), F.lit(r"(?s)<[A-Za-z][^<>]*>"), F.lit(0))
    rows = pages.select("path", "t", F.posexplode(tags).alias("idx", "tag"))
    quotes = r"""(?:"([^"]*)"|'([^']*)')"""
    value = lambda a: F.coalesce(F.regexp_substr("tag", F.lit(rf"(?s)(?<=\b{a}=['\"])[^'\"]*")), F.lit("")) if a != "title" else F.concat(*[F.regexp_extract("tag", rf"(?s)\btitle={quotes}", i) for i in (1, 2)])
    found = rows.select("path", "t", "idx", F.lower(F.regexp_extract("tag", r"<([^\s/>]+)", 1)).alias("name"), value("class").alias("kind"), value("id").alias("element_id"), value("title").alias("title"))
    return found if predicate is None else found.filter(predicate)


def hocr_lines(pages: DataFrame) -> DataFrame:
    """(path, t, line_idx, line_id, title, bbox) of the text lines in document order."""
    xml = pages.withColumn("__x", _prepare(F.col("content")))
    ids, titles = F.xpath("__x", F.lit(f"{_LINE}/@id")), F.xpath("__x", F.lit(f"{_LINE}/@title"))
    rows = xml.select("path", "t", F.posexplode(F.arrays_zip(ids.alias("id"), titles.alias("title"))).alias("line_idx", "r"))
    return rows.select("path", "t", "line_idx", F.col("r.id").alias("line_id"), title_attributes(F.col("r.title")).alias("title"), title_bbox(F.col("r.title")).alias("bbox"))


def hocr_words(pages: DataFrame) -> DataFrame:
    """(path, t, line_idx, word_idx, word_id, text, text_ascii, ocr_text, title, bbox): words with their line, in document order.

    Text may be nested (strong, em); em dashes become hyphens. Each line is cut out once, so a page is parsed line by line.
    """
    lines = pages.select("path", "t", F.posexplode(F.regexp_extract_all(_prepare(F.col("content")), F.lit(r"(?s)<span[^>]*\bocr_line\b.*?(?=<span[^>]*\bocr_line\b|</p>|</div>|\z)"), F.lit(0))).alias("line_idx", "part"))
    words = lines.select("path", "t", "line_idx", F.posexplode(F.regexp_extract_all("part", F.lit(r"(?s)<span[^>]*\bocrx_word\b[^>]*>.*?</span>"), F.lit(0))).alias("word_idx", "word"))
    attribute = lambda name: F.regexp_extract("word", rf"""(?s)^<span[^>]*?\b{name}=(?:"([^"]*)"|'([^']*)')""", 1)
    quoted = lambda name: F.concat(attribute(name), F.regexp_extract("word", rf"""(?s)^<span[^>]*?\b{name}=(?:"([^"]*)"|'([^']*)')""", 2))
    raw = F.regexp_replace("word", r"(?s)<[^>]*>", "")
    decoded = raw
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(name), F.lit(char))
    out = words.select("path", "t", "line_idx", "word_idx", quoted("id").alias("word_id"), clean_text(decoded).alias("text"), quoted("title").alias("__title"))
    return out.select("path", "t", "line_idx", "word_idx", "word_id", "text", ascii_text("text").alias("text_ascii"), F.col("text").alias("ocr_text"), title_attributes(F.col("__title")).alias("title"), title_bbox(F.col("__title")).alias("bbox"))


def first_attribute(rows: DataFrame, keys: list[str], order: list[str], attribute: Column, name: str) -> DataFrame:
    """(keys, name): the first value in document order that is not null."""
    found = rows.withColumn("__a", attribute).filter("__a IS NOT NULL")
    return found.groupBy(*keys).agg(F.min_by("__a", F.struct(*order)).alias(name))
