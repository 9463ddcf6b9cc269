"""Sizes of lines and words, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.scalar import height, outside_image, width
from ..sinks.scratch import cut
from .chains import distinct_values, kept

SPACE_WIDTH, NEAR_MEDIAN = 5.0, 0.1
MIN_EDIT_HEIGHT, MAX_EDIT_HEIGHT = 5, 70


def median_height(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, med_height)."""
    return lines.groupBy(*keys).agg(F.median(height("bbox")).alias("med_height"))


def near_median(box: Column | str, median: Column | str) -> Column:
    """Height within a tenth of the median, ends included."""
    m = F.col(median) if isinstance(median, str) else median
    return F.abs(height(box) - m) <= NEAR_MEDIAN * m


def space_width(lines: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, med_height, space_width): median gap between neighbouring words of lines of near-median height; 5 if there are none."""
    heights = median_height(lines, keys)
    usual = lines.join(heights, list(keys)).filter(near_median("bbox", "med_height")).select(*keys, "line_idx")
    order = Window.partitionBy(*keys, "line_idx").orderBy("word_idx")
    gap = F.col("bbox.left") - F.lag("bbox.right").over(order)
    gaps = words.join(usual, [*keys, "line_idx"], "left_semi").select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.median("gap").alias("gap"))
    return heights.join(gaps, list(keys), "left").select(*keys, "med_height", F.coalesce("gap", F.lit(SPACE_WIDTH)).alias("space_width"))


def char_width_means(perfect: DataFrame, keys: Sequence[str], least: int = 5) -> DataFrame:
    """(keys, char, width): mean share of a word's width over `least` or more sightings."""
    chars = perfect.select(*keys, (width("bbox") / F.length("text")).alias("w"), F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("char"))
    return chars.groupBy(*keys, "char").agg(F.avg("w").alias("width"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")


def out_of_image(words: DataFrame, image_width: float, image_height: float) -> DataFrame:
    return words.filter(outside_image("bbox", image_width, image_height))


def editable_words(words: DataFrame, keys: Sequence[str], image_width: float, image_height: float) -> DataFrame:
    """(keys, index, line_idx, word_idx, text, highlight, left, top, right, bottom): words to correct, the largest first.

    In the image, higher than 5 and lower than 70 pixels; equal areas keep document order.
    """
    inside = words.filter(~outside_image("bbox", image_width, image_height) & (height("bbox") > MIN_EDIT_HEIGHT) & (height("bbox") < MAX_EDIT_HEIGHT))
    area = width("bbox") * height("bbox")
    order = Window.partitionBy(*keys).orderBy(area.desc(), "line_idx", "word_idx")
    sides = [F.col(f"bbox.{side}").cast("int").alias(side) for side in ("left", "top", "right", "bottom")]
    return inside.select(*keys, (F.row_number().over(order) - 1).alias("index"), "line_idx", "word_idx", "text", F.coalesce("highlight", F.lit("white")).alias("highlight"), *sides)


def words_json(editable: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, words): the list as JSON, in order of index."""
    one = F.struct("index", "text", "highlight", "left", "top", "right", "bottom")
    return editable.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("words"))


def document_text(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, text): the words of each line joined by spaces, the lines by line breaks."""
    rows = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    line = words.groupBy(*keys, "line_idx").agg(F.array_join(F.transform(rows, lambda w: w["text"]), " ").alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    return line.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda w: w["line"]), "\n").alias("text"))


def _centres(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, values, gap): vertical line centres, and half the median height."""
    centre = (F.col("bbox.top") + F.col("bbox.bottom")) / 2
    return distinct_values(lines, keys, centre, F.median(height("bbox")) * 0.5)


def line_centres(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, centre): vertical line centres, without those closer than half the median height to the last one kept, from the top."""
    return _centres(lines, keys).select(*keys, F.explode(kept("values", "gap")).alias("centre"))


@F.pandas_udf(ArrayType(DoubleType()))
def _nearest(places: pd.Series, centres: pd.Series) -> pd.Series:
    """The centre nearest to each place, the lower on a tie."""
    out = []
    for at, c in zip(places, map(np.asarray, centres), strict=True):
        i = np.searchsorted(c, at, "right")
        up, down = c[np.maximum(i - 1, 0)], c[np.minimum(i, len(c) - 1)]
        out.append(np.where((i == len(c)) | (i > 0) & ~(at - up > down - at), up, down))
    return pd.Series(out, dtype=object)


def reading_order(words: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """words with `reading_idx`: by the nearest kept line centre (the upper on a tie), then by horizontal centre.

    Words share few heights: a document's distinct ones meet its centres as an array, and words have theirs from a lookup, where they were dealt to.
    A word without a height stands at the top; a document without lines has no words.
    """
    y, x = (F.col("bbox.top") + F.col("bbox.bottom")) / 2, (F.col("bbox.left") + F.col("bbox.right")) / 2
    placed = words.withColumn("__at", F.coalesce(y, F.lit(float("-inf"))))
    heights = placed.select(*keys, "__at").distinct().groupBy(*keys).agg(F.collect_list("__at").alias("all"))
    near = heights.join(_centres(lines, keys), list(keys)).select(*keys, F.explode(F.arrays_zip("all", _nearest("all", kept("values", "gap")).alias("near"))).alias("h"))
    # heights are hashed, so that words are not sorted for them
    found = placed.join(near.select(*keys, F.col("h.all").alias("__at"), F.col("h.near").alias("__line")).hint("shuffle_hash"), [*keys, "__at"])
    in_order = Window.partitionBy(*keys).orderBy("__line", x, "line_idx", "word_idx")
    return found.select(*words.columns, (F.row_number().over(in_order) - 1).alias("reading_idx"))


def heatmap(points: DataFrame, x: str, y: str, size: int = 100, dense: bool = True) -> DataFrame:
    """(y_idx, x_idx, count): points per square cell, zero-filled up to the greatest cells with points, from zero or the least ones."""
    cells = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.floor(F.col(y) / size).cast("int").alias("y_idx"), F.floor(F.col(x) / size).cast("int").alias("x_idx"))
    counts = cells.groupBy("y_idx", "x_idx").agg(F.count("*").alias("count"))
    if not dense:
        return counts
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("y_idx", "x_idx")]
    span = counts.agg(*ends).filter("hi_y_idx IS NOT NULL")
    every = lambda c: F.explode(F.sequence(F.least(F.lit(0), f"lo_{c}"), f"hi_{c}")).alias(c)
    grid = span.select("*", every("y_idx")).repartition("y_idx").select("y_idx", every("x_idx"))
    return grid.join(counts, ["y_idx", "x_idx"], "left").select("y_idx", "x_idx", F.coalesce("count", F.lit(0)).alias("count"))


def equal_mass_cutoffs(values: DataFrame, value: str, parts: int) -> DataFrame:
    """One row, `cutoffs`: distinct values ascending; where the count since the last cut-off reaches total / parts, the value is one.

    Values are counted, and counts are summed up in ranges of the values and over the ranges, so no task holds all of them. Each cut-off
    uses up its share of the total: there are `parts` at most, and each is found from the one before it.
    """
    spark = values.sparkSession
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy("range").agg(F.sum("n").alias("mass"))
    before = ranges.select("range", (F.sum("mass").over(Window.orderBy("range")) - F.col("mass")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    summed = cut(dealt.withColumn("inside", inside).join(before, "range").select(F.col("v").cast("double").alias("v"), (F.col("before") + F.col("inside")).alias("upto")))
    total = summed.agg(F.max("upto").alias("total")).first()["total"]
    cutoffs, at = [], 0
    while total and (found := summed.filter((F.col("upto") - at >= F.lit(total) / parts) & (F.col("upto") > at)).agg(F.min(F.struct("upto", "v")).alias("c")).first()["c"]):
        cutoffs.append(found["v"])
        at = found["upto"]
    return spark.createDataFrame([(cutoffs,)], "cutoffs array<double>")


def equal_mass_labels(values: DataFrame, value: str, parts: int, label: str = "label") -> DataFrame:
    """values with the number of cut-offs below each value. The cut-offs are a scalar subquery, bounded by the number of parts."""
    cut = values.withColumn("__cut", equal_mass_cutoffs(values, value, parts).scalar())
    return cut.withColumn(label, F.size(F.filter("__cut", lambda c: c < F.col(value)))).drop("__cut")
