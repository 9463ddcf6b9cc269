"""Stitching frames into one page, and where each frame lies on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent_lines(lines: DataFrame, ref_lines: DataFrame, session: Sequence[str], frame: Sequence[str], doc: str = "doc_name") -> DataFrame:
    """Matched lines that stand below their predecessor in the text, with that one's box as `prev`.

    lines: (session, frame, doc, line_idx, updated_line, bbox). The first matched line of a frame counts if it is the text's first; a
    repeated line of the text stands for its first occurrence.
    """
    first = ref_lines.groupBy(doc, "line").agg(F.min("line_idx").alias("ref_idx"), F.count("*").alias("__n"))
    total = ref_lines.groupBy(doc).agg(F.max("line_idx").alias("last_idx"))
    matched = lines.filter(F.col("updated_line") != "").join(first, (lines[doc] == first[doc]) & (lines["updated_line"] == first["line"])).drop(first[doc]).drop("__n")
    order = Window.partitionBy(*session, *frame).orderBy("line_idx")
    chained = matched.withColumn("prev", F.lag("bbox").over(order)).withColumn("prev_line", F.lag("updated_line").over(order))
    before = ref_lines.select(F.col(doc).alias("__doc"), (F.col("line_idx")).alias("__idx"), F.col("line").alias("__before"))
    # the predecessor of line 0 is the last one: what wraps around is only matched by a page that starts again
    wanted = F.when(F.col("ref_idx") > 0, F.col("ref_idx") - 1).otherwise(F.col("last_idx"))
    placed = chained.join(total, doc).withColumn("__want", wanted)
    joined = placed.join(before, (placed[doc] == before["__doc"]) & (placed["__want"] == before["__idx"]))
    good = F.when(F.col("prev_line").isNull(), F.col("ref_idx") == 0).otherwise(F.col("prev_line") == F.col("__before"))
    return joined.filter(good).drop("__doc", "__idx", "__before", "__want", "last_idx", "prev_line")


def stitched_lines(adjacent: DataFrame, ref_lines: DataFrame, session: Sequence[str], doc: str = "doc_name", normalise: bool = False) -> DataFrame:
    """(session, doc, line_idx, line, top, bottom): one page of a session's frames.

    Line 0 has its mean top and bottom. Every other line keeps its mean distance to the predecessor's top, scaled by the height
    of that line in the frame over its height on the page (the inverse with `normalise`): the means are plain aggregates. A
    line's height is then a product (or alternating quotient) of what its predecessors give, and its top a sum, so the
    recurrence is a running product and a running sum over the lines. From a line that no frame shows next to
    its predecessor on, positions are null; so are those after a line of no height, unless `normalise`, where what follows has none either.
    """
    p_height = F.col("prev.bottom") - F.col("prev.top")
    p_height = 1 / p_height if normalise else p_height
    means = adjacent.groupBy(*session, doc, "ref_idx").agg(
        F.avg(F.when(F.col("prev").isNull(), F.col("bbox.top"))).alias("t0"),
        F.avg(F.when(F.col("prev").isNull(), F.col("bbox.bottom"))).alias("b0"),
        F.avg((F.col("bbox.top") - F.col("prev.top")) * p_height).alias("a"),
        F.avg((F.col("bbox.bottom") - F.col("prev.top")) * p_height).alias("b"),
    )
    pages = adjacent.select(*session, doc).distinct()
    rows = pages.join(ref_lines, doc).join(means.withColumnRenamed("ref_idx", "line_idx"), [*session, doc, "line_idx"], "left")
    page = [*session, doc]
    order = Window.partitionBy(*page).orderBy("line_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(order) == 1
    own = rows.select(*page, "line_idx", "line", "t0", first.alias("first"), F.when(first, F.col("b0") - F.col("t0")).otherwise(F.col("b") - F.col("a")).alias("d"), F.when(~first, F.col("a")).alias("a"), F.row_number().over(order).alias("k"))
    odd = F.col("k") % 2 == 1
    factor = F.col("d") if normalise else F.when(odd, F.col("d")).otherwise(F.try_divide(F.lit(1.0), F.col("d")))
    products = own.select(
        *page, "line_idx", "line", "t0", "first", "d", "a", "k", F.product(factor).over(upto).alias("p"),
        F.sum(F.col("d").isNull().cast("int")).over(upto).alias("lost"), F.sum((F.col("d") == 0).cast("int")).over(upto).alias("zeros"),
    )
    size = F.col("p") if normalise else F.when(odd, F.col("p")).otherwise(F.try_divide(F.lit(1.0), F.col("p")))
    flat = F.lit(0.0) if normalise else F.when((F.col("d") == 0) & (F.col("zeros") == 1), 0.0)
    heights = products.withColumn("h", F.when(F.col("lost") > 0, None).when(F.col("zeros") > 0, flat).otherwise(size))
    before = F.lag("h").over(order)
    moved = heights.withColumn("move", F.when(F.col("first"), F.col("t0")).otherwise(F.col("a") * (before if normalise else F.try_divide(F.lit(1.0), before))))
    gone = F.sum(F.col("move").isNull().cast("int")).over(upto) > 0
    placed = moved.withColumn("top", F.when(~gone, F.sum("move").over(upto)))
    return placed.select(*page, "line_idx", "line", "top", (F.col("top") + F.col("h")).alias("bottom"))


def inner_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched lines without the first and last of each frame."""
    rows = lines.filter(F.col("updated_line") != "")
    up, down = Window.partitionBy(*keys).orderBy("line_idx"), Window.partitionBy(*keys).orderBy(F.col("line_idx").desc())
    return rows.withColumn("__a", F.row_number().over(up)).withColumn("__b", F.row_number().over(down)).filter("__a > 1 AND __b > 1").drop("__a", "__b")


def frame_maps(lines: DataFrame, page: DataFrame, keys: Sequence[str], page_keys: Sequence[str], include_edges: bool = False) -> DataFrame:
    """(keys, multiplier, adder): medians, each on its own, of the affine maps of all pairs of a frame's lines.

    A pair maps the upper line's top and the lower one's bottom to their places on the page; a repeated line stands for its last
    occurrence there. Frames with less than two lines have no map. Pairs stay within a frame, whose lines a screen bounds.
    """
    last = page.groupBy(*page_keys, F.col("line").alias("updated_line")).agg(F.max(F.struct("line_idx", "top", "bottom")).alias("p"))
    kept = lines.filter(F.col("updated_line") != "") if include_edges else inner_lines(lines, keys)
    placed = kept.join(last, [*page_keys, "updated_line"])
    line = F.struct("line_idx", F.col("bbox.top").alias("ft"), F.col("bbox.bottom").alias("fb"), F.col("p.top").alias("top"), F.col("p.bottom").alias("bottom"))
    per_frame = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def maps(x: Column, i: Column) -> Column:
        lower = F.filter(F.slice("lines", i + 2, F.size("lines")), lambda y: y["line_idx"] > x["line_idx"])
        return F.transform(lower, lambda y: F.struct(F.try_divide(y["bottom"] - x["top"], y["fb"] - x["ft"]).alias("m"), x["top"].alias("top"), x["ft"].alias("ft")))

    pairs = per_frame.select(*keys, F.explode(F.flatten(F.transform("lines", maps))).alias("p"))
    rows = pairs.select(*keys, F.col("p.m").alias("m"), (F.col("p.top") - F.col("p.ft") * F.col("p.m")).alias("a"))
    return rows.groupBy(*keys).agg(F.median("m").alias("multiplier"), F.median("a").alias("adder")).filter("multiplier IS NOT NULL")


def scroll_positions(maps: DataFrame, frame_height: float) -> DataFrame:
    """maps with `top` and `bottom`: the frame's edges on the page."""
    return maps.withColumn("top", F.lit(0.0) * F.col("multiplier") + F.col("adder")).withColumn("bottom", F.lit(float(frame_height)) * F.col("multiplier") + F.col("adder"))


def page_extent(page: DataFrame, keys: Sequence[str]) -> DataFrame:
    return page.groupBy(*keys).agg(F.max("bottom").alias("extent"))
