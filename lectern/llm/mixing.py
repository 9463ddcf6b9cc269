"""Mixing sources to target weights by weighted sampling with exponential keys, in DataFrame operations only.

Sources in code point order, null last, get weights 5, 2, 1, repeating. They share 150 % of all words by weight; a target stops
at twice the source's words and what is over is shared by the others, which is the water level where the capped shares add up.
A source is taken in complete epochs first. The rest of its target is filled in the order of keys -ln(u) / quality (the
order of Efraimidis and Spirakis), with u drawn from the document's id (its text's hash where there is none): documents count whole until the prefix sum of
their words reaches the budget, and the one that crosses it counts in part.

Prefix sums do not sort a source in one task. Keys are dealt into ranges, the ranges' sums give the offset of each
range, and only the one range of a source that the budget ends in is sorted. Ranges are parts of an octave: whatever the
qualities are, logarithms of such keys spread, so that a range has less than a thousandth of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, external_id, internal_id, materialise, quoted

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 17
#: Ranges of each octave of the keys.
RANGES = 512
#: A weight is held between these; null, not a number, zero and less count as the least.
LEAST_QUALITY, GREATEST_QUALITY = 1e-9, 1e9

_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def default_quality(size: Column, text: Column) -> Column:
    """Between 1/2 and 2: documents of ordinary length count more than fragments; an average word of 3 to 9 characters doubles it."""
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    return (0.5 + 0.5 * F.least(size / 50.0, F.lit(1.0))) * F.when(mean.between(4, 10), 2.0).otherwise(1.0)


def exponential_key(row_id: Column, quality: Column, seed: int = SEED) -> Column:
    """-ln(u) / quality, which is above zero and finite for any quality."""
    u = (F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    given = quality.cast("double")
    weight = F.when(given.isNull() | F.isnan(given), LEAST_QUALITY).otherwise(F.least(F.greatest(given, F.lit(LEAST_QUALITY)), F.lit(GREATEST_QUALITY)))
    return F.greatest(-F.log(u), F.lit(2.0**-60)) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of a table (source, size): one row per source, few enough for one ordering."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double")
    cap = CAP * F.col("source_size")
    weighted = per_source.select("*", weight.alias("w"), cap.alias("cap")).withColumn("level", F.col("cap") / F.col("w"))
    # with sources by the level at which they fill up, the water level is where the capped and the open shares meet
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = weighted.select(
        "*",
        (SHARE * F.sum("source_size").over(everything)).alias("budget"),
        (F.sum("cap").over(filling) - F.col("cap")).alias("full"),
        (F.sum("w").over(everything) - F.sum("w").over(filling) + F.col("w")).alias("open"),
    ).withColumn("water", (F.col("budget") - F.col("full")) / F.col("open"))
    # the first source whose own level is not below the water that is left for it fixes the water level
    water = F.min(F.when(F.col("level") >= F.col("water"), F.struct("level", "water"))).over(everything)["water"]
    return stepped.select("source", "source_size", F.when(F.col("source_size") > 0, F.least("cap", F.col("w") * water)).otherwise(0.0).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, whole_rows: bool = False) -> DataFrame:
    """One row per input row: did, tag (hash of the text), source, size, source_size, target, epochs, taken; with whole_rows also the
    input row itself as the struct `row`.

    A null or empty text has size zero and is never taken; a null source is a source of its own, the last; a null id ranks last. Ties of the
    key are broken by id, then by the text's hash. Repeated rows share their key and stand next to each other; each is a row
    of its own with words of its own. A very long text counts like any other; at a budget's edge its first words are taken. An
    empty table gives no rows. Names of other columns don't matter. `quality` is over the columns did, tag, source and size; a
    null, zero or negative one, or one that is no number, is the least weight, an infinite one the greatest. The default is a rule
    of thumb from lengths: a real score should be handed in where there is one.
    """
    text = F.col(quoted(text_col)).cast("string")
    sized = docs.select(
        internal_id(quoted(id_col)).alias("did"), F.xxhash64(text).alias("tag"), F.col(quoted(source_col)).cast("string").alias("source"), n_words(text).alias("size"), text.alias("__text"),
        *([F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")] if whole_rows else []),
    )
    weight = quality if quality is not None else default_quality(F.col("size"), F.col("__text"))
    also = ["row"] if whole_rows else []
    keyed = sized.select("did", "tag", "source", "size", exponential_key(F.when(F.col("did") == F.lit(NULL_ID), F.col("tag")).otherwise(F.col("did")), weight).alias("key"), *also)
    rows = materialise(keyed.withColumn("range", F.floor(RANGES * F.log2("key")).cast("int")), "keys")
    targets = source_targets(rows)

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    t = targets.withColumnRenamed("source", "t_source").withColumn("epochs", F.floor(F.try_divide("target", F.col("source_size").cast("double")) + 1e-12))
    t = t.withColumn("epochs", F.coalesce("epochs", F.lit(0))).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("end", F.sum("words").over(upto)).join(t, same("source", "t_source"))
    crossing = ends.filter(F.col("end") > F.col("rest")).groupBy("t_source").agg(F.min(F.struct("range", (F.col("end") - F.col("words")).alias("before"))).alias("x"))
    plan = t.join(crossing.withColumnRenamed("t_source", "x_source"), same("t_source", "x_source"), "left").select(
        "t_source", "source_size", "target", "epochs", "rest", F.coalesce("x.range", F.lit((1 << 31) - 1)).alias("stop"), F.coalesce("x.before", F.lit(0)).alias("before")
    )
    plan = materialise(plan, "plan", rows)
    dealt = rows.join(plan, same("source", "t_source"))
    out = ["did", "tag", "source", "size", "source_size", "target", "epochs", *also]
    whole = dealt.filter(F.col("range") != F.col("stop")).select(*out, F.when(F.col("range") < F.col("stop"), F.col("size")).otherwise(0).alias("part"))
    order = Window.partitionBy("source").orderBy("key", "did", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.col("before") + F.sum("size").over(order) - F.col("size")
    edge = dealt.filter(F.col("range") == F.col("stop")).select(*out, F.least("size", F.greatest(F.col("rest") - reach, F.lit(0))).alias("part"))
    return whole.unionByName(edge).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long")).drop("part")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row per whole copy, and one with the first words where a document is taken in part.

    The words that come out are those that mix() takes, row by row: rows travel with their place in the mix, so repeated
    rows, null ids and ties need no join. A document without words is not taken. Columns stay as they were, whatever their
    names; all but the text of a part are copied. An empty table gives no rows.
    """
    taken = mix(docs, id_col, text_col, source_col, whole_rows=True).filter("taken > 0").select("row", "size", "taken")
    spread = taken.select("row", "size", "taken", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("copy"))
    text = F.col("row").getField(text_col).cast("string")
    left = F.col("taken") - F.col("copy") * F.col("size")
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    return spread.select(*[(F.when(left < F.col("size"), first_words).otherwise(text) if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    return mix(docs).select(external_id("did").alias("doc_id"), "size", "source_size", "target", "taken")
