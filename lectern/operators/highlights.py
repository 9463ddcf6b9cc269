"""Highlight state: frame rejection, change log, nearest colours, runs on a time grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import colour_difference
from ..model import COLOUR_PAIRS, DEFAULT_COLOUR

MAX_COLOURED = 0.6


def usable_frames(words: DataFrame, keys: Sequence[str], frame: str, coloured: Column) -> DataFrame:
    """(keys, frame) of the frames with at most 60 % coloured words; a frame without words has no say and is kept out."""
    return words.groupBy(*keys, frame).agg(F.avg(coloured.cast("double")).alias("share")).filter(F.col("share") <= MAX_COLOURED).select(*keys, frame)


def change_log(words: DataFrame, keys: Sequence[str], gid: str, color: str, order: Sequence[str], default: str = DEFAULT_COLOUR, exclude_failed: bool = True) -> DataFrame:
    """Rows whose colour differs from the last one seen for their id, with `former`. For words of one id each: a lag per id."""
    rows = words.filter(F.col(gid) != -1) if exclude_failed else words
    before = F.lag(color, 1, default).over(Window.partitionBy(*keys, gid).orderBy(*order))
    return rows.withColumn("former", before).filter(F.col("former") != F.col(color))


def grouped_change_log(words: DataFrame, keys: Sequence[str], order: Sequence[str], ids: str = "global_ids", color: str = "highlight", text: str = "text", default: str = DEFAULT_COLOUR, exclude_failed: bool = True) -> DataFrame:
    """The change log for words of several ids: (keys, order, gid, text, id_group, color, former).

    A word fires if its colour differs from the state of every id of its group: one event an id, then all take the colour.
    If some id has the colour already nothing changes, not even the others' state. Sessions are streamed in order; of a session
    only the state of its ids is held.
    """
    needed = [*keys, *order, ids, color, text]
    rows = words.filter(F.col(color).isNotNull() & F.col(ids).isNotNull()).select(*needed)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in (*keys, *order)] + ["gid int", f"text {types[text]}", "id_group array<int>", "color string", "former array<string>"])

    def log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, str] = {}
        session: tuple | None = None
        for batch in batches:
            rows_, gids, groups, before = [], [], [], []
            sessions = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for i, (key, members, now) in enumerate(zip(sessions, batch.column(ids).to_pylist(), batch.column(color).to_pylist(), strict=True)):
                if key != session:
                    session = key
                    state.clear()
                group = [int(g) for g in members if not (exclude_failed and g == -1)]
                former = [state.get(g, default) for g in group]
                if not group or now in former:
                    continue
                for g in group:
                    rows_.append(i)
                    gids.append(g)
                    groups.append(group)
                    before.append(former)
                state.update(dict.fromkeys(group, now))
            at = pa.array(rows_, pa.int64())
            head = [batch.column(c).take(at) for c in (*keys, *order)]
            tail = [pa.array(gids, pa.int32()), batch.column(text).take(at), pa.array(groups, pa.list_(pa.int32())), batch.column(color).take(at), pa.array(before, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*head, *tail], names=[*keys, *order, "gid", "text", "id_group", "color", "former"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(log, schema)


def nearest_pair(rows: DataFrame, background: Sequence[Column], foreground: Sequence[Column], pairs: dict = COLOUR_PAIRS, bold: bool = True, compat_swap: bool = False) -> DataFrame:
    """rows with `highlight`, `swapped`, `distance`: the nearest (background, foreground) pair by weighted difference, either way round if
    `bold`. The first pair wins a tie. Pairs are literals of the expression. compat_swap reports the last pair's `swapped`."""
    options = []
    for i, (name, (bg, fg)) in enumerate(pairs.items()):
        b, f = [F.lit(float(x)) for x in bg], [F.lit(float(x)) for x in fg]
        straight = colour_difference(background, b) + colour_difference(foreground, f)
        turned = colour_difference(background, f) + colour_difference(foreground, b)
        swapped = (turned < straight) if bold else F.lit(False)
        options.append(F.struct(F.when(swapped, turned).otherwise(straight).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name"), swapped.alias("s")))
    best = F.array_min(F.array(*options))
    return rows.select("*", best["name"].alias("highlight"), (options[-1]["s"] if compat_swap else best["s"]).alias("swapped"), best["d"].alias("distance"))


def report_json(events: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """(keys, report): events as JSON, by time."""
    one = F.struct(F.col("gid").alias("id"), "text", "id_group", "color", F.col("former").alias("former colors"))
    per_time = events.groupBy(*keys, time).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return per_time.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(time).cast("string"), "rows"))))).alias("report"))


#: A report as report_json() writes it: entries by time.
REPORT = "map<string,array<struct<id:int,text:string,id_group:array<int>,color:string,`former colors`:array<string>>>>"


def without_failed(entries: Column | str) -> Column:
    """Of an array of a report's entries, those whose id was assigned."""
    return F.filter(F.col(entries) if isinstance(entries, str) else entries, lambda e: e["id"] != -1)


def char_spans(words: DataFrame, keys: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """words with `start`, `end`: columns of a page-wide matrix that each paints: its length plus one, which the next one overpaints."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)).cast("long")
    return words.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def highlight_runs(states: DataFrame, spans: DataFrame, keys: Sequence[str], gid: str, tick: str, color: str) -> DataFrame:
    """(keys, tick, start, end, color): the matrix of time by character as runs of one colour, not as pixels."""
    placed = states.join(spans.select(*keys, gid, "start", "end"), [*keys, gid])
    order = Window.partitionBy(*keys, tick).orderBy("start")
    fresh = F.coalesce((~F.col(color).eqNullSafe(F.lag(color).over(order)) | (F.lag("end").over(order) != F.col("start"))).cast("int"), F.lit(1))
    run = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = placed.withColumn("__new", fresh).withColumn("__run", run)
    return numbered.groupBy(*keys, tick, "__run", color).agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, tick, "start", "end", color)


def word_of_char(positions: DataFrame, spans: DataFrame, keys: Sequence[str], position: str, word: str) -> DataFrame:
    """positions with the word whose span each lies in: a backward as-of match on the span's start."""
    from .temporal import asof

    found = asof(positions, spans.select(*keys, "start", word), keys, position, "start", word)
    return found.drop("start")
