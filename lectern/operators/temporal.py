"""Ordered operators: intervals, changes, carried values, grids. `keys` partition, `time` orders, `tie` breaks equal times."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.scratch import cut


def _w(keys: Sequence[str], *order: str | Column) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def part_intervals(frames: DataFrame, keys: Sequence[str], time: str, label: str, tie: Sequence[str] = (), duration: DataFrame | None = None) -> DataFrame:
    """(keys, part, start_time, end_time): runs of frames with one label.

    A run ends at its last frame, the last run of a session at the duration (keys, duration) if that is given.
    """
    order = _w(keys, time, *tie)
    fresh = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(order))).cast("int"), F.lit(1))
    first = F.row_number().over(order) == 1
    runs = frames.select(*keys, F.col(time).alias("__t"), F.col(label).alias("part"), F.when(first, 1).otherwise(fresh).alias("__new"), *tie, F.col(time))
    numbered = runs.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "__run").agg(F.first("part").alias("part"), F.min("__t").alias("start_time"), F.max("__t").alias("end_time"))
    if duration is not None:
        last = F.row_number().over(_w(keys, F.col("__run").desc())) == 1
        out = out.join(duration, list(keys)).withColumn("__last", last)
        out = out.withColumn("end_time", F.when(F.col("__last"), F.col("duration")).otherwise(F.col("end_time")))
    return out.select(*keys, "part", "start_time", "end_time")


def changes(frames: DataFrame, keys: Sequence[str], time: str, value: str, tie: Sequence[str] = (), differ: Column | None = None) -> DataFrame:
    """The first frame and every frame that differs from the one before, with `previous`."""
    order = _w(keys, time, *tie)
    marked = frames.withColumn("previous", F.lag(value).over(order)).withColumn("__n", F.row_number().over(order))
    test = differ if differ is not None else ~F.col(value).eqNullSafe(F.col("previous"))
    return marked.filter((F.col("__n") == 1) | test).drop("__n")


def with_transitions(intervals: DataFrame, transitions: DataFrame, keys: Sequence[str], time: str, bucket: float = 60.0) -> DataFrame:
    """intervals with `transitions`: the sorted times of changes within each, ends included.

    The range join is an equi-join: an interval is spread over the buckets of time that it touches, and meets the times in them.
    """
    at = lambda c: F.floor(F.col(c) / bucket)
    spread = intervals.select(*intervals.columns, F.explode(F.sequence(at("start_time"), at("end_time"))).alias("__b"))
    times = transitions.select(*keys, F.col(time).alias("__t"), at(time).alias("__b"))
    inside = spread.join(times, [*keys, "__b"]).filter(F.col("__t").between(F.col("start_time"), F.col("end_time")))
    found = inside.groupBy(*intervals.columns).agg(F.array_sort(F.collect_list("__t")).alias("transitions"))
    a, b = intervals.alias("a"), found.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in intervals.columns]
    none = F.array().cast(found.schema["transitions"].dataType)
    return a.join(b, same, "left").select("a.*", F.coalesce("b.transitions", none).alias("transitions"))


def in_span(frames: DataFrame, time: str, start: float, end: float) -> DataFrame:
    return frames.filter(F.col(time).between(start, end)).orderBy(time)


def part_transitions(intervals: DataFrame, part: str, keys: Sequence[str]) -> DataFrame:
    """(keys, t) of every transition of the intervals of a part."""
    return intervals.filter(F.col("part") == part).select(*keys, F.explode("transitions").alias("t"))


def longest_interval(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The interval whose transitions span most, the first on a tie; one transition spans nothing."""
    span = F.array_max("transitions") - F.array_min("transitions")
    order = _w(keys, F.col("span").desc(), "start_time")
    return intervals.withColumn("span", span).filter("span IS NOT NULL").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def reading_spans(sessions: DataFrame, intervals: DataFrame, part: str, keys: Sequence[str]) -> DataFrame:
    """(keys, start_time, end_time): first start and last end of a part; nulls for sessions without it."""
    found = intervals.filter(F.col("part") == part).groupBy(*keys).agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    return sessions.select(*keys).distinct().join(found, list(keys), "left")


def last_transition(intervals: DataFrame, part: str, keys: Sequence[str]) -> DataFrame:
    return part_transitions(intervals, part, keys).groupBy(*keys).agg(F.max("t").alias("t"))


def sample_grid(sessions: DataFrame, keys: Sequence[str], duration: str, step: int = 10) -> DataFrame:
    """(keys, t): 0, step, 2 step, ... below the duration, and the duration itself."""
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col(duration) / step)), lambda k: (k * step).cast("double"))
    times = F.array_distinct(F.array_append(F.filter(whole, lambda t: t < F.col(duration)), F.col(duration).cast("double")))
    return sessions.select(*keys, F.explode(times).alias("t"))


def frame_counts(words: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """(keys, time, value, count)."""
    return words.groupBy(*keys, time, value).agg(F.count("*").alias("count"))


def frame_deltas(words: DataFrame, keys: Sequence[str], time: str, value: str, ignore: str) -> DataFrame:
    """(keys, time, delta): per frame the sum over values but `ignore` of the change of count from the frame before; the first has 0.

    Counts are a map per frame, so one pass over frames in order compares neighbours whatever the number of values.
    """
    counts = frame_counts(words, keys, time, value)
    entry = F.when(~F.col(value).eqNullSafe(F.lit(ignore)), F.struct(value, "count"))
    frames = counts.groupBy(*keys, time).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    before = F.lag("m").over(_w(keys, time))
    empty = F.create_map().cast(frames.schema["m"].dataType)
    joined = F.map_zip_with("m", F.coalesce("before", empty), lambda _, a, b: F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))))
    total = F.aggregate(F.map_values(joined), F.lit(0).cast("long"), lambda x, y: x + y)
    return frames.withColumn("before", before).select(*keys, time, F.when(F.col("before").isNull(), F.lit(0)).otherwise(total).cast("long").alias("delta"))


def ranked_deltas(deltas: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Frames with a change, the greatest and then latest first, with `rank`."""
    return deltas.filter("delta > 0").withColumn("rank", F.row_number().over(_w(keys, F.col("delta").desc(), F.col(time).desc())))


def carried_grid(events: DataFrame, keys: Sequence[str], tick: str, value: str, bounds: DataFrame, default: str, tie: Sequence[str] = ()) -> DataFrame:
    """(keys, tick, value) on every tick of bounds (keys, lo, hi): the last value recorded at or before it, from `lo` on; else the default."""
    grid = bounds.select(*keys, F.explode(F.sequence("lo", "hi")).alias(tick))
    latest = F.max(F.struct(*tie, F.col(value).alias("__v"))) if tie else F.max(F.struct(F.col(value).alias("__v")))
    recorded = events.groupBy(*keys, tick).agg(latest.alias("__e")).select(*keys, tick, F.col("__e.__v").alias("__v"))
    carried = F.last("__v", ignorenulls=True).over(_w(keys, tick).rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(recorded, [*keys, tick], "left").select(*keys, tick, F.coalesce(carried, F.lit(default)).alias(value))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """left with `value` and `right_time` of the latest right row at or before each left row; nulls if there is none.

    One shuffle and sort: both sides in one ordered stream, the last right row carried forward.
    """
    payload = F.struct(F.col(right_time).alias("t"), F.col(value).alias("v"))
    orders = [F.col(c).alias(f"__o{i}") for i, c in enumerate(tie)]
    none = [F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(tie)]
    rows = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *none, rows.alias("__row"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *orders, payload.alias("__p"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = _w(keys, "__t", "__side", *[f"__o{i}" for i in range(len(tie))]).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__p", F.last("__p", ignorenulls=True).over(order)).filter("__side = 1")
    return carried.select("__row.*", F.col("__p.t").alias(right_time), F.col("__p.v").alias(value))


def step_series(rows: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], before: float = 0.05) -> DataFrame:
    """rows with, just before each but the first, a point that still has the previous values."""
    order = _w(keys, time)
    held = rows.select(*keys, (F.col(time) - before).alias(time), *[F.lag(v).over(order).alias(v) for v in values], F.row_number().over(order).alias("__n"))
    return rows.select(*keys, time, *values).unionByName(held.filter("__n > 1").drop("__n"))


def clip(rows: DataFrame, keys: Sequence[str], time: str, start: float, end: float) -> DataFrame:
    """Rows strictly inside a span, and at its edges the last row at or before its start and the first at or after its end."""
    t = F.col(time)
    first = rows.filter(t <= start).groupBy(*keys).agg(F.max(F.struct(time, *[c for c in rows.columns if c not in (*keys, time)])).alias("r"))
    last = rows.filter(t >= end).groupBy(*keys).agg(F.min(F.struct(time, *[c for c in rows.columns if c not in (*keys, time)])).alias("r"))
    at = lambda df, when: df.select(*keys, "r.*").withColumn(time, F.lit(float(when))).select(*rows.columns)
    return rows.filter((t > start) & (t < end)).unionByName(at(first, start)).unionByName(at(last, end))


def frontier_changes(spans: DataFrame, keys: Sequence[str], probe: Callable[[DataFrame], DataFrame], start: str = "lo", end: str = "hi", tick: str = "tick") -> DataFrame:
    """(keys, tick) in (start, end] where the value changes, by halving spans whose ends differ, of all sessions at once.

    spans: one row a session, ends in ticks (integers; a span without an end or of no length has no changes). `probe` takes (keys, tick) and
    adds `value`, for values that cost much to look at: every tick is asked once. A round asks the middles of the spans that are still open, so there are as
    many rounds as the longest span has halvings, whatever the number of sessions. Like bisect_changes it does not see a change and
    its reversal between two looks. Null is a value.
    """
    lo, hi, differ = F.col("lo"), F.col("hi"), ~F.col("a").eqNullSafe(F.col("b"))
    whole = spans.select(*keys, F.col(start).cast("long").alias("lo"), F.col(end).cast("long").alias("hi")).filter(lo < hi)
    ends = cut(probe(whole.select(*keys, F.explode(F.array("lo", "hi")).alias(tick))).select(*keys, tick, "value"))
    at = lambda side, name: ends.select(*keys, F.col(tick).alias(side), F.col("value").alias(name))
    opened = cut(whole.join(at("lo", "a"), [*keys, "lo"]).join(at("hi", "b"), [*keys, "hi"]).filter(differ).select(*keys, "lo", "hi", "a", "b"))
    found = opened.filter(hi - lo <= 1).select(*keys, hi.alias(tick))
    while not opened.filter(hi - lo > 1).isEmpty():
        wide = opened.filter(hi - lo > 1).withColumn(tick, F.floor((lo + hi) / 2).cast("long"))
        seen = probe(wide.select(*keys, tick)).select(*keys, tick, F.col("value").alias("m"))
        half = lambda x, y, v, w: F.struct(F.col(x).alias("lo"), F.col(y).alias("hi"), F.col(v).alias("a"), F.col(w).alias("b"))
        halves = wide.join(seen, [*keys, tick]).select(*keys, F.explode(F.array(half("lo", tick, "a", "m"), half(tick, "hi", "m", "b"))).alias("__span"))
        opened = cut(halves.select(*keys, "__span.*").filter(differ))
        found = found.unionByName(opened.filter(hi - lo <= 1).select(*keys, hi.alias(tick)))
    return found


def bisect_changes(value_at, start: float, end: float, resolution: float = 0.1) -> list[float]:
    """Times in (start, end] where value_at changes, found by halving spans whose ends differ.

    For values that cost much to look at; a change and its reversal between two looks are not seen. `value_at` is asked once a tick.
    """
    seen: dict[int, object] = {}
    scale = round(1 / resolution)

    def look(k: int) -> object:
        if k not in seen:
            seen[k] = value_at(k / scale)
        return seen[k]

    spans, found = [(round(start * scale), round(end * scale))], []
    while spans:
        a, b = spans.pop()
        if look(a) == look(b):
            continue
        if b - a <= 1:
            found.append(b / scale)
        else:
            spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return sorted(found)
