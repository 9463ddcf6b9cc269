"""The change log over streams, in order of arrival or of the frames' own time, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import DEFAULT_COLOUR


def stream_change_log(words: DataFrame, session: str, time: str, ids: str, color: str, default: str = DEFAULT_COLOUR) -> DataFrame:
    """(session, time, gid, color, former) of words (session, time, ids array<int>, color): state is the colour of every id of a session.

    A word fires if its colour differs from the state of each of its ids. Rows are taken in time order within a micro-batch;
    sources deliver a session's frames in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    out = f"{session} {kinds[session]}, {time} {kinds[time]}, gid int, color string, former string"

    def log(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        events = []
        for t, group, c in zip(rows[time], rows[ids], rows[color], strict=True):
            former = [held.get(int(g), default) for g in group]
            if len(former) and c not in former:
                events += [(key[0], t, int(g), c, f) for g, f in zip(group, former, strict=True)]
                held.update({int(g): c for g in group})
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(events, columns=[session, time, "gid", "color", "former"])

    return words.groupBy(session).applyInPandasWithState(log, out, "ids array<int>, colors array<string>", "append", "NoTimeout")


class OrderedLog(StatefulProcessor):
    """Of one session: the colour of every id, an entry each, and the frames that the watermark has not passed yet.

    A frame waits until the watermark has passed its time, so that frames are taken in their own order, however they arrive. Only the ids
    of a frame are read and written. A session that has been silent for longer than `keep_ms` is forgotten.
    """

    def __init__(self, columns: tuple[str, ...], default: str, keep_ms: int):
        self.columns, self.default, self.keep_ms = columns, default, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.colours = handle.getMapState("colours", "gid int", "color string")
        self.waiting = handle.getMapState("waiting", "at long", "words array<struct<ids:array<int>,color:string,tie:long>>")
        self.latest = handle.getValueState("latest", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        _, time, ids, color, tie = self.columns
        arrived: dict[int, list] = {}
        for batch in rows:
            for t, group, c, k in zip(batch[time], batch[ids], batch[color], batch[tie], strict=True):
                if group is not None and len(group) and c is not None:
                    arrived.setdefault(pd.Timestamp(t).value // 1000, []).append(([int(g) for g in group], c, int(k)))
        last = self.latest.get()[0] if self.latest.exists() else None
        for at, words in arrived.items():
            before = [tuple(w) for w in self.waiting.getValue((at,))[0]] if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), ([*before, *words],))
            self.handle.registerTimer(at // 1000 + 1)
            last = at if last is None else max(last, at)
        if arrived:
            self.latest.update((last,))
            self.handle.registerTimer(last // 1000 + 1 + self.keep_ms)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        ready = sorted(k[0] for k in self.waiting.keys() if k[0] < passed)
        events = []
        for at in ready:
            for group, c, _ in sorted((tuple(w) for w in self.waiting.getValue((at,))[0]), key=lambda w: w[2]):
                former = [self.colours.getValue((int(g),))[0] if self.colours.containsKey((int(g),)) else self.default for g in group]
                if c in former:
                    continue
                events += [(at, int(g), c, f) for g, f in zip(group, former, strict=True)]
                for g in group:
                    self.colours.updateValue((int(g),), (c,))
            self.waiting.removeKey((at,))
        if self.latest.exists() and passed > self.latest.get()[0] + self.keep_ms * 1000 and not any(True for _ in self.waiting.keys()):
            self.colours.clear()
            self.latest.clear()
        yield self._rows(key, events)

    def _rows(self, key: tuple, events: list[tuple]) -> pd.DataFrame:
        session, time = self.columns[:2]
        at, gid, color, former = zip(*events, strict=True) if events else ((), (), (), ())
        text = lambda values: pd.Series(list(values), dtype=object)
        return pd.DataFrame({session: text([key[0]] * len(events)), time: pd.to_datetime(pd.Series(at, dtype="int64"), unit="us"), "gid": pd.Series(gid, dtype="int32"), "color": text(color), "former": text(former)})

    def close(self) -> None:
        pass


def ordered_change_log(words: DataFrame, session: str, time: str, ids: str, color: str, tie: str, late: str, default: str = DEFAULT_COLOUR, keep: str = "1 day") -> DataFrame:
    """(session, time, gid, color, former), as the batch log has it, of words (session, time timestamp, ids array<int>, color, tie) that arrive in any
    order, up to `late` apart; what comes later is dropped. `tie` orders the words of a frame. A session that is silent for longer than
    `keep` starts anew. The session needs the RocksDB state store; rows come out once the watermark has passed their frame.
    """
    kind = words.schema[session].dataType.simpleString()
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = words.select(session, time, ids, color, F.col(tie).cast("long").alias(tie)).withWatermark(time, late)
    out = f"{session} {kind}, {time} timestamp, gid int, color string, former string"
    return rows.groupBy(session).transformWithStateInPandas(OrderedLog((session, time, ids, color, tie), default, keep_ms), out, "Append", "EventTime")


def stream_counts(events: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """(start, end, value, count) per tumbling window; rows later than the watermark are dropped by it."""
    windowed = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), value).agg(F.count("*").alias("count"))
    return windowed.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), value, "count")
