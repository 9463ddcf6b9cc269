"""Line tracks without a known text: which lines of a recording's frames are one and the same line.

Lines of neighbouring frames are linked one to one, first equal ones, then those that are nearest to each other; what is still
unlinked looks past the next frame. A line has one link ahead and one behind at most, so a track is a chain, and its
first sighting is its name. A link depends on the frames of one recording only: its sightings are exchanged once, as a row, and nothing
is written on the way. The pairs of many recordings are aligned together.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import UNIT, alignment_costs
from ..functions.scalar import ascii_text
from .match import spread

#: Frames that a line may be away and come back, and edits a character of the longer line that still make it the same.
REACH, MAX_TRACK_DISTANCE = 2, 0.4
#: Characters of the recordings, or one recording, that are linked together.
SLICE = 4 << 20


class Recording:
    """The sightings of one recording, in order: their texts, the links found so far, and the frames' sightings that have text."""

    def __init__(self, times: list, lines: list, texts: list[str]):
        n = len(texts)
        self.texts, self.before, self.ahead = texts, [-1] * n, [-1] * n
        # of several rows of one place the last counts
        self.counts = [i + 1 == n or times[i] != times[i + 1] or lines[i] != lines[i + 1] for i in range(n)]
        self.frames: list[list[int]] = []
        for i in range(n):
            if not i or times[i] != times[i - 1]:
                self.frames.append([])
            # what has no time or no line has no neighbours
            if texts[i] and self.counts[i] and times[i] is not None and lines[i] is not None:
                self.frames[-1].append(i)

    def link(self, i: int, j: int) -> None:
        self.ahead[i], self.before[j] = j, i

    def _once(self, sightings: list[int]) -> dict[str, int]:
        """Words that stand once in these lines; the line of others is less than none."""
        at: dict[str, int] = {}
        for i in sightings:
            for word in self.texts[i].split(" "):
                at[word] = -1 if word in at else i
        at.pop("", None)
        return at

    def link_equal(self, hop: int) -> list[tuple[int, int]]:
        """Links the n-th of equal texts to the n-th in the frame `hop` on. Of what is left, the pairs that share a word of which both frames have
        one: no more pairs than words."""
        pairs = []
        for frame, other in zip(self.frames, self.frames[hop:], strict=False):
            left = [i for i in frame if self.ahead[i] < 0]
            right = [j for j in other if self.before[j] < 0]
            same = defaultdict(list)
            for j in reversed(right):
                same[self.texts[j]].append(j)
            for i in left:
                if found := same.get(self.texts[i]):
                    self.link(i, found.pop())
            a, b = (self._once([i for i in side if links[i] < 0]) for side, links in ((left, self.ahead), (right, self.before)))
            pairs += {(i, b[w]) for w, i in a.items() if i >= 0 and b.get(w, -1) >= 0}
        return pairs

    def link_nearest(self, distances: dict[tuple[int, int], float]) -> None:
        """Links those that are each other's nearest; the first on a tie."""
        ahead, behind = {}, {}
        for (i, j), d in distances.items():
            ahead[i] = min(ahead.get(i, (d, j)), (d, j))
            behind[j] = min(behind.get(j, (d, i)), (d, i))
        for i, (_, j) in ahead.items():
            if behind[j][1] == i:
                self.link(i, j)

    def roots(self) -> list[int]:
        """Where the chain of every sighting starts, less than none for a row that does not count; a link never leads ahead."""
        found: list[int] = []
        for i, b in enumerate(self.before):
            found.append(-1 if not self.counts[i] else i if b < 0 else found[b])
        return found


def link_recordings(recordings: Sequence[Recording], reach: int, limit: float) -> None:
    for hop in range(1, reach + 1):
        near: list[dict[tuple[int, int], float]] = []
        open_pairs = []
        for r in recordings:
            pairs = [(i, j, longer) for i, j in r.link_equal(hop) if abs(len(r.texts[i]) - len(r.texts[j])) <= limit * (longer := max(len(r.texts[i]), len(r.texts[j])))]
            firsts, seconds = defaultdict(int), defaultdict(int)
            for i, j, _ in pairs:
                firsts[i] += 1
                seconds[j] += 1
            near.append({})
            for i, j, longer in pairs:
                a, b = r.texts[i], r.texts[j]
                # a pair without rivals needs no more than a bound from above: the characters that differ where they stand
                if firsts[i] == seconds[j] == 1 and len(a) == longer == len(b) and (differ := sum(map(ne, a, b))) / longer <= limit:
                    near[-1][i, j] = differ / longer
                else:
                    open_pairs.append((near[-1], i, j, a, b, longer))
        if open_pairs:
            costs = alignment_costs([p[3] for p in open_pairs], [p[4] for p in open_pairs], UNIT)
            for (found, i, j, _, _, longer), cost in zip(open_pairs, costs.tolist(), strict=True):
                if (d := cost // UNIT / longer) <= limit:
                    found[i, j] = d
        for r, found in zip(recordings, near, strict=True):
            r.link_nearest(found)


def _slices(recordings: Iterator[Recording]) -> Iterator[list[Recording]]:
    held, size = [], 0
    for r in recordings:
        held.append(r)
        size += sum(map(len, r.texts))
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _linked(lines: DataFrame, keys: Sequence[str], time: str, line: str, text: str, reach: int, limit: float) -> DataFrame:
    """(keys, all, links): a recording's sightings in order, and of each the place in that order of the one before and of the track's first."""
    sighting = F.struct(F.col(time).alias("time"), F.col(line).alias("line"), F.trim(F.coalesce(ascii_text(text), F.lit(""))).alias("text"))
    grouped = spread(lines.select(*keys, sighting.alias("x")), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("all"))

    @F.arrow_udf("array<struct<before:int,root:int>>")
    def solve(whole: pa.Array, times: pa.Array, line_of: pa.Array, texts: pa.Array) -> pa.Array:
        # without its keys a recording is none, and its lines have no links
        rows = (Recording(t.as_py(), n.as_py(), x.as_py() if w.as_py() else [""] * len(x)) for w, t, n, x in zip(whole, times, line_of, texts, strict=True))
        before, root, sizes = array("i"), array("i"), [0]
        for recordings in _slices(rows):
            link_recordings(recordings, reach, limit)
            for r in recordings:
                before.extend(r.before)
                root.extend(r.roots())
                sizes.append(len(before))
        before, root = np.asarray(before), np.asarray(root)
        links = pa.StructArray.from_arrays([pa.array(before, pa.int32()), pa.array(root, pa.int32(), mask=root < 0)], ["before", "root"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), links)

    has_keys = F.lit(True)
    for k in keys:
        has_keys = has_keys & F.col(k).isNotNull()
    return grouped.select(*keys, "all", solve(has_keys, F.col("all.time"), F.col("all.line"), F.col("all.text")).alias("links"))


def line_links(lines: DataFrame, keys: Sequence[str], time: str, line: str = "line_idx", text: str = "text", reach: int = REACH, limit: float = MAX_TRACK_DISTANCE) -> DataFrame:
    """(keys, time, line, to_time, to_line): the sighting that follows each, in the next frame or, if neither has a link, up to `reach` frames on.

    Texts are compared without what is beyond ASCII; null and blank lines have no links. A frame's lines are what a screen shows.
    """
    each = _linked(lines, keys, time, line, text, reach, limit).select(*keys, "all", F.posexplode("links").alias("at", "link")).filter("link.before >= 0")
    return each.select(*keys, F.expr("all[link.before].time").alias("time"), F.expr("all[link.before].line").alias("line"), F.expr("all[at].time").alias("to_time"), F.expr("all[at].line").alias("to_line"))


def line_tracks(lines: DataFrame, keys: Sequence[str], time: str, line: str = "line_idx", text: str = "text", reach: int = REACH, limit: float = MAX_TRACK_DISTANCE) -> DataFrame:
    """(keys, time, line, track_time, track_line) for every line: its track's first sighting, which is itself where nothing comes before.

    Ids are of places in the recording, so they do not depend on how rows are dealt. Repeated rows of one place count once.
    """
    linked = _linked(lines, keys, time, line, text, reach, limit)
    places = F.expr("transform(links, (x, i) -> struct(all[i].time AS time, all[i].line AS line, x.root AS root, all[x.root].time AS track_time, all[x.root].line AS track_line))")
    found = linked.select(*keys, F.explode(places).alias("x")).filter("x.root IS NOT NULL")
    return found.select(*keys, F.col("x.time").alias(time), F.col("x.line").alias(line), F.col("x.track_time").alias("track_time"), F.col("x.track_line").alias("track_line"))
