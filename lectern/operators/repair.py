"""Repairing the words of matched lines: character widths, pairing of words with boxes, hill climbing.

The width calibration is a fold over a document's perfect words, so it runs per document; everything after it needs one line
and the document's scalars, so it runs per line. Both are grouped maps over Arrow.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import UNIT, _ascii, word_distance
from .geometry import near_median, space_width
from .match import perfect_words, spread

SHIFTS, SWEEPS = (0, -6, -4, -2, 2, 4, 6), 20
#: What is priced ahead for many lines at once: up to so many words, with so many characters, on a box's text of so many; pairs of a box and a first word
#: in one go. All else is priced when it is asked for.
RUN, RUN_LENGTH, BOX_LENGTH, LANES = 3, 32, 24, 1 << 15


def calibrate(words: Sequence[tuple[str, float]], default: float) -> dict[str, float]:
    """Character widths: all start at `default`; each perfect word (text, width) in turn rescales its characters, once per
    occurrence, by its width over what was expected."""
    widths: dict[str, float] = {}
    for text, actual in words:
        expected = sum(widths.get(c, default) for c in text)
        if expected <= 0:
            continue
        ratio = actual / expected
        for c in text:
            widths[c] = widths.get(c, default) * ratio
    return widths


def char_widths(perfect: DataFrame, spaces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, med_height, space_width, widths): calibrated per document, over its perfect words in document order."""
    one = F.struct("line_idx", "word_idx", "text", (F.col("bbox.right") - F.col("bbox.left")).alias("w"))
    measured = perfect.filter(F.col("bbox.right").isNotNull() & F.col("bbox.left").isNotNull())
    gathered = spaces.join(measured.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all")), list(keys), "left")

    @F.pandas_udf("map<string,double>")
    def fold(rows: pd.Series, default: pd.Series) -> pd.Series:
        return pd.Series([calibrate([(r["text"], r["w"]) for r in (x if x is not None else ())], d) for x, d in zip(rows, default, strict=True)])

    return gathered.select(*keys, "med_height", "space_width", fold("all", "space_width").alias("widths"))


_EDGE = 80  # word_distance's, in hundredths


@lru_cache(maxsize=1 << 16)
def _cost(ocr: str, correct: str) -> int:
    return round(word_distance(ocr, correct) * 100)


def run_costs(lines: Sequence[tuple[Sequence[str], Sequence[str]]]) -> list[list[list[int | None]]]:
    """For each line (texts of its boxes, correct words) and k up to RUN: the costs of k words from the a-th on box b, at a * boxes + b; None where
    nothing is priced ahead. All lines are aligned together, a character a step, and a run of words goes on from where the one before it ended."""
    boxes, starts, box_of, start_of, shapes = [], [], [], [], []
    for texts, words in lines:
        box_of.append(np.tile(np.arange(len(texts)) + len(boxes), len(words)))
        start_of.append(np.repeat(np.arange(len(words)) + len(starts), len(texts)))
        boxes += [_ascii(t).lower() for t in texts]
        lower = [w.lower() for w in words]
        starts += [lower[a : a + RUN] for a in range(len(words))]
        shapes.append(len(words) * len(texts))
    box_of, start_of = np.concatenate(box_of), np.concatenate(start_of)
    sizes = np.array([len(b) for b in boxes])
    width = min(int(sizes.max(initial=0)), BOX_LENGTH)
    target = np.zeros((width, len(boxes)), np.uint8)  # ASCII
    for i, b in enumerate(boxes):
        if b and len(b) <= BOX_LENGTH:
            target[: len(b), i] = np.frombuffer(b.encode("ascii"), np.uint8)
    # ends[k][i]: characters of the first k + 1 words from a start on, with the spaces between; 0 if they are blank, too long or not there
    ends = np.zeros((RUN, len(starts)), np.int64)
    consumed = np.zeros((RUN_LENGTH, len(starts)), np.uint8)
    for i, run in enumerate(starts):
        text = " ".join(run)[:RUN_LENGTH]
        if text:
            # what is beyond ASCII equals nothing in a box
            consumed[: len(text), i] = np.frombuffer(text.encode("ascii") if text.isascii() else bytes(min(ord(ch), 255) for ch in text), np.uint8)
        at = -1
        for k, word in enumerate(run):
            at += 1 + len(word)
            if at > RUN_LENGTH:
                break
            if text[:at].strip():
                ends[k, i] = at
    out = np.full((RUN, len(box_of)), -1, np.int64)
    t, n = target[:, box_of], sizes[box_of]
    short = n <= BOX_LENGTH
    # rows are held less the costs of skipping and deleting, as in align.alignment_costs
    ramp = np.arange(width + 1, dtype=np.int64)[:, None]
    row = np.repeat((ramp * (_EDGE - UNIT)).astype(np.int16), len(box_of), axis=1)
    outside = np.where(ramp <= n, ramp * (UNIT - _EDGE), 1 << 14).astype(np.int16)
    same, less = np.empty(t.shape, bool), np.empty(t.shape, np.int16)
    for step in range(int(ends.max(initial=0))):
        np.equal(t, consumed[step][start_of], out=same)
        np.multiply(same, np.int16(UNIT), out=less)
        less += np.int16(UNIT)
        np.subtract(row[:-1], less, out=less)
        np.minimum(row[1:], less, out=row[1:])
        for j in range(width):  # a running minimum over long rows
            np.minimum(row[j + 1], row[j], out=row[j + 1])
        for k in range(RUN):
            done = ends[k] == step + 1
            if done.any():
                lanes = np.flatnonzero(done[start_of] & short)
                out[k, lanes] = (row[:, lanes] + outside[:, lanes]).min(axis=0) + (step + 1) * UNIT + n[lanes] * _EDGE
    places = np.cumsum([0, *shapes]).tolist()
    known = [[x if x >= 0 else None for x in costs] for costs in out.tolist()]
    return [[costs[a:b] for costs in known] for a, b in zip(places, places[1:], strict=False)]


def priced(lines: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Iterator[list[list[int | None]] | None]:
    """run_costs of every line, for as many lines at once as LANES; None for a line that has more itself."""
    held, lanes = [], 0
    for line in [*lines, None]:
        size = len(line[0]) * len(line[1]) if line else 0
        if line is None or lanes + size > LANES:
            if held:
                found = iter(run_costs([h for h in held if h is not None]) if any(held) else ())
                yield from (None if h is None else next(found) for h in held)
            held, lanes = [], 0
        if line is not None:
            fits = 0 < size <= LANES
            held.append(line if fits else None)
            lanes += size if fits else 0


class Held:
    """The words of every box, and the boxes that have any, in order: few, however many boxes a line has."""

    def __init__(self, words: list[tuple[int, ...]]):
        self.words = words
        self.filled = [i for i, w in enumerate(words) if w]

    def put(self, box: int, words: tuple[int, ...]) -> None:
        at = bisect_left(self.filled, box)
        there = at < len(self.filled) and self.filled[at] == box
        if words and not there:
            self.filled.insert(at, box)
        elif there and not words:
            del self.filled[at]
        self.words[box] = words

    def below(self, box: int) -> int | None:
        at = bisect_left(self.filled, box)
        return self.filled[at - 1] if at else None

    def above(self, box: int) -> int | None:
        at = bisect_right(self.filled, box)
        return self.filled[at] if at < len(self.filled) else None

    def ends(self) -> tuple[int | None, int | None]:
        """The least and greatest word in any box."""
        words = [w for box in self.filled for w in self.words[box]]
        return min(words, default=None), max(words, default=None)


class LineRepair:
    """One line: OCR boxes with their texts, and the correct words to spread over them."""

    def __init__(self, texts: Sequence[str], lefts: Sequence[float], rights: Sequence[float], correct: str, known: list[list[int | None]] | None = None):
        self.known = known  # run_costs of this line
        self.texts, self.lefts, self.rights = list(texts), list(lefts), list(rights)
        self.correct = correct.split(" ") if correct else []
        self.n = len(self.texts)
        self._costs: dict[tuple[int, tuple[int, ...]], int] = {}
        # steps are functions of the few boxes that they look at: most are met again, in later sweeps and from other starts
        self._splits: dict[tuple, tuple[int, int]] = {}
        self._gains: dict[int, list[int | None]] = {}
        self._blank: list[int] | None = None
        # where a climb from this state ends, and after how many sweeps
        self._rests: dict[tuple, tuple[list[tuple[int, ...]], int]] = {}

    def cost(self, box: int, chosen: tuple[int, ...]) -> int:
        """Hundredths of the distance between a box's text and the words with these numbers."""
        key = (box, chosen)
        found = self._costs.get(key)
        if found is None:
            size = len(chosen)
            # words that follow each other may be priced already
            if self.known and 0 < size <= RUN and chosen[-1] - chosen[0] == size - 1:
                found = self.known[size - 1][chosen[0] * self.n + box]
            if found is None:
                found = _cost(self.texts[box], " ".join([self.correct[i] for i in chosen]))
            self._costs[key] = found
        return found

    def total(self, pairing: list[tuple[int, ...]]) -> int:
        return sum(self.cost(i, pairing[i]) for i in range(self.n))

    def estimated_spans(self, widths: dict[str, float], space: float, left: float, scale: float) -> list[tuple[int, int]]:
        """Where each correct word should stand, cut to whole pixels."""
        sizes = np.array([sum(widths.get(c, space) for c in w) for w in self.correct], float)
        starts = np.concatenate([[0.0], np.cumsum(sizes + space)[:-1]]) if len(sizes) else sizes
        return [(int(s * scale + left), int((s + z) * scale + left)) for s, z in zip(starts, sizes, strict=True)]

    def first_pairing(self, spans: Sequence[tuple[int, int]]) -> list[tuple[int, ...]]:
        """Words to boxes from left to right; a word that overruns its box goes to the next if it overlaps that more."""
        pairing: list[list[int]] = [[] for _ in range(self.n)]
        box = 0
        for word, (a, b) in enumerate(spans):
            while box < self.n and a >= self.rights[box]:
                box += 1
            if box == self.n:
                break
            if box + 1 < self.n and b > self.rights[box] and b - self.lefts[box + 1] > self.rights[box] - a:
                box += 1
            pairing[box].append(word)
        return [tuple(words) for words in pairing]

    def shifted(self, pairing: list[tuple[int, ...]], by: int) -> list[tuple[int, ...]]:
        return [pairing[i - by] if 0 <= i - by < self.n else () for i in range(self.n)]

    def _gain(self, word: int) -> list[int | None]:
        """What every box, empty, would gain by this word; None where it has not been asked for and is not priced."""
        found = self._gains.get(word)
        if found is None:
            if self.known:
                if self._blank is None:
                    self._blank = [self.cost(box, ()) for box in range(self.n)]
                priced_ahead = self.known[0][word * self.n : (word + 1) * self.n]
                found = [None if x is None else y - x for x, y in zip(priced_ahead, self._blank, strict=True)]
            else:
                found = [None] * self.n
            self._gains[word] = found
        return found

    def _gain_at(self, word: int, box: int) -> int:
        gain = self._gains[word][box] = self.cost(box, ()) - self.cost(box, (word,))
        return gain

    def _offer(self, held: Held, donor: int | None, from_lower: bool) -> tuple[int | None, int]:
        """The word that the nearest filled box, or off screen if there is none, would give to an empty one, and what giving it gains."""
        if donor is None:
            first, last = held.ends()
            if from_lower:
                word = len(self.correct) - 1 if first is None else first - 1
            else:
                word = 0 if last is None else last + 1
            return (word if 0 <= word < len(self.correct) else None), 0
        given = held.words[donor]
        # the donor is scored without its first word whichever side gives, as results depend on it
        return given[-1] if from_lower else given[0], self.cost(donor, given) - self.cost(donor, given[1:])

    def _pull(self, held: Held, box: int) -> int | None:
        """Pull the nearest word into this empty box or the first one below it that gains; the box, or None if there is none down to the next filled one.

        All of these have the same words on offer, so a box costs two look-ups."""
        lower, upper = held.below(box), held.above(box)
        (up_word, up_less), (low_word, low_less) = self._offer(held, upper, False), self._offer(held, lower, True)
        up = self._gain(up_word) if up_word is not None else None
        low = self._gain(low_word) if low_word is not None else None
        for b in range(box, -1 if lower is None else lower, -1):
            up_gain = low_gain = 0
            if up is not None:
                gain = up[b]
                up_gain = (self._gain_at(up_word, b) if gain is None else gain) + up_less
            if low is not None:
                gain = low[b]
                low_gain = (self._gain_at(low_word, b) if gain is None else gain) + low_less
            if up_gain <= 0 and low_gain <= 0:
                continue
            word, donor = (low_word, lower) if low_gain > 0 and low_gain > up_gain else (up_word, upper)
            held.put(b, (word,))
            if donor is not None:
                held.put(donor, held.words[donor][1:] if donor > b else held.words[donor][:-1])
            return b
        return None

    def _best_split(self, held: Held, box: int) -> tuple[int, int]:
        """The first cheapest way to leave words [:a] to the box before and [b:] to the one after."""
        own = held.words[box]
        before, after = held.words[box - 1] if box else None, held.words[box + 1] if box + 1 < self.n else None
        key = (box, before, own, after)
        if key in self._splits:
            return self._splits[key]
        size = len(own)
        # what goes to either side is priced once a place, not once a pair of places
        lower = [0 if before is None else self.cost(box - 1, before + own[:a]) for a in range(size + 1)]
        upper = [0 if after is None else self.cost(box + 1, own[b:] + after) for b in range(size + 1)]
        best, price = (0, size), lower[0] + self.cost(box, own) + upper[size]
        for a in range(size + 1):
            for b in range(a, size + 1):
                other = lower[a] + upper[b]
                if other < price and (other := other + self.cost(box, own[a:b])) < price:
                    best, price = (a, b), other
        self._splits[key] = best
        return best

    def climb(self, pairing: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        """Sweeps from right to left until nothing gets better, twenty at most. Words pushed past an end are off screen."""
        if not self.correct:
            return pairing
        held, path, rest = Held(pairing), [], None
        for sweep in range(SWEEPS):
            state = tuple([(i, held.words[i]) for i in held.filled])
            known = self._rests.get(state)
            # another start has been here, and comes to rest within the sweeps that are left
            if known is not None and sweep + known[1] <= SWEEPS:
                rest, more = known
                break
            path.append(state)
            moved = False
            box = self.n
            while box > 0:
                box -= 1
                own = held.words[box]
                if not own:
                    at = self._pull(held, box)
                    moved |= at is not None
                    # on from the box that was filled, or from the next filled one
                    if at is None and (at := held.below(box)) is not None:
                        at += 1
                    box = at or 0
                    continue
                a, b = self._best_split(held, box)
                if (a, b) == (0, len(own)):
                    continue
                if box:
                    held.put(box - 1, held.words[box - 1] + own[:a])
                if box + 1 < self.n:
                    held.put(box + 1, own[b:] + held.words[box + 1])
                held.put(box, own[a:b])
                moved = True
            if not moved:
                rest, more = held.words, 0
                break
        if rest is None:
            return held.words
        for i, state in enumerate(reversed(path), 1):
            self._rests[state] = rest, more + i
        return rest

    def solve(self, spans: Sequence[tuple[int, int]]) -> tuple[list[tuple[int, ...]], int]:
        """The best pairing over all starts, and the start's shift; the first of equal ones."""
        if not self.correct:  # every start costs the same
            return [() for _ in range(self.n)], 0
        start = self.first_pairing(spans)
        best, found, offset = None, start, 0
        for by in SHIFTS:
            pairing = self.climb(self.shifted(start, by))
            price = self.total(pairing)
            if best is None or price < best:
                best, found, offset = price, pairing, by
            if not best:
                break
        return found, offset

    def repaired(self, pairing: list[tuple[int, ...]]) -> list[str]:
        return [" ".join(self.correct[i] for i in chosen) for chosen in pairing]


def _places(values: Sequence) -> list[float]:
    """Numbers of an array column, where a null has become one that is none."""
    out = [float(v) for v in values]
    if any(v != v for v in out):
        raise ValueError("a box lacks a side")
    return out


def repair_words(words: DataFrame, lines: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_idx, word_idx, ocr_text, text, pair_offset, error, bbox): every word of the matched documents with its repaired text.

    words (keys, line_idx, word_idx, text, bbox), lines (keys, line_idx, bbox), matched (keys, line_idx, updated_line). Words of a line
    that matched nothing become empty, and stay in the JVM. Where a line's boxes can't be worked with, its words have no text and `error` says why.
    """
    spaces = space_width(lines, words, keys)
    usual = lines.join(spaces, list(keys)).withColumn("usual", near_median("bbox", "med_height"))
    perfect = perfect_words(words.join(usual.filter("usual").select(*keys, "line_idx"), [*keys, "line_idx"], "left_semi"), matched, keys)
    widths = char_widths(perfect, spaces, keys)
    found = matched.filter(F.col("updated_line") != "")
    boxes = F.array_sort(F.collect_list(F.struct("word_idx", "text", "bbox")))
    per_line = words.join(found.select(*keys, "line_idx"), [*keys, "line_idx"], "left_semi").groupBy(*keys, "line_idx").agg(boxes.alias("boxes"))
    frame = usual.select(*keys, "line_idx", F.col("bbox.left").alias("line_left"), (F.col("bbox.bottom") - F.col("bbox.top")).alias("line_height"), "usual")
    rows = per_line.join(found.select(*keys, "line_idx", "updated_line"), [*keys, "line_idx"]).join(frame, [*keys, "line_idx"]).join(widths, list(keys))

    @F.pandas_udf("struct<texts:array<string>,pair_offset:int,error:string>")
    def repair(texts: pd.Series, lefts: pd.Series, rights: pd.Series, line: pd.Series, left: pd.Series, height: pd.Series, usual: pd.Series, med: pd.Series, space: pd.Series, widths: pd.Series) -> pd.DataFrame:
        out = []
        known = priced([([r or "" for r in t], text.split(" ") if text else []) for t, text in zip(texts, line, strict=True)])
        for t, a, b, text, x, h, u, m, s, w, costs in zip(texts, lefts, rights, line, left, height, usual, med, space, widths, known, strict=True):
            try:
                job = LineRepair([r or "" for r in t], _places(a), _places(b), text, costs)
                pairing, offset = job.solve(job.estimated_spans(dict(w) if w is not None else {}, s, x, 1.0 if u or not m else h / m))
                out.append((job.repaired(pairing), offset, None))
            except (ArithmeticError, LookupError, TypeError, ValueError) as error:  # boxes without sides, or not numbers
                out.append(([None] * len(t), None, repr(error)))
        return pd.DataFrame({"texts": [o[0] for o in out], "pair_offset": pd.array([o[1] for o in out], "Int32"), "error": [o[2] for o in out]})

    of = lambda field: F.transform("boxes", field)
    sides = (of(lambda r: r["text"]), of(lambda r: r["bbox"]["left"]), of(lambda r: r["bbox"]["right"]))
    fixed = spread(rows, *keys, "line_idx").withColumn("fix", repair(*sides, "updated_line", "line_left", "line_height", "usual", "med_height", "space_width", "widths"))
    words_of = fixed.select(*keys, "line_idx", "fix.pair_offset", "fix.error", F.explode(F.arrays_zip(F.col("boxes").alias("b"), F.col("fix.texts").alias("t"))).alias("x"))
    repaired = words_of.select(*keys, "line_idx", F.col("x.b.word_idx").alias("word_idx"), F.col("x.b.text").alias("ocr_text"), F.col("x.t").alias("text"), "pair_offset", "error", F.col("x.b.bbox").alias("bbox"))
    lost = matched.filter(F.coalesce("updated_line", F.lit("")) == "").select(*keys, "line_idx")
    blank = words.join(lost, [*keys, "line_idx"]).select(*keys, "line_idx", "word_idx", F.col("text").alias("ocr_text"), F.lit("").alias("text"), F.lit(0).alias("pair_offset"), F.lit(None).cast("string").alias("error"), "bbox")
    return repaired.unionByName(blank)


def document_status(repaired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status) of every document of repair_words(): repaired, or the first error of its lines."""
    return repaired.groupBy(*keys).agg(F.coalesce(F.concat(F.lit("failed: "), F.min("error")), F.lit("repaired")).alias("status"))
