"""Approximate substring alignment: one string is consumed, the other's edges are cheap to leave out.

Costs are integers in hundredths, so equal distances are equal. Short strings are aligned cell by cell; batches of lines are aligned
together, one character of every line a step, with skips within the targets as a running minimum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

UNIT = 100
#: Pairs that are aligned together, and their characters.
BATCH, BATCH_SIZE = 2048, 1 << 20
#: Pairs from which on a running minimum is faster row by row.
MOST_ACCUMULATED = 256


def alignment_cost(consumed: str, target: str, edge: int, middle: int = UNIT, diagonal: int = UNIT, vertical: int = UNIT) -> int:
    """Least cost in hundredths. `diagonal` is paid where characters differ, `vertical` for a consumed character without a
    counterpart, `middle` for one of the target's in between, `edge` for one at its ends. Equal characters are free."""
    n = len(target)
    row = [j * edge for j in range(n + 1)]
    for c in consumed:
        before = row[0]
        left = row[0] = before + diagonal
        for j, d in enumerate(target, 1):
            above = row[j]
            cost = before if c == d else min(before + diagonal, above + vertical)
            left += middle
            if cost < left:
                left = cost
            before, row[j] = above, left
    return min(x + (n - j) * edge for j, x in enumerate(row))


def alignment_costs(consumed: Sequence[str], targets: Sequence[str], edge: int, middle: int = UNIT, diagonal: int = UNIT, vertical: int = UNIT) -> np.ndarray:
    """alignment_cost of many pairs.

    A row is held less what leaving out its targets in the middle, and deleting what is consumed, would cost: then skips are a running minimum
    as they are, and a row's numbers depend on the targets' length alone, which is short as a rule, so that two bytes hold them.
    """
    if diagonal != vertical:  # then an equal character may not be the cheapest step
        return np.array([alignment_cost(c, t, edge, middle, diagonal, vertical) for c, t in zip(consumed, targets, strict=True)], np.int64)
    out = np.zeros(len(consumed), np.int64)
    sizes, depths = np.array([len(t) for t in targets]), np.array([len(c) for c in consumed])
    # pairs of about as many steps stand together, else a long text's steps are made for itself alone
    classes = np.array([d.bit_length() for d in depths.tolist()])
    by_size = np.lexsort((sizes, classes))
    b = 0
    while b < len(by_size):
        a = b
        most = max(1, min(BATCH, BATCH_SIZE >> int(classes[by_size[a]])))
        b = min(a + most, int(np.searchsorted(classes[by_size], classes[by_size[a]], "right")))
        part = by_size[a:b]
        part = part[np.argsort(-depths[part], kind="stable")]
        n, m = sizes[part], depths[part]
        width, depth = int(n.max()), int(m.max())
        t = np.zeros((width, len(part)), np.uint32)
        c = np.zeros((depth, len(part)), np.uint32)
        for k, i in enumerate(part.tolist()):
            t[: n[k], k] = np.frombuffer(targets[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            c[: m[k], k] = np.frombuffer(consumed[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        if max(t.max(initial=0), c.max(initial=0)) < 1 << 16:
            t, c = t.astype(np.uint16), c.astype(np.uint16)
        most = max(middle + vertical, abs(edge - middle)) * (width + 1)
        kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        ramp = np.arange(width + 1, dtype=np.int64)[:, None]
        row = np.repeat((ramp * (edge - middle)).astype(kind), len(part), axis=1)
        lives = np.searchsorted(-m, -np.arange(depth)).tolist()  # pairs are in order of length: those with a character left lead
        live, equal, unequal = 0, kind(middle + vertical), kind(diagonal)
        for i in range(depth):
            if lives[i] != live:
                live = lives[i]
                r, to = row[:, :live], t[:, :live]
                same, less = np.empty((width, live), bool), np.empty((width, live), kind)
            np.equal(to, c[i, :live], out=same)
            # from the place before: the step costs nothing or `diagonal`, less a skip and a deletion
            np.multiply(same, unequal, out=less)
            less += equal - unequal
            np.subtract(r[:-1], less, out=less)
            np.minimum(r[1:], less, out=r[1:])
            if live < MOST_ACCUMULATED:
                np.minimum.accumulate(r, axis=0, out=r)
            else:
                for j in range(width):
                    np.minimum(r[j + 1], r[j], out=r[j + 1])
        costs = row.astype(np.int64) + ramp * middle + m * vertical
        left = n[None, :] - ramp
        out[part] = np.where(left >= 0, costs + left * edge, np.iinfo(np.int64).max).min(axis=0)
    return out


def _ascii(text: str | None) -> str:
    text = text or ""
    return text if text.isascii() else "".join(ch for ch in text if ord(ch) < 128)


def line_distance(ocr_line: str | None, ref_line: str | None, edge: int = 1) -> float:
    """Per character of the OCR line; 1 if that is blank. Case counts."""
    ocr_line = _ascii(ocr_line)
    if not ocr_line.strip():
        return 1.0
    return alignment_cost(ocr_line, ref_line or "", edge) / UNIT / len(ocr_line)


def word_distance(ocr_word: str | None, correct: str | None, edge: int = 80) -> float:
    """The correct text is consumed, the OCR word may stick out; case does not count; blank text costs the word's edges."""
    ocr_word = _ascii(ocr_word)
    if not (correct or "").strip():
        return len(ocr_word) * edge / UNIT
    return alignment_cost(correct.lower(), ocr_word.lower(), edge) / UNIT


@F.pandas_udf(DoubleType())
def line_distance_udf(ocr_line: pd.Series, ref_line: pd.Series) -> pd.Series:
    lines = [_ascii(x) for x in ocr_line]
    filled = [i for i, x in enumerate(lines) if x.strip()]
    out = np.ones(len(lines))
    if filled:
        refs = ref_line.tolist()
        out[filled] = alignment_costs([lines[i] for i in filled], [refs[i] or "" for i in filled], 1) / UNIT / np.array([len(lines[i]) for i in filled])
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def word_distance_udf(ocr_word: pd.Series, correct: pd.Series) -> pd.Series:
    return pd.Series([word_distance(a, b) for a, b in zip(ocr_word, correct, strict=True)], dtype=float)
