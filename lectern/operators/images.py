"""Pixel operators: numpy on decoded frames, inside Arrow UDFs. Frames travel as bytes with their dimensions, never as pixel rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import COLOUR_PAIRS, GREY_WEIGHTS, PART_RANGES

BORDER, DARK_LIMIT, LEAST_VALUES = 3, 150, 9
CELL_CUTOFF, BOX_SHARE, LEAST_CELLS, LEAST_SIDE = 1, 0.9, 90, 20
FORM_HEADER, WHITE = (237, 230, 246), (255, 255, 255)


def to_array(content: bytes, height: int, width: int, channels: int = 3) -> np.ndarray:
    return np.frombuffer(content, np.uint8).reshape(height, width, channels)


def from_image_source(frames: DataFrame) -> DataFrame:
    """(path, height, width, content) of Spark's image source, with channels turned from BGR to RGB."""

    @F.pandas_udf("binary")
    def turn(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.uint8).reshape(-1, c)[:, 2::-1].tobytes() if c >= 3 else np.repeat(np.frombuffer(d, np.uint8), 3).tobytes() for d, c in zip(data, channels, strict=True)])

    return frames.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), turn("image.data", "image.nChannels").alias("content"))


def crop(image: np.ndarray, part: str | None = None, x: tuple = (None, None), y: tuple = (None, None)) -> np.ndarray:
    if part is not None:
        x, y = PART_RANGES[part]
    return image[slice(*y), slice(*x)]


def cropped(frames: DataFrame, part: str | None = None, x: tuple = (None, None), y: tuple = (None, None)) -> DataFrame:
    """frames (content, height, width) cut to a named part or to ranges of columns and rows; open bounds reach the edge."""

    @F.pandas_udf("struct<content:binary,height:int,width:int>")
    def cut(content: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        images = [crop(to_array(c, hh, ww), part, x, y) for c, hh, ww in zip(content, h, w, strict=True)]
        return pd.DataFrame({"content": [np.ascontiguousarray(i).tobytes() for i in images], "height": [i.shape[0] for i in images], "width": [i.shape[1] for i in images]})

    done = frames.withColumn("__cut", cut("content", "height", "width"))
    return done.withColumns({c: F.col(f"__cut.{c}") for c in ("content", "height", "width")}).drop("__cut")


def upscale(image: np.ndarray, factor: int = 2) -> np.ndarray:
    """Nearest neighbour."""
    return image.repeat(factor, axis=0).repeat(factor, axis=1)


def colour_share(image: np.ndarray, rgb: Sequence[int], epsilon: int = 0) -> float:
    """Share of pixels within `epsilon` of a colour, summed over channels without wrap-around."""
    off = np.abs(image[..., :3].astype(np.int32) - np.array(rgb, np.int32)).sum(axis=-1)
    return float((off <= epsilon).mean()) if off.size else 0.0


def has_colour(image: np.ndarray, rgb: Sequence[int], more_than: int, less_than: int | None = None, epsilon: int = 0) -> bool:
    n = round(colour_share(image, rgb, epsilon) * image.shape[0] * image.shape[1])
    return n > more_than and (less_than is None or n < less_than)


def is_form(image: np.ndarray) -> bool:
    """A purple header, or an all but white left side next to a right side with text."""
    if has_colour(image, FORM_HEADER, 10_000):
        return True
    return colour_share(image[100:600, :600], WHITE) > 0.99 and colour_share(image[100:600, 700:], WHITE) < 0.98


def classify_frame(image: np.ndarray) -> str:
    """Which part of a recording a frame shows, by its white share."""
    if is_form(image):
        return "form"
    white = colour_share(image, WHITE)
    return "paper or splash page" if white > 0.8 else "digital reading" if white > 0.4 else "nothing"


def frames_differ(first: np.ndarray, second: np.ndarray) -> bool:
    """Whether some box, found by halving across alternate sides, differs in more than nine tenths of its cells."""
    if first.shape != second.shape:
        return True
    gap = np.abs(first[..., :3].astype(float).sum(axis=-1) - second[..., :3].astype(float).sum(axis=-1)) / 3
    boxes = [gap > CELL_CUTOFF]
    while boxes:
        box = boxes.pop()
        n = np.count_nonzero(box)
        if box.size and n > BOX_SHARE * box.size:
            return True
        if n < LEAST_CELLS or max(box.shape) < LEAST_SIDE or box.shape[1] < 2:
            continue
        half = box.shape[1] // 2
        boxes += [box[:, half:].T, box[:, :half].T]
    return False


def median_colour(image: np.ndarray, mask: np.ndarray) -> tuple[float, float, float]:
    chosen = image[..., :3][mask]
    return tuple(np.median(chosen, axis=0).tolist()) if len(chosen) else (float("nan"),) * 3


def light_by_threshold(image: np.ndarray, limit: float = DARK_LIMIT) -> np.ndarray:
    return image[..., :3] @ np.array(GREY_WEIGHTS) > limit


def two_means(image: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Mask of one of two colour clusters: started at the darkest and lightest pixel, which makes the split reproducible."""
    pixels = image[..., :3].reshape(-1, 3).astype(float)
    grey = pixels @ np.array(GREY_WEIGHTS)
    centres = pixels[[grey.argmin(), grey.argmax()]]
    label = np.zeros(len(pixels), bool)
    for _ in range(rounds):
        new = ((pixels - centres[1]) ** 2).sum(axis=1) < ((pixels - centres[0]) ** 2).sum(axis=1)
        if (new == label).all() and _:
            break
        label = new
        for k in (0, 1):
            if (label == k).any():
                centres[k] = pixels[label == k].mean(axis=0)
    return label.reshape(image.shape[:2])


def split_colours(image: np.ndarray, method=two_means) -> tuple[tuple, tuple, float]:
    """(background, foreground, background share): medians of the larger and the smaller side."""
    mask = method(image)
    share = float(mask.mean())
    if share <= 0.5:
        mask, share = ~mask, 1 - share
    return median_colour(image, mask), median_colour(image, ~mask), share


def nearest_pair(background: Sequence[float], foreground: Sequence[float], pairs: dict = COLOUR_PAIRS, bold: bool = True) -> tuple[str, bool]:
    w = np.array(GREY_WEIGHTS)
    gap = lambda a, b: float(np.abs(np.array(a, float) - np.array(b, float)) @ w)
    best = None
    for name, (bg, fg) in pairs.items():
        straight, turned = gap(background, bg) + gap(foreground, fg), gap(background, fg) + gap(foreground, bg)
        d, swapped = (turned, True) if bold and turned < straight else (straight, False)
        if best is None or d < best[0]:
            best = (d, name, swapped)
    return best[1], best[2]


def word_highlight(image: np.ndarray, left: float, top: float, right: float, bottom: float, border: bool = True) -> dict | None:
    """Colours and label of a word's box; None outside the image or if there is next to nothing in it."""
    l, t, r, b = (int(v) for v in (left, top, right, bottom))
    height, width = image.shape[:2]
    if max(l, r) >= width or max(t, b) >= height:
        return None
    extra = BORDER if border else 0
    part = image[max(0, t - extra) : min(height, b + extra), max(0, l - extra) : min(width, r + extra)]
    if part.size < LEAST_VALUES:
        return None
    bg, fg, share = split_colours(part)
    if np.isnan([*bg, *fg]).any():
        fg = tuple(b if np.isnan(f) else f for f, b in zip(fg, bg, strict=True))
    label, swapped = nearest_pair(bg, fg)
    return {"background": list(fg if swapped else bg), "foreground": list(bg if swapped else fg), "share": round(share, 2), "highlight": label}


def differing_frames(pairs: DataFrame, height: str = "height", width: str = "width") -> DataFrame:
    """pairs (content, previous, height, width) with `differs`; a first frame differs."""

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([True if y is None else frames_differ(to_array(x, hh, ww), to_array(y, hh, ww)) for x, y, hh, ww in zip(a, b, h, w, strict=True)])

    return pairs.withColumn("differs", test("content", "previous", height, width))


def highlight_words(frames: DataFrame) -> DataFrame:
    """frames (content, height, width, boxes: array of boxes) with `found`: per box its colours and label. A frame is decoded once."""
    kind = "array<struct<background:array<double>,foreground:array<double>,share:double,highlight:string>>"

    @F.pandas_udf(kind)
    def label(content: pd.Series, h: pd.Series, w: pd.Series, boxes: pd.Series) -> pd.Series:
        out = []
        for c, hh, ww, bs in zip(content, h, w, boxes, strict=True):
            image = to_array(c, hh, ww)
            out.append([word_highlight(image, b["left"], b["top"], b["right"], b["bottom"]) for b in bs])
        return pd.Series(out)

    return frames.withColumn("found", label("content", "height", "width", "boxes"))
