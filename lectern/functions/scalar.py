"""Column functions: text, time, geometry, colour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import GREY_WEIGHTS, VIDEO_ENDINGS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# text


def clean_text(text: Column | str) -> Column:
    """Em dashes become hyphens, null becomes empty."""
    return F.translate(F.coalesce(_c(text), F.lit("")), "—", "-")


def ascii_text(text: Column | str) -> Column:
    """Without characters beyond ASCII: the form that distances and evidence are computed on."""
    text = _c(text)
    # as many bytes as characters: nothing to look for. Bytes that are no text count as characters
    plain = (F.octet_length(text) == F.length(text)) & F.is_valid_utf8(text)
    return F.when(plain, text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def tokens(line: Column | str) -> Column:
    """Split at every single space; empty tokens stay."""
    return F.split(_c(line), " ", -1)


def lines(text: Column | str) -> Column:
    return F.split(_c(text), "\n", -1)


def letters_for_digits(number: Column | str) -> Column:
    """0..9 as a..j."""
    return F.translate(_c(number).cast("string"), "0123456789", "abcdefghij")


# time


def tick(seconds: Column | str) -> Column:
    """Tenths of a second, rounded."""
    return F.round(_c(seconds) * 10).cast("int")


def tick_of_bound(seconds: Column | str) -> Column:
    """Compatibility: seconds divided by 0.1 and cut, which takes 0.3 s to tick 2."""
    return F.floor(_c(seconds) / F.lit(0.1)).cast("int")


def tick_of_event(seconds: Column | str) -> Column:
    """Compatibility: seconds times ten and cut, which takes 0.3 s to tick 3."""
    return F.floor(_c(seconds) * 10).cast("int")


def time_to_filename(seconds: Column | str, extension: str = "jpg") -> Column:
    """MM-S.s.ext: whole minutes and seconds to two decimals, each padded below ten. Computed on hundredths."""
    hundredths = F.round(_c(seconds) * 100).cast("long")
    minutes = F.floor(_c(seconds) / 60).cast("long")
    rest = hundredths - minutes * 6000
    whole, part = F.floor(rest / 100).cast("long"), F.pmod(rest, F.lit(100))
    decimals = F.when(part % 10 == 0, F.floor(part / 10).cast("long").cast("string")).otherwise(F.lpad(part.cast("string"), 2, "0"))
    pad = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return F.concat(pad(minutes), F.lit("-"), pad(whole), F.lit("."), decimals, F.lit(f".{extension}"))


def filename_to_time(path: Column | str) -> Column:
    """Seconds of MM-SS[.frac].ext, whatever folder it is in; null if the name is none."""
    name = F.substring_index(_c(path), "/", -1)
    pattern = r"^(\d+)-(\d+)(?:\.(\d+))?\.[^.]*$"
    group = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    fraction = F.coalesce(F.concat(F.lit("0."), group(3)).cast("double"), F.lit(0.0))
    return group(1).cast("double") * 60 + group(2).cast("double") + fraction


def tick_label(ticks: Column | str) -> Column:
    """MM:SS of a number of ticks, both cut."""
    seconds = F.floor(_c(ticks) / 10).cast("long")
    pad = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return F.concat(pad(F.floor(seconds / 60).cast("long")), F.lit(":"), pad(F.pmod(seconds, F.lit(60))))


def session_name(relative_path: Column | str) -> Column:
    """The path of a recording without its ending, / as _; an unknown ending is an error."""
    endings = "|".join(e.replace(".", r"\.") for e in [*VIDEO_ENDINGS, *(e.upper() for e in VIDEO_ENDINGS)])
    path = _c(relative_path)
    known = F.regexp_like(path, F.lit(f"({endings})$"))
    name = F.translate(F.regexp_replace(path, f"({endings})$", ""), "/", "_")
    return F.when(known, name).otherwise(F.raise_error(F.concat(F.lit("not a recording: "), path)))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp's own fields, whatever the session's time zone."""
    t = _c(ts)
    days = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.extract(F.lit("SECOND"), t)
    return days * 86_400_000_000 + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long")


# geometry


def bbox(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    cast = lambda x, name: _c(x).cast("double").alias(name)
    return F.struct(cast(left, "left"), cast(top, "top"), cast(right, "right"), cast(bottom, "bottom"))


def width(box: Column | str) -> Column:
    return _c(box)["right"] - _c(box)["left"]


def height(box: Column | str) -> Column:
    return _c(box)["bottom"] - _c(box)["top"]


def scale_bbox(box: Column | str, multiple: float = 0.5, shift: float = 0.0) -> Column:
    """All four sides times `multiple` plus `shift`."""
    b = _c(box)
    return F.struct(*[(b[side] * multiple + shift).alias(side) for side in ("left", "top", "right", "bottom")])


def point_box_distance(box: Column | str, x: Column | float, y: Column | float) -> Column:
    """Distance of a point to the nearest edge lines of a box, not zero inside it."""
    b = _c(box)
    dx = F.least(F.abs(b["left"] - x), F.abs(b["right"] - x))
    dy = F.least(F.abs(b["top"] - y), F.abs(b["bottom"] - y))
    return F.sqrt(dx * dx + dy * dy)


def outside_image(box: Column | str, image_width: float, image_height: float) -> Column:
    b = _c(box)
    return (b["left"] >= image_width) | (b["right"] >= image_width) | (b["top"] >= image_height) | (b["bottom"] >= image_height)


def affine(x: Column | str, multiplier: Column, adder: Column) -> Column:
    return _c(x) * multiplier + adder


def affine_2d(x: Column, y: Column, from_a: tuple, from_b: tuple, to_a: tuple, to_b: tuple) -> tuple[Column, Column]:
    """The map of an axis-aligned box (corners a, b) to another, applied to a point; null where a side has no length."""
    out = []
    for value, fa, fb, ta, tb in ((x, from_a[0], from_b[0], to_a[0], to_b[0]), (y, from_a[1], from_b[1], to_a[1], to_b[1])):
        m = F.try_divide(_c(tb) - _c(ta), _c(fb) - _c(fa))
        out.append((_c(value) - _c(fa)) * m + _c(ta))
    return out[0], out[1]


def repeat_for_tokens(values: Column | str, counts: Column | str) -> Column:
    """Each value as often as its count says, in order."""
    pairs = F.arrays_zip(_c(values).alias("v"), _c(counts).alias("n"))
    return F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["v"], p["n"].cast("int"))))


# colour


def grey(red: Column, green: Column, blue: Column) -> Column:
    return _c(red) * GREY_WEIGHTS[0] + _c(green) * GREY_WEIGHTS[1] + _c(blue) * GREY_WEIGHTS[2]


def colour_difference(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Weighted sum of absolute differences of two RGB values."""
    out = F.lit(0.0)
    for x, y, w in zip(a, b, GREY_WEIGHTS, strict=True):
        out = out + F.abs(_c(x) - _c(y)) * w
    return out


def rgb_hex(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("#%02x%02x%02x", _c(red).cast("int"), _c(green).cast("int"), _c(blue).cast("int"))


def segment_distance(a: Sequence[Column], b: Sequence[Column], limit: float = 0.3, far: float = 1e7) -> Column:
    """Of two segments (x1, y1, x2, y2): the sum of their end points' distances, or `far` if their angle is too wide."""
    ux, uy, vx, vy = _c(a[2]) - _c(a[0]), _c(a[3]) - _c(a[1]), _c(b[2]) - _c(b[0]), _c(b[3]) - _c(b[1])
    cosine = F.try_divide(ux * vx + uy * vy, F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
    ends = F.hypot(_c(a[0]) - _c(b[0]), _c(a[1]) - _c(b[1])) + F.hypot(_c(a[2]) - _c(b[2]), _c(a[3]) - _c(b[3]))
    return F.when(1 - F.abs(cosine) > limit, F.lit(far)).otherwise(ends)
