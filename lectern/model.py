"""Schemas of the stage tables. Time is in seconds as double at the edges and in tenths of a second (ticks) inside."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # needs an active session


BBOX = "struct<left:double,top:double,right:double,bottom:double>"

DDL = {
    "sessions": "session_id string, video_path string, duration_s double",
    "intervals": "session_id string, part string, start_time double, end_time double, transitions array<double>",
    "lines": f"session_id string, tick int, line_idx int, line_id string, bbox {BBOX}, updated_line string, in_first_step boolean, pair_offset int",
    "words": f"session_id string, tick int, line_idx int, word_idx int, word_id string, text string, text_ascii string, ocr_text string, bbox {BBOX}, global_ids array<int>, highlight string",
    "ref_lines": "doc_name string, line_idx int, line string",
    "ref_word_pos": "doc_name string, word string, gid int",
    "hl_events": "session_id string, tick int, gid int, text string, id_group array<int>, color string, former array<string>",
    "stitched": "session_id string, line_idx int, line string, top double, bottom double",
    "scroll": "session_id string, time double, top double, bottom double",
    "edits": "session_id string, tick int, word_idx int, text string, highlight string, editor string, seconds double",
    "ledger": "session_id string, stage string, seconds double",
}


def schema(name: str) -> T.StructType:
    return _s(DDL[name])


#: Background and foreground of the highlight colours.
WHITE, BLACK, DARK_BLUE, LIGHT_BLUE, YELLOW = (245, 245, 245), (10, 10, 10), (71, 148, 241), (213, 242, 254), (253, 250, 193)
COLOUR_PAIRS = {"dark blue": (WHITE, DARK_BLUE), "light blue": (LIGHT_BLUE, BLACK), "yellow": (YELLOW, BLACK), "white": (WHITE, BLACK)}
GREY_WEIGHTS = (0.299, 0.587, 0.114)
DEFAULT_COLOUR = "white"

#: File endings of screen recordings, also taken in upper case.
VIDEO_ENDINGS = (
    ".3g2 .3gp .m2ts .mts .amv .asf .avi .drc .f4a .f4b .f4p .f4v .flv .gif .gifv .m2v .m4p .m4v .mkv .mng .mov .mp2 .mp4 .mpe .mpeg .mpg .mpv .mxf .nsv .ogg .ogv .qt .rm .rmvb .roq .svi .vob .webm .wmv .yuv"
).split()

#: Pixel ranges of the parts of a frame, None for the whole.
PART_RANGES = {"digital reading": ((None, None), (None, None)), "form": ((676, 1314), (143, 793)), "typing": ((0, 2880), (0, 1800))}
PIXELS_PER_BIN = 100
