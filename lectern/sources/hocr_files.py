"""A data source of hOCR files: `spark.read.format("hocr").load(folder)` once register() has been called.

Files are listed once, those that a filter on `t` rules out are never opened, and the rest are dealt by size. A page is parsed as
a stream and given whole or not at all: a malformed one is a row of kind "error". Folders are local or on any store that pyarrow
knows by its address.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Kinds of elements that are read, and that of a page that could not be.
LINE, WORD, ERROR = "ocr_line", "ocrx_word", "error"
#: Bytes of files that one task reads, unless a file is larger, and what opening a file counts as.
TASK_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
_CHUNK = 1 << 16
_TIME = re.compile(r"(\d+)-(\d+(?:\.\d+)?)\.[^.]*$")
_BBOX = re.compile(r"\bbbox\s+(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)")

SCHEMA = "path string, t double, kind string, line_idx int, word_idx int, element_id string, title string, text string, left double, top double, right double, bottom double, error string"


def time_of(path: str) -> float | None:
    """Seconds from a name like MM-S.s.hocr."""
    m = _TIME.search(path)
    return int(m[1]) * 60 + float(m[2]) if m else None


@dataclass(frozen=True)
class Files(InputPartition):
    """The files of one task."""

    paths: tuple[str, ...]


class Page:
    """Lines and words of one page, gathered while it is parsed."""

    def __init__(self, words: bool):
        self.want_words = words
        self.rows: list[list] = []
        self.open: list[str | None] = []  # what each open element is
        self.line = self.word = -1
        self.parser = expat.ParserCreate()
        self.parser.UseForeignDTD(True)  # names of characters that no DTD here declares are passed over
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.data

    def start(self, name: str, attributes: dict[str, str]) -> None:
        classes = attributes.get("class", "").split()
        kind = LINE if LINE in classes else WORD if WORD in classes else None
        self.open.append(kind)
        if kind == LINE:
            self.line, self.word = self.line + 1, -1
        elif kind == WORD:
            self.word += 1
        if kind == LINE or kind == WORD and self.want_words:
            title = attributes.get("title", "")
            box = _BBOX.search(title)
            self.rows.append([kind, self.line, self.word if kind == WORD else None, attributes.get("id"), title, "", *(map(float, box.groups()) if box else (None,) * 4), None])

    def end(self, name: str) -> None:
        self.open.pop()

    def data(self, text: str) -> None:
        if self.want_words and WORD in self.open and self.rows:
            self.rows[-1][5] += text


def parse(stream, words: bool = True) -> list[tuple]:
    """(kind, line_idx, word_idx, element_id, title, text, sides, error) of a page; the text of words only."""
    page = Page(words)
    while chunk := stream.read(_CHUNK):
        page.parser.Parse(chunk, False)
    page.parser.Parse(b"", True)
    return [tuple(r[:5] + [r[5] if r[0] == WORD else None] + r[6:]) for r in page.rows]


class HocrReader(DataSourceReader):
    """Plans files by size; filters on t and kind are taken over, all others are left to Spark."""

    def __init__(self, options: dict):
        self.path, self.task_bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))
        self.suffix = options.get("suffix", ".hocr")
        self.tests: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if name in ("t", "kind"):
                self.tests.append((name, f))
            else:
                yield f

    def passes(self, name: str, value: object) -> bool:
        """As in SQL, a null passes no comparison."""
        for column, f in self.tests:
            if column != name:
                continue
            if value is None:
                return False
            if isinstance(f, In):
                hit = value in f.value
            elif f.value is None:
                hit = False
            else:
                hit = {EqualTo: value == f.value, GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]
            if not hit:
                return False
        return True

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        found = sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and self.passes("t", time_of(f.path))), key=lambda f: f.path)
        tasks: list[list[str]] = []
        held = self.task_bytes
        for f in found:
            size = (f.size or 0) + OPEN_BYTES
            if held + size > self.task_bytes:
                tasks.append([])
                held = 0
            tasks[-1].append(f.path)
            held += size
        return [Files(tuple(t)) for t in tasks] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            where = (path, time_of(path))
            try:
                with store.open_input_stream(path) as stream:
                    rows = parse(stream, self.passes("kind", WORD))
            except (expat.ExpatError, UnicodeDecodeError, ValueError) as error:
                rows = [(ERROR, *[None] * 9, str(error))]
            yield from (where + r for r in rows if self.passes("kind", r[0]))


class HocrFiles(DataSource):
    """Options: path, suffix (.hocr), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "hocr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> HocrReader:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise ValueError("hocr: load() needs a folder or a file")
        options["path"] = options["path"] if "://" in options["path"] or options["path"].startswith("file:") else f"file://{options['path']}"
        return HocrReader(options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HocrFiles)
