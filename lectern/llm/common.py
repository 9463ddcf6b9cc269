"""Shared plumbing of the training-data operators: scratch tables, id handling, Arrow slices."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.scratch import shared_folder
from .textscan import SPACE, words

#: A null id ranks after every other id; inside an operator it is held as this value.
NULL_ID = (1 << 63) - 1
#: Raw text bytes that one vectorised step works on (a longer text is a step of its own).
SLICE_BYTES = 4 << 20
#: Bytes that a file of a scratch table has at least, if the table is large enough.
LEAST_FILE = 4 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or a temporary one where it is unset in local mode."""
    sc = spark.sparkContext
    path = shared_folder(spark)
    if sc.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path.rstrip("/")


_LOCK = threading.Lock()
_WRITING: dict[int, int] = {}
_BEFORE: dict[int, str | None] = {}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While a table is written, shuffle files of what is finished are released at once; the setting is restored after the last of
    the writes that run at a time."""
    key = id(spark._jsparkSession)
    with _LOCK:
        if not _WRITING.get(key):
            _BEFORE[key] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _WRITING[key] = _WRITING.get(key, 0) + 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING[key] -= 1
            if not _WRITING[key]:
                before = _BEFORE.pop(key)
                if before is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, before)


def gathered(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """df in no more tasks than keep LEAST_FILE bytes each, or three for each core: else a table of many small files stays one, and every
    step over it. The size is the planner's estimate for `source`, or df: what it can't tell counts as large."""
    size = (df if source is None else source)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.coalesce(max(3 * df.sparkSession.sparkContext.defaultParallelism, min(int(str(size)) // LEAST_FILE, (1 << 31) - 1)))


def materialise(df: DataFrame, label: str, source: DataFrame | None = None, **options: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut and executors may be lost.

    Shuffle files of the finished write are released at once, so they do not add to the next step's. The table has files as
    gathered() says.
    """
    spark = df.sparkSession
    df = gathered(df, source)
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    for made in getattr(_SCOPES, "open", ()):
        made.append(table)
    return table


_SCOPES = threading.local()


@contextmanager
def scratch_scope() -> Iterator[list[DataFrame]]:
    """The tables that this thread materialises meanwhile: the caller discards those that are spent."""
    made: list[DataFrame] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", ()), made]
    try:
        yield made
    finally:
        _SCOPES.open.pop()


def discard(table: DataFrame) -> None:
    """Delete the files of a table that materialise() gave and that no later step reads."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def internal_id(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID)).cast("long")


def external_id(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != F.lit(NULL_ID), c)


#: The bits of a place in a text, which a string's greatest length bounds; a text_tag has the other 33.
POSITION = (1 << 31) - 1


def text_tag(text: Column) -> Column:
    """33 bits of the text's hash, shifted over a position; tells apart texts that share an id."""
    return F.shiftleft(F.xxhash64(text), 31)


def quoted(name: str) -> str:
    """A column's name as col() takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(columns: Sequence[str], name: str) -> str:
    """A column name that does not clash."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary Arrow array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(kind)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, data, offsets) pieces of the batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, off = raw_bytes(batch.column(batch.schema.get_field_index(text)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def byte_pieces(batches: Iterator[pa.RecordBatch], text: str, overlap: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """slices(), with the place of the first byte. A longer text comes in pieces; `overlap` bytes of one start the next."""
    for rows, data, off in slices(batches, text, limit):
        for a in range(0, max(1, len(data) - overlap), limit) if rows.num_rows == 1 else (0,):
            piece = data[a : a + limit + overlap] if rows.num_rows == 1 else data
            yield rows, piece, np.array([0, len(piece)]) if rows.num_rows == 1 else off, a


def word_pieces(batches: Iterator[pa.RecordBatch], text: str, overlap: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """slices(), with the number of the first word. A longer text comes in pieces of whole words; `overlap` words of one start the next."""
    for rows, data, off in slices(batches, text, limit):
        at, base, size = 0, 0, limit
        while rows.num_rows == 1 and at + size < len(data):
            end = at + size
            while end < len(data) and not SPACE[data[end]]:
                gap = np.flatnonzero(SPACE[data[end : end + 4096]])
                end += int(gap[0]) if len(gap) else len(data[end : end + 4096])
            piece = data[at:end]
            start = words(piece, np.array([0, len(piece)]))[0]
            if len(start) <= overlap:  # words too long for a piece of this size
                size *= 2
                continue
            yield rows, piece, np.array([0, len(piece)]), base
            base += len(start) - overlap
            at, size = at + int(start[len(start) - overlap]), limit
        yield rows, data[at:], off if rows.num_rows > 1 else np.array([0, len(data) - at]), base


def record_batches(schema: pa.Schema, columns: dict, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Column arrays as batches of bounded length."""
    table = pa.table([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)
    yield from table.to_batches(max_chunksize=rows)
