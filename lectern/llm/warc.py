"""WARC archives and their capture index.

Pages are written as WARC/1.1 records, a gzip member each, through Spark's own text writer, which keeps task commits atomic and works on
any store: the last byte of a member is the top byte of its length, zero for less than 16 MB, so a line is a member without
that byte, and the line separator is the zero. A task begins another archive once one has ARCHIVE_BYTES. Equal payloads are stored
once, as the response with the smallest page id; the others are revisits that refer to it. Reading inflates one record after
the other, parses it by its stated length and checks its digest; offset and length of a capture are those of its members in the file.

The index is merged externally: each archive gives a run of captures sorted by URL key and timestamp, runs are dealt into key
ranges of about RANGE_ROWS captures, and in each range a loser tree merges the runs' parts. Ranges in order hold the capture
histories in global order. Memory follows the longest archive and range, which the two bounds keep from growing with the table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, quoted, record_batches, scratch_dir

#: Payloads of at least so many bytes are stored once; bytes after which an archive is closed; captures of a key range; seconds since
#: 1970 of page 0's capture.
MIN_REVISIT_BYTES, ARCHIVE_BYTES, RANGE_ROWS, EPOCH = 0, 16 << 20, 100_000, 1_700_000_000

_END = "\r\n\r\n"
#: The most bytes of one gzip member whose length has a zero as its top byte.
_MEMBER = (1 << 24) - 1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:lectern:page:"

_CAPTURE = pa.schema(
    [
        ("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ]
)
CAPTURE_DDL = "urlkey string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def base32(sha1_hex: Column) -> Column:
    """The upper-case base32 of 40 hex digits: 20 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, n, digest, refers_to): refers_to is null for responses."""
    id_col, url_col, html_col = quoted(id_col), quoted(url_col), quoted(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("n"), F.sha1("html").alias("sha1"), F.unhex(F.sha2("html", 256)).alias("sha2"))
    same = rows.groupBy("sha1", "sha2", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    shared = materialise(same.filter((F.col("copies") > 1) & (F.col("n") >= min_bytes)).drop("copies"), "payloads", pages)
    joined = rows.join(shared, ["sha1", "sha2", "n"], "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "n", base32(F.col("sha1")).alias("digest"), F.when(later, F.col("first")).alias("refers_to"))


def record_text(page_id: Column, url: Column, html: Column, n: Column, digest: Column, refers_to: Column) -> Column:
    """A record without its closing two line breaks."""
    number = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    seconds = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1 << 28)))
    clean = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(_END))
    revisit = refers_to.isNotNull()
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(n)
    fields = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), number(page_id)),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), number(refers_to))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *fields)
    return F.concat(head, F.lit(_END), http, F.when(revisit, "").otherwise(html))


def gzip_members(record: bytes) -> bytes:
    """A record as a gzip member, or several if it is very long; the last byte is zero."""
    out = []
    for a in range(0, max(1, len(record)), _MEMBER):
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [engine.compress(record[a : a + _MEMBER]), engine.flush()]
    return b"".join(out)


_LINE = pa.schema([("roll", pa.int32()), ("line", pa.binary())])


def _lines(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Records as lines (members without their last byte), and the number of the archive that each goes to."""
    roll = size = held = 0
    rolls: list[int] = []
    lines: list[bytes] = []
    for batch in batches:
        for record in batch.column(0):
            line = gzip_members(record.as_py().encode() + _END.encode())[:-1]
            if size and size + len(line) >= most:
                roll, size = roll + 1, 0
            size += len(line) + 1
            held += len(line)
            rolls.append(roll)
            lines.append(line)
            if held >= 1 << 22:
                yield from record_batches(_LINE, {"roll": rolls, "line": lines}, 4096)
                rolls, lines, held = [], [], 0
    if lines:
        yield from record_batches(_LINE, {"roll": rolls, "line": lines}, 4096)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write archives to a folder: one record per row. A null payload is empty; a null URL has no target field."""
    rows = with_revisits(pages, id_col, url_col, html_col, min_bytes)
    record = record_text(*(F.col(c) for c in ("page_id", "url", "html", "n", "digest", "refers_to")))
    lines = rows.select(record.alias("value")).mapInArrow(lambda it: _lines(it, archive_bytes), "roll int, line binary")
    # bytes cast to a string are written as they are
    lines.select("roll", F.col("line").cast("string").alias("value")).write.partitionBy("roll").option("lineSep", "\0").text(path)
    return path


def url_key(url: str) -> str:
    """Host labels from the right, then the path and query: the order of capture indexes."""
    parts = urlsplit(url) if "://" in url else urlsplit("//" + url)
    host = re.sub(r"^www\d*\.", "", parts.netloc.rpartition("@")[2].lower())
    return f"{','.join(reversed(host.split('.')))}){parts.path.lower() or '/'}{'?' + parts.query if parts.query else ''}"


def _safe_key(url: str) -> str:
    try:
        return url_key(url)
    except ValueError:  # a bracket that opens no address
        return url


class _Inflate:
    """Reads of a gzip archive in order, a bounded piece at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.engine = zlib.decompressobj(31)
        self.member = 0  # where the member begins that is being read

    def _more(self) -> bool:
        """Hold more bytes, unless the archive ends."""
        while True:
            if self.engine.eof:
                self.engine, self.member = zlib.decompressobj(31), self.at
            piece = self.data[self.at : self.at + (1 << 16)]
            out = self.engine.decompress(piece, 1 << 20)
            self.at += len(piece) - len(self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail)
            if out:
                self.held += out
                return True
            if self.at == len(self.data):
                return False

    def place(self) -> int:
        """Where a reader has to begin to get what comes next: the member that holds it."""
        if not self.held and not self.engine.eof:  # a member's last bytes give nothing
            self._more()
        return self.member if self.held else self.at

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _number(field: str) -> int | None:
    text = field.strip("<>").removeprefix(_URN)
    return None if text == "null" else int(text)


def parse_archive(name: str, data: bytes) -> list[tuple]:
    """The captures of one archive, sorted by URL key, timestamp and page id. Raises on a digest that does not fit."""
    source, out = _Inflate(data), []
    while True:
        offset = source.place()
        head = source.until(_END.encode())
        if head is None:
            break
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no record at {offset}")
        fields = dict(x.partition(": ")[::2] for x in lines[1:] if x)
        http, _, payload = source.take(int(fields["Content-Length"])).partition(_END.encode())
        source.take(4)
        size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{name}: the payload at {offset} does not fit its digest")
        url = fields.get("WARC-Target-URI")
        refers = _number(fields["WARC-Refers-To"]) if kind == "revisit" else None
        stamp = re.sub(r"\D", "", fields["WARC-Date"])
        out.append((_safe_key(url or ""), stamp, _number(fields["WARC-Record-ID"]), url, kind, refers, size, digest, name, offset, (end if (end := source.place()) > offset else source.at) - offset))
    out.sort(key=_order)
    return out


def _order(row: Sequence) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            name = "/".join(batch.column("path")[i].as_py().split("/")[-2:])
            rows = parse_archive(name, batch.column("content")[i].as_py())
            for a in range(0, len(rows), 8192):
                yield from record_batches(_CAPTURE, dict(zip(_CAPTURE.names, zip(*rows[a : a + 8192], strict=True), strict=True)))


class LoserTree:
    """K-way merge: each inner node holds the run that lost there, the winner is at the top; a step replays one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(len(runs)):
            self._enter(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _enter(self, leaf: int) -> None:
        """First entries: a run waits at the first node where no other has come by yet."""
        winner, node = leaf, (leaf + self.k) >> 1
        while node:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node >>= 1
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        if self.k == 1:
            self.tree[0] = 0
        while (head := self.heads[winner := self.tree[0]]) is not None:
            yield head[1]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.k) >> 1
            while node:
                if self._less(self.tree[node], winner):
                    winner, self.tree[node] = self.tree[node], winner
                node >>= 1
            self.tree[0] = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range, of RANGE_ROWS captures or so: the archives' parts, each in order, merged."""
    runs: dict[str, list[list[tuple]]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = _order(row)
            parts = runs.setdefault(row[8], [])
            if not parts or parts[-1][-1][0] > key:  # fetched out of order: a run of its own
                parts.append([])
            parts[-1].append((key, row))
    merged = iter(LoserTree([iter(p) for parts in runs.values() for p in parts]))
    while rows := list(islice(merged, 4096)):
        yield from record_batches(_CAPTURE, dict(zip(_CAPTURE.names, zip(*rows, strict=True), strict=True)))


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of a folder of archives, range by range in order of URL key, timestamp and page id."""
    archives = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")
    runs = materialise(archives.mapInArrow(_captures, CAPTURE_DDL), "captures", compression="zstd")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(ranges, "urlkey", "timestamp", "page_id").mapInArrow(_merge, CAPTURE_DDL)


def archive_pages(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write the pages, read the archives back, and return their capture index.

    One row per input row. A null payload is empty, a null URL stays null. Of rows with equal payloads, those with the smallest page
    id are responses (several if the id repeats) and others are revisits; a null id ranks last. A very long page is a record of
    several members, and may be an archive by itself. An empty table gives no rows; names of other columns don't matter.
    """
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    return capture_index(spark, write_archives(pages, path, **columns))


def op4(pages: DataFrame) -> DataFrame:
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS n, [CAST('0x' || substr(sha1(h), 1 + 5 * i, 5) AS INT) FOR i IN range(8)] AS v, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR x IN v], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
