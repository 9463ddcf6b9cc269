"""Product codes of vectors by Lloyd rounds over filtered kd-trees.

Entries become integers, x = floor(scale * entry), and vectors are cut into equal parts, each with its own codebook. Every
partition cuts its rows into chunks and builds a kd-tree per chunk and part, once: each node holds its points' bounding box and
caches their sum and count. A round walks the trees from the roots with the codebook's entries as candidates. An entry that is
farther than the one nearest to the box's middle from every point of the box is dropped; a node with one candidate left is
assigned whole, by its sum and count; only points of leaves with several candidates are compared one by one. What a round
hands on is a sum and a count per entry and task; the driver gets one per entry.

All distances and sums are exact integers (of Python where 64 bits do not hold them), so neither the trees nor the order of rows
decide anything. Equal distances go to the lower index, in boxes too: at a tie the lower one is not dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, external_id, internal_id, materialise, quoted
from .vectors import finite, packed, parts_of, scaled, unpacked, usual_length, vector_rows

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a tree, and points of a leaf.
CHUNK, LEAF = 4096, 4
#: A file of trees has groups of about this many bytes, which bounds what is read at a time: its rows are large.
GROUP = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}


class Trees:
    """The kd-trees of one chunk, one per part, all of one shape: level l has 2**l nodes, each a range of the part's sorted points.

    Arrays are (part, node or point, place). `order` gives the row of each point.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums
        self.depth = (low.shape[1] + 1).bit_length() - 2
        self.bounds = [level_bounds(points.shape[1], level) for level in range(self.depth + 1)]


def level_bounds(n: int, level: int) -> np.ndarray:
    """Where the ranges of a level start, and n."""
    return (np.arange((1 << level) + 1) * n) >> level


def build(x: np.ndarray, parts: int) -> Trees:
    """Trees over the rows of x, split at the middle of the widest side."""
    n, width = len(x), x.shape[1] // parts
    depth = max(0, (n // LEAF).bit_length() - 1) if n > LEAF else 0
    points = np.ascontiguousarray(x.reshape(n, parts, width).transpose(1, 0, 2))
    order = np.tile(np.arange(n), (parts, 1))
    low, high, sums = ([] for _ in range(3))
    row = np.arange(parts)[:, None]
    for level in range(depth + 1):
        bounds = level_bounds(n, level)
        lo, hi = np.minimum.reduceat(points, bounds[:-1], axis=1), np.maximum.reduceat(points, bounds[:-1], axis=1)
        low.append(lo)
        high.append(hi)
        sums.append(np.add.reduceat(points, bounds[:-1], axis=1))
        if level < depth:
            node = np.repeat(np.arange(1 << level), np.diff(bounds))
            side = (hi - lo).argmax(axis=2)[:, node]
            key = np.take_along_axis(points, side[:, :, None], axis=2)[:, :, 0]
            at = np.stack([np.lexsort((k, node)) for k in key])
            points, order = points[row, at], order[row, at]
    return Trees(points, order, *(np.concatenate(a, axis=1) for a in (low, high, sums)))


def _exact(*arrays: np.ndarray) -> bool:
    """Whether squared distances between these fit 62 bits; else the arithmetic takes Python's integers."""
    top = max(max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in arrays)
    return 16 * top * top * max(1, arrays[0].shape[-1]) < 1 << 62


def assign(trees: Trees, books: np.ndarray, labels: bool = False) -> tuple[list[list[int]], list[list[list[int]]], np.ndarray | None, int]:
    """(counts, sums) per part and entry, with `labels` the entry of each point too, and how many points were compared one by one.

    books: (part, entry, place).
    """
    kind = np.int64 if _exact(trees.points, books) else object
    points, low, high, books = (a.astype(kind, copy=False) for a in (trees.points, trees.low, trees.high, books))
    parts, k, width = books.shape
    counts = np.zeros((parts, k), np.int64)
    sums = np.zeros((parts, k, width), object)
    found = np.zeros(trees.order.shape, np.int64) if labels else None

    part, node = np.arange(parts), np.zeros(parts, np.int64)
    open_ = np.ones((parts, k), bool)
    entry_number = np.arange(k)
    compared = 0
    for level in range(trees.depth + 1):
        first, bounds = (1 << level) - 1, trees.bounds[level]
        book = books[part]
        lo, hi = low[part, first + node], high[part, first + node]
        # nearest to the middle, of equally near ones the lower index
        gap = 2 * book - (lo + hi)[:, None, :]
        distance = (gap * gap).sum(axis=2)
        farthest = distance.max() + 1
        best = np.where(open_, distance, farthest).argmin(axis=1)
        star = book[np.arange(len(part)), best][:, None, :]
        # the corner of the box that suits each entry best against the nearest one
        corner = np.where(book > star, hi[:, None, :], lo[:, None, :])
        margin = ((book - star) * (book + star - 2 * corner)).sum(axis=2)
        beaten = (margin > 0) | ((margin == 0) & (entry_number > best[:, None]))
        open_ = open_ & ~beaten.astype(bool)
        open_[np.arange(len(part)), best] = True

        alone = open_.sum(axis=1) == 1
        begin, end = bounds[node], bounds[node + 1]
        np.add.at(counts, (part[alone], best[alone]), (end - begin)[alone])
        np.add.at(sums, (part[alone], best[alone]), trees.sums[part, first + node][alone].astype(object))
        if found is not None:
            for p, e, a, b in zip(part[alone], best[alone], begin[alone], end[alone], strict=True):
                found[p, a:b] = e
        part, node, open_ = part[~alone], node[~alone], open_[~alone]
        if not len(part):
            break
        if level < trees.depth:
            part, node, open_ = np.repeat(part, 2), np.repeat(node, 2) * 2 + np.tile([0, 1], len(node)), np.repeat(open_, 2, axis=0)
            continue
        begin, size = bounds[node], bounds[node + 1] - bounds[node]
        of = np.repeat(np.arange(len(node)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        compared = len(at)
        for p in np.unique(part):
            mine = np.flatnonzero(part[of] == p)
            pts = points[p, at[mine]]
            # squared distance less the point's own square, which all entries share
            distance = (books[p] * books[p]).sum(axis=1)[None, :] - 2 * (pts @ books[p].T)
            nearest = np.where(open_[of[mine]], distance, distance.max() + 1).argmin(axis=1)
            counts[p] += np.bincount(nearest, minlength=k)
            hit = nearest[:, None] == entry_number
            sums[p] += (hit.T.astype(kind) @ pts).astype(object)
            if found is not None:
                found[p, at[mine]] = nearest
    return counts.tolist(), sums.tolist(), found, compared


_TREES = "rows int, nodes int, points binary, row_of binary, low binary, high binary, sums binary"

_TREE_COLUMNS = [c.split()[0] for c in _TREES.split(", ")]


def _grow(length: int, scale: int, parts: int) -> Callable:
    """Trees of a partition's rows, a row per chunk."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, CHUNK):
            keep, x = scaled(batch.column(2), length, scale)
            if not len(keep):
                continue
            trees = build(np.pad(x, ((0, 0), (0, -length % parts))), parts)
            rows = batch.take(pa.array(keep))
            whole = [pa.ListArray.from_arrays(pa.array([0, len(keep)], pa.int32()), rows.column(i)) for i in (0, 1)]
            cells = [pa.array(packed(a.reshape(1, -1)), pa.binary()) for a in (trees.points, trees.order, trees.low, trees.high, trees.sums)]
            yield pa.record_batch([*whole, pa.array([len(keep)], pa.int32()), pa.array([trees.low.shape[1]], pa.int32()), *cells], ["ids", "labels", "rows", "nodes", "points", "row_of", "low", "high", "sums"])

    return grow


def _chunks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, Trees]]:
    for chunk in parts_of(batches, 1):
        n, nodes = chunk.column("rows")[0].as_py(), chunk.column("nodes")[0].as_py()
        cells = lambda name, m, w: unpacked(chunk.column(name), parts * m * w).reshape(parts, m, w)  # noqa: E731, B023
        yield chunk, Trees(cells("points", n, width), cells("row_of", n, 1)[:, :, 0], cells("low", nodes, width), cells("high", nodes, width), cells("sums", nodes, width))


def _round(books: np.ndarray) -> Callable:
    """Sums and counts of a task's parts by entry; the count stands at place -1."""
    parts, k, width = books.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[[0] * (width + 1) for _ in range(k)] for _ in range(parts)]
        for _, trees in _chunks(batches, parts, width):
            counts, sums, _, _ = assign(trees, books)
            total = [[[t + v for t, v in zip(old, (c, *s), strict=True)] for old, c, s in zip(*of, strict=True)] for of in zip(total, counts, sums, strict=True)]
        part, entry, place = (a.ravel() for a in np.indices((parts, k, width + 1)))
        values = pa.array([Decimal(v) for of in total for row in of for v in row], pa.decimal128(38, 0))
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place - 1, pa.int32()), values], ["part", "entry", "place", "s"])

    return step


def _encode(books: np.ndarray) -> Callable:
    parts, k, width = books.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, trees in _chunks(batches, parts, width):
            _, _, found, _ = assign(trees, books, labels=True)
            kind = np.int64 if _exact(trees.points, books) else object
            n = trees.order.shape[1]
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, kind)
            for p in range(parts):
                codes[trees.order[p], p] = found[p]
                gap = trees.points[p].astype(kind) - books[p].astype(kind)[found[p]]
                error[trees.order[p]] += (gap * gap).sum(axis=1)
            text = codes.tobytes().hex()
            exact = [int(v) for v in error]
            yield pa.record_batch(
                [first.column("ids").flatten(), first.column("labels").flatten(), pa.array([text[a : a + 2 * parts] for a in range(0, 2 * parts * n, 2 * parts)], pa.string()), pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0))],
                ["did", "label", "code", "error"],
            )

    return encode


def first_entries(rows: DataFrame, length: int, scale: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, ascending; of rows that share an id, the smaller vector comes first."""
    wanted = rows.filter(finite(F.col("v")) & (F.size("v") == length)).select("did", "v").orderBy("did", "v").limit(entries)
    chosen = pa.array([r["v"] for r in wanted.collect()], pa.list_(pa.float64()))
    _, x = scaled(chosen, length, scale)
    x = np.pad(x, ((0, 0), (0, -length % parts)))
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(a row per vector that counts: did, label, code, error; the codebooks by part, entry and place).

    A vector counts if neither it nor an entry of it is null, infinite or not a number, and it has the table's commonest length (of equally
    common ones the greatest). A length that the parts don't divide is filled up with zeros. Scaled entries beyond 2**46 are held
    there. With fewer vectors than entries the codebooks are smaller. A null id ranks last; rows that share an id are ordered by
    their vectors for the first codebook; repeated rows count each time. error is a decimal, as it may not fit a long. An empty table
    gives no rows and empty codebooks; names of other columns don't matter. A task holds one chunk of rows at a time.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits: 1 to 256 entries")
    rows = vector_rows(table, vec_col, did=internal_id(quoted(id_col)), label=F.col(quoted(label_col)))
    length = usual_length(rows)
    kind = rows.schema["label"].dataType.simpleString()
    coded = f"did long, label {kind}, code string, error decimal(38,0)"
    if not length:
        return table.sparkSession.createDataFrame([], coded), np.zeros((parts, 0, 0), np.int64)
    books = first_entries(rows, length, scale, parts, entries)
    grown = rows.select("did", "label", "v").mapInArrow(_grow(length, scale, parts), f"ids array<long>, labels array<{kind}>, {_TREES}")
    trees = materialise(grown, "trees", rows, **GROUP)
    for _ in range(rounds):
        sums = trees.select(*_TREE_COLUMNS).mapInArrow(_round(books), "part int, entry int, place int, s decimal(38,0)").groupBy("part", "entry", "place").agg(F.sum("s").alias("s"))
        total = {(r["part"], r["entry"], r["place"]): int(r["s"]) for r in sums.collect()}
        books = books.copy()
        for p, e, place in np.ndindex(books.shape):
            if total[p, e, -1]:
                books[p, e, place] = total[p, e, place] // total[p, e, -1]
    out = materialise(trees.mapInArrow(_encode(books), coded), "codes", rows)
    discard(trees)
    return out, books


def op12(embeddings: DataFrame) -> DataFrame:
    """A label's error is summed before it meets the rows again; null labels are one label. A sum beyond a long is null."""
    coded, books = compress(embeddings)
    long = lambda c: F.when(c <= F.lit((1 << 63) - 1), c).cast("long")
    # a table of its own: its size is known when the join is planned
    per_label = materialise(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels", coded)
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of"))).select(
        external_id("did").alias("vec_id"), "code", long(F.col("error")).alias("error"), long(F.col("label_error")).alias("label_error"), F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


def _lloyd_sql() -> str:
    """The rounds, one after the other, comparing every part with every entry."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = [
        f"x AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS v FROM x, (SELECT unnest(range({PARTS})) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p.part, arg_min(p.v, ({distance}, entry)) AS v, min(({distance}, entry)) AS best FROM p JOIN c{r} c ON c.part = p.part GROUP BY ALL)")
        if r < ROUNDS:
            mean = f"SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, best[2] AS entry, i, CAST(floor(sum(v[i + 1]) / count(*)) AS BIGINT) AS m FROM a{r}, (SELECT unnest(range(64)) AS i) WHERE i < len(v) GROUP BY ALL) GROUP BY ALL"
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN ({mean}) m ON m.part = c.part AND m.entry = c.entry)")
    last = f"a{ROUNDS}"
    return "WITH " + ",\n".join(out) + f""",
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM {last} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


OP12_SQL = _lloyd_sql()
