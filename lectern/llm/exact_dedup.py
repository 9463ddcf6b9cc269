"""Exact deduplication by content-defined chunk recipes.

Texts are cut where a gear hash of the last 32 bytes meets a mask, so equal stretches of text give equal
chunks wherever they stand. Each chunk gets a 128-bit identifier; one aggregation over the chunk dictionary
verifies that no identifier stands for two different chunks (else the next seed is tried). From then on only
recipes, the ordered identifier lists, move: two texts are equal exactly when their recipes are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import external_id, internal_id, materialise, quoted, record_batches, slices, unused

#: Chunk lengths in bytes: boundaries are looked for after MIN, expected MASK + 1 bytes later, forced at MAX.
MIN_CHUNK, MASK, MAX_CHUNK = 256, 1023, 8192
GEAR_WINDOW = 32

_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
_CHUNKED = pa.schema([("did", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary()), ("chunks", pa.list_(pa.struct([("id", pa.binary()), ("chunk", pa.binary())])))])


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    table = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
    table[0] = 0
    return table


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The hash of the GEAR_WINDOW bytes that end at each position: sum of gear[byte] << distance, in log steps."""
    h = _gear()[data]
    step = 1
    while step < GEAR_WINDOW:
        later = h.copy()
        later[step:] += h[:-step] << np.uint32(step) if step < len(h) else 0
        h, step = later, step * 2
    return h


def cut_points(text: bytes) -> list[int]:
    """Chunk ends of one text."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n] if n else []
    marks: list[int] = []
    block = 1 << 20
    data = np.frombuffer(text, np.uint8)
    for a in range(0, n, block):
        lead = min(a, GEAR_WINDOW - 1)
        h = gear_hash(data[a - lead : a + block])[lead:]
        marks += (np.flatnonzero((h >> np.uint32(12)) & np.uint32(MASK) == 0) + a + 1).tolist()
    ends, last = [], 0
    for m in [*marks, n]:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK or m == n and m > last:
            ends.append(last := m)
    return ends


def _chunk(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    name = f"{seed}:".encode()
    for rows, data, off in slices(batches, "text"):
        out: dict[str, list] = {f.name: [] for f in _CHUNKED}
        buf = data.tobytes()
        for did, a, b in zip(rows.column("did").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            text = _BLANKS.sub(b" ", buf[a:b])
            last, chunks = 0, []
            for end in cut_points(text):
                piece = text[last:end]
                chunks.append({"id": xxhash.xxh3_128_digest(name + piece), "chunk": piece})
                last = end
            out["did"].append(did)
            out["text_sha256"].append(hashlib.sha256(text).hexdigest())
            out["recipe"].append(b"".join(c["id"] for c in chunks))
            out["chunks"].append(chunks)
        yield from record_batches(_CHUNKED, out, 4096)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, text_sha256, recipe) with identifiers that are verified against the chunks' bytes."""
    base = docs.select(internal_id(quoted(id_col)).alias("did"), F.col(quoted(text_col)).cast("string").alias("text"))
    for seed in range(8):
        table = materialise(
            base.mapInArrow(lambda it, seed=seed: _chunk(it, seed), "did long, text_sha256 string, recipe binary, chunks array<struct<id:binary,chunk:binary>>"),
            "recipes",
            compression="zstd",
        )
        piece = F.explode("chunks").alias("c")
        dictionary = table.select(piece).groupBy("c.id").agg(F.min("c.chunk").alias("low"), F.max("c.chunk").alias("high"))
        if dictionary.filter("low <> high").isEmpty():
            return table.select("did", "text_sha256", "recipe")
    raise RuntimeError("no seed gave the chunks distinct identifiers")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: did, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space. A null text counts
    as empty; empty texts are equal to each other. A null id ranks last. Of rows that share both the text and the
    smallest id, each is kept: they can't be told apart. An empty table gives no rows.
    """
    rows = recipes(docs, id_col, text_col)
    # written, so that the join below stands between two exchanges and a recipe with very many rows can be split
    groups = materialise(rows.groupBy("recipe").agg(F.min("did").alias("first"), F.count("*").alias("members")).filter("members > 1"), "groups")
    return rows.join(groups, "recipe", "left").select(
        "did",
        F.coalesce("first", "did").alias("keep"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text equals that of a row with a smaller id; columns as they were, whatever their names.

    Nulls, ties and repeated rows as in exact_duplicates(): a null text is empty, of rows with the same text and smallest id all stay.
    """
    drop = exact_duplicates(docs, id_col, text_col).filter("did <> keep").select("did", "text_sha256").distinct()
    blanks = F.regexp_replace(F.coalesce(docs[quoted(text_col)].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    did, sha = unused(docs.columns, "did"), unused(docs.columns, "sha")
    keys = drop.select(F.col("did").alias(did), F.col("text_sha256").alias(sha))
    return docs.join(keys, (internal_id(docs[quoted(id_col)]) == keys[did]) & (F.sha2(blanks, 256) == keys[sha]), "left_anti")


def op9(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).select(
        external_id("did").alias("doc_id"), external_id("keep").alias("keep_id"), "group_size", (F.col("did") == F.col("keep")).alias("kept"), "text_sha256"
    )


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
