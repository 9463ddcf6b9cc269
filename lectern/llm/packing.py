"""Packing examples into sequences by vector bin packing.

An example is a vector (tokens, segments, loss-bearing tokens); a sequence is a bin with a limit on each. The dot-product
heuristic fills one bin at a time with the example that fits and has the greatest dot product, limits as unit, with what
is left of the bin. Where examples may be cut, a bin that nothing fits any more is filled up with a part of the one
that is left, and a bin that the other limits keep short is cut back to a power of two, a length that needs no padding.

Each task packs the documents of its own partition, a bounded pool at a time, without any exchange. Sequence ids are
made of the partition's number and a counter, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import external_id, internal_id, quoted, record_batches, slices

#: Limits of a sequence; the id that ends a document; examples that wait in a task for a place.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, END, POOL = 1024, 64, 1024, 0, 1024

#: The added token of byte_bpe_50k.json, which the ranks do not hold.
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of byte_bpe_50k: byte_bpe_50k.json holds the same vocabulary; tests compare the ids."""
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@dataclass
class Item:
    """Ids [start, start + length) of an example whose ids from loss_from on bear loss."""

    key: int
    start: int
    length: int
    loss_from: int

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, size: int) -> tuple[Item, Item]:
        """The first `size` ids, and the others."""
        return Item(self.key, self.start, size, self.loss_from), Item(self.key, self.start + size, self.length - size, self.loss_from)


@dataclass
class Packer:
    limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)
    cut: bool = True
    items: list[Item] = field(default_factory=list)
    bins: list[list[Item]] = field(default_factory=list)

    def add(self, key: int, length: int, loss: int) -> None:
        """A new example; its last `loss` ids bear loss. Where cutting is allowed, what is longer than a limit is cut to it."""
        rest = Item(key, 0, length, length - loss)
        if not self.cut and (length > self.limits[0] or loss > self.limits[2]):
            raise ValueError(f"an example of {length} tokens does not fit and may not be cut")
        while (most := self.fits(rest)) < rest.length:
            head, rest = rest.cut(most)
            if most == self.limits[0]:
                self.bins.append([head])
            else:
                self._wait(head)
        self._wait(rest)

    def fits(self, x: Item) -> int:
        """How many of the first ids of an example one bin can hold."""
        return min(x.length, self.limits[0], max(0, x.loss_from - x.start) + self.limits[2])

    def _wait(self, x: Item) -> None:
        self.items.append(x)
        if len(self.items) >= POOL:
            self.pack(POOL // 2)

    def pack(self, leave: int = 0) -> None:
        """Fill bins until at most `leave` examples wait."""
        limits = np.array(self.limits, float)
        while len(self.items) > leave:
            vectors = np.array([(x.length, 1, x.loss) for x in self.items], float) / limits
            free = np.ones(len(vectors), bool)
            waiting = int(free.sum())
            rest: list[Item] = []
            while waiting > leave:
                room = np.ones(3)
                chosen: list[Item] = []
                while True:
                    fits = free & (vectors <= room + 1e-9).all(axis=1)
                    if not fits.any():
                        break
                    best = int(np.argmax(np.where(fits, vectors @ room, -1.0)))
                    chosen.append(self.items[best])
                    free[best] = False
                    room = room - vectors[best]
                if self.cut:
                    self._fill(chosen, free, vectors, limits)
                    rest += self._trim(chosen)
                self.bins.append(chosen)
                waiting = int(free.sum())
            self.items = [x for x, f in zip(self.items, free, strict=True) if f] + rest
            if not rest:
                break

    def _fill(self, chosen: list[Item], free: np.ndarray, vectors: np.ndarray, limits: np.ndarray) -> None:
        """Part of a waiting example for the room that is left; its rest keeps waiting."""
        room = self.limits[0] - sum(x.length for x in chosen)
        spare = self.limits[2] - sum(x.loss for x in chosen)
        if room <= 0 or spare < room or len(chosen) >= self.limits[1] or not free.any():
            return
        at = int(np.argmax(np.where(free, vectors[:, 0], -1.0)))
        x = self.items[at]
        if x.length <= room:
            return
        head, tail = x.cut(room)
        self.items[at] = tail
        vectors[at] = np.array((tail.length, 1, tail.loss)) / limits
        chosen.append(head)

    def _trim(self, chosen: list[Item]) -> list[Item]:
        """Cut a bin back to a power of two; what is cut off waits again."""
        total = sum(x.length for x in chosen)
        over = total - (1 << total.bit_length() - 1)
        back: list[Item] = []
        while over > 0:
            x = chosen.pop()
            if x.length > over:
                head, x = x.cut(x.length - over)
                chosen.append(head)
            back.append(x)
            over -= x.length
        return back


_PIECE = pa.schema(
    [("did", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


def _pack(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool, limits: tuple[int, int, int], cut: bool) -> Iterator[pa.RecordBatch]:
    encode = encoding(path).encode_to_numpy
    packer = Packer(limits, cut)
    texts: dict[int, list] = {}  # of documents with pieces that wait: id, ids, ids not yet placed
    number, sequence = 0, TaskContext.get().partitionId() << 32

    def ids_of(text: bytes) -> np.ndarray:
        return encode(text.decode("utf-8", "replace"), allowed_special="all", disallowed_special=())

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        out: dict[str, list] = {f.name: [] for f in _PIECE}
        for chosen in packer.bins:
            offset = 0
            for x in chosen:
                held = texts[x.key]
                ids = held[1][x.start : x.start + x.length]
                values = (held[0], x.start, x.length, zlib.crc32(ids.tobytes()), len(held[1]), sequence, offset, ids.astype(np.int32) if with_ids else None)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
                offset += x.length
                held[2] -= x.length
                if not held[2]:
                    del texts[x.key]
            sequence += 1
        packer.bins.clear()
        if out["did"]:
            yield from record_batches(_PIECE, out, 1024)

    for rows, data, off in slices(batches, "text", 1 << 20):
        buf = data.tobytes()
        prompts = rows.column("prompt").to_pylist()
        for did, prompt, a, b in zip(rows.column("did").to_pylist(), prompts, off[:-1].tolist(), off[1:].tolist(), strict=True):
            ids = np.append(ids_of(buf[a:b]), END).astype("<u4")
            loss = len(ids) - (prompt is None)
            if prompt is not None:
                ids = np.concatenate([ids_of(prompt.encode()), ids])
            packer.cut = cut or len(ids) > limits[0] or loss > limits[2]
            texts[number] = [did, ids, len(ids)]
            packer.add(number, len(ids), loss)
            packer.cut = cut
            number += 1
            if len(packer.bins) >= 256:
                yield from flush()
        yield from flush()
    packer.pack()
    yield from flush()


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True,
    prompt_col: str | None = None, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS), cut: bool = True,
) -> DataFrame:
    """One row per piece: did, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its ids and the id END; all but its first id bear loss. With prompt_col an example is the prompt's ids, the text's
    and END, and only the latter two bear loss. Every id lies in exactly one piece, and pieces of a sequence keep all three of
    `limits`: tokens, pieces, ids that bear loss. With `cut` sequences have a power of two as length, so none needs padding;
    without, examples stay whole, but for those that are beyond a limit alone.

    A null text is empty: one id; a null prompt is none. A null id is kept; repeated rows are packed each on their own; of examples
    with the same dot product the one that waits longest goes first; a very long text is held whole with its ids; an empty table
    gives no rows; names of other columns don't matter.
    """
    path = path or vocabulary_path()
    prompt = F.col(quoted(prompt_col)).cast("string") if prompt_col else F.lit(None).cast("string")
    base = docs.select(internal_id(quoted(id_col)).alias("did"), prompt.alias("prompt"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    ddl = "did long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return base.mapInArrow(lambda it: _pack(it, path, with_ids, limits, cut), ddl)


def op8(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, with_ids=False).select(external_id("did").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
