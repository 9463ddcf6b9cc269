"""Substring deduplication by prefix-partitioned suffix trees over words.

Suffixes are cut at the threshold depth (50 words), the only depth that decides. The steps:

1. Anchors: every window of 50 words owns the smallest 16-word gram hash in it. Equal windows own equal grams,
   so windows whose gram occurs in one document only are no repeats and never leave their task.
2. The suffixes at the remaining windows are dealt out by a prefix and sorted. Its length varies: 12 words, but all 50 where
   the window's gram has been counted in very many documents (a header that differs in what follows), so that no task
   gets a suffix of each of them. Within a partition prefixes vary further: one whose suffixes fit in the memory budget is one
   subtree, a larger one is split by its next words, down to the threshold depth, where only the running first document is held.
3. A subtree's internal nodes at the threshold depth are the repeats; their leaves in later documents are removed.

Before step 2 each task settles the repeats among the documents of a slice and hands on first occurrences only; windows that a slice
has in several documents are remembered for the task's later slices (up to REMEMBERED of them). So a passage that a third of the
documents hold reaches the partition of its prefix once a task, not once a copy.
Words are compared by two independent 64-bit hashes, prefixes and windows by range hashes over them: 64 bits of the first for the
prefix of 12 words, 32 + 32 bits for the next two levels, and 64 bits of the second for the whole window. The words themselves
are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POSITION, discard, external_id, internal_id, materialise, quoted, record_batches, slices, text_tag, word_pieces
from .textscan import Ranges, flat, merged, mix, range_hashes, sliding_min, words

#: Depth in words of the nodes that count, of the partitioning prefix, and of the further branching levels.
WINDOW, LEVELS = 50, (12, 24, 37, 50)
GRAM = 16
#: Documents that hold a gram from which on windows that own it are dealt by all of their words.
HOT_GRAM = 256
#: Suffixes of one subtree that are held in memory at once.
SUBTREE_ROWS = 200_000
#: Shared windows that a task remembers from slice to slice; beyond them copies are only settled later, in the subtrees.
REMEMBERED = 1 << 18

_ANCHOR = pa.schema([("h", pa.int64()), ("did", pa.int64()), ("tag", pa.int64())])
_SUFFIX = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("did", pa.int64()), ("pos", pa.int64()), ("more", pa.list_(pa.int64())), ("settled", pa.bool_())])
_FLAG = pa.schema([("did", pa.int64()), ("pos", pa.int64()), ("len", pa.int64())])


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return docs.select(internal_id(quoted(id_col)).alias("did"), text_tag(text).alias("tag"), text.alias("text"))


def _word_windows(data: np.ndarray, off: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, Ranges, np.ndarray, np.ndarray]:
    """Of a slice: the words' places, text index and first word of each text, ranges over word hashes, window starts, owned grams."""
    start, end, text = words(data, off)
    first = np.searchsorted(text, np.arange(len(off)))
    seq = Ranges(range_hashes(data, start, end))
    owned = sliding_min(seq.windows(GRAM), WINDOW - GRAM + 1)
    at = np.flatnonzero(text[WINDOW - 1 :] == text[: len(text) - WINDOW + 1]) if len(text) >= WINDOW else np.zeros(0, np.int64)
    return (start, end), text, first, seq, at, owned[at]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off, _ in word_pieces(batches, "text", WINDOW - 1):
        _, text, _, _, at, owned = _word_windows(data, off)
        if not len(at):
            continue
        fresh = np.ones(len(at), bool)
        fresh[1:] = (owned[1:] != owned[:-1]) | (text[at[1:]] != text[at[:-1]])
        of = text[at[fresh]]
        yield from record_batches(_ANCHOR, {"h": owned[fresh].view(np.int64), "did": np.asarray(rows.column("did"))[of], "tag": np.asarray(rows.column("tag"))[of]})


def _among(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x if len(values) else np.zeros(len(x), bool)


class Firsts:
    """Windows that several documents of a task share, each with the smallest id so far, sorted by the last key."""

    def __init__(self) -> None:
        self.rows = np.zeros((0, 4), np.int64)  # k2, k0, k1, did

    def settled(self, k0: np.ndarray, k1: np.ndarray, k2: np.ndarray, did: np.ndarray) -> np.ndarray:
        """Which windows have been seen in a document with a smaller id."""
        if not len(self.rows):
            return np.zeros(len(did), bool)
        at = np.minimum(np.searchsorted(self.rows[:, 0], k2), len(self.rows) - 1)
        known = self.rows[at]
        return (known[:, 0] == k2) & (known[:, 1] == k0) & (known[:, 2] == k1) & (known[:, 3] < did)

    def add(self, k0: np.ndarray, k1: np.ndarray, k2: np.ndarray, did: np.ndarray) -> None:
        if len(self.rows) < REMEMBERED and len(did):
            rows = np.concatenate([self.rows, np.column_stack([k2, k0, k1, did])])
            rows = rows[np.lexsort((rows[:, 3], rows[:, 0]))]
            self.rows = rows[np.append(True, rows[1:, 0] != rows[:-1, 0])]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    firsts = Firsts()
    for rows, data, off, base in word_pieces(batches, "text", WINDOW - 1):
        shared = rows.column("shared")
        values = np.unique(np.asarray(shared.flatten()).view(np.uint64))
        if not len(values):
            continue
        places, text, first, seq, at, owned = _word_windows(data, off)
        at = at[_among(values, owned)]
        if not len(at):
            continue
        hot = _among(np.unique(np.asarray(rows.column("hot").flatten()).view(np.uint64)), owned[_among(values, owned)])
        level = [seq.of(at + a, at + b) for a, b in zip((0, *LEVELS[:-2]), LEVELS[:-1], strict=True)]
        k0 = level[0]
        k1 = (level[1] << np.uint64(32)) | (level[2] >> np.uint64(32))
        k2 = Ranges(range_hashes(data, *places, seed=1)).of(at, at + WINDOW)
        k0 = np.where(hot, mix(k0 ^ mix(k1 ^ mix(k2))), k0)  # a prefix of all words; equal windows own the same gram
        did, tag = np.asarray(rows.column("did"))[text[at]], np.asarray(rows.column("tag"))[text[at]]
        pos = at - first[text[at]] + base + tag
        order = np.lexsort((did, k2, k1, k0))
        k0, k1, k2, did, pos = (x[order] for x in (k0, k1, k2, did, pos))
        new = np.ones(len(k0), bool)
        new[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        settled = did > did[head][group]
        keys = [x[head].view(np.int64) for x in (k0, k1, k2)]
        settled |= firsts.settled(*keys, did[head])[group]
        shared = np.unique(group[settled])
        firsts.add(*(x[shared] for x in keys), did[head][shared])
        # a window that its own document repeats travels once, with its other places
        own = new.copy()
        own[1:] |= (did[1:] != did[:-1]) | settled[1:]
        at = np.flatnonzero(own)
        ends = np.append(at[1:], len(own)) - at - 1
        more = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32), pa.array(pos[~own]))
        k0, k1, k2, did, pos, settled = (x[at] for x in (k0, k1, k2, did, pos, settled))
        # what is settled passes the exchange dealt by its own place, not by its prefix
        k0 = np.where(settled, mix(did.view(np.uint64) * np.uint64(31) + pos.view(np.uint64)), k0)
        yield from record_batches(_SUFFIX, {"k0": k0.view(np.int64), "k1": k1.view(np.int64), "k2": k2.view(np.int64), "did": did, "pos": pos, "more": more, "settled": settled})


def _to_runs(did: np.ndarray, pos: np.ndarray) -> dict:
    order = np.lexsort((pos, did))
    did, pos = did[order], pos[order]
    new = np.ones(len(did), bool)
    new[1:] = (did[1:] != did[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(did)) - 1
    return {"did": did[at], "pos": pos[at], "len": pos[last] - pos[at] + 1} if len(did) else {"did": did, "pos": pos, "len": pos}


class Subtree:
    """Suffixes that share a prefix, sorted; internal nodes are runs of suffixes that agree down to a level."""

    def __init__(self, keys: np.ndarray, did: np.ndarray, pos: np.ndarray):
        self.keys, self.did, self.pos = keys, did, pos
        differ = keys[1:] != keys[:-1]
        self.agree = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])])

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(first leaf, last leaf + 1) of the internal nodes with at least `level` levels in common."""
        at = np.flatnonzero(self.agree < level)
        to = np.append(at[1:], len(self.did))
        inner = to - at > 1
        return at[inner], to[inner]

    def repeats(self) -> np.ndarray:
        """Leaves of the nodes at full depth that lie in a later document than the node's first leaf."""
        at, to = self.nodes(self.keys.shape[1])
        later = np.zeros(len(self.did), bool)
        if len(at):
            leaf = np.zeros(len(self.did) + 1, np.int64)
            leaf[at] += 1
            leaf[to] -= 1
            inside = np.cumsum(leaf[:-1]) > 0
            head = np.maximum.accumulate(np.where(np.isin(np.arange(len(self.did)), at), np.arange(len(self.did)), 0))
            later = inside & (self.did > self.did[head])
        return later


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by prefix, words and document: subtree by subtree, each within the memory budget."""
    held = np.zeros((0, 7), np.int64)  # keys, document, place, and where its further places are: start and number
    places = np.zeros(0, np.int64)
    carry: tuple | None = None  # window and first document of a node that went on past the budget

    def emit(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree = Subtree(part[:, :3], part[:, 3], part[:, 4])
        later = tree.repeats()
        if carry is not None:
            later |= (part[:, :3] == carry[0]).all(axis=1) & (part[:, 3] > carry[1])
        if later.any():
            did, pos, start, size = part[later, 3], part[later, 4], part[later, 5], part[later, 6]
            yield from record_batches(_FLAG, _to_runs(np.concatenate([did, np.repeat(did, size)]), np.concatenate([pos, flat(places, start, size)])))

    def without_spent() -> np.ndarray:
        """The further places of the rows that are held; those of rows that are gone are let go."""
        kept = flat(places, held[:, 5], held[:, 6])
        held[:, 5] = np.cumsum(held[:, 6]) - held[:, 6]
        return kept

    for batch in batches:
        if not batch.num_rows:
            continue
        settled = np.asarray(batch.column("settled").to_numpy(zero_copy_only=False), bool)
        more = batch.column("more")
        size = np.asarray(more.value_lengths()).astype(np.int64)
        rows = np.column_stack([np.asarray(batch.column(c)) for c in ("k0", "k1", "k2", "did", "pos")] + [len(places) + np.cumsum(size) - size, size])
        places = np.concatenate([places, np.asarray(more.flatten())])
        if settled.any():
            did, extra = rows[settled, 3], rows[settled, 6]
            yield from record_batches(_FLAG, _to_runs(np.concatenate([did, np.repeat(did, extra)]), np.concatenate([rows[settled, 4], flat(places, rows[settled, 5], extra)])))
            rows = rows[~settled]
        held = np.concatenate([held, rows])
        while len(held) > SUBTREE_ROWS:
            cut = 0
            for depth in (1, 2, 3):  # the shortest prefix whose last subtree leaves something complete behind
                change = np.flatnonzero((held[1:, :depth] != held[:-1, :depth]).any(axis=1))
                if len(change):
                    cut = int(change[-1]) + 1
                    break
            if cut:
                yield from emit(held[:cut])
                held, carry = held[cut:], None
                if len(held) <= SUBTREE_ROWS:
                    break
            else:
                yield from emit(held)
                first = carry[1] if carry is not None and (held[0, :3] == carry[0]).all() else held[0, 3]
                carry, held = (held[-1, :3].copy(), first), held[:0]
        if len(places) > 2 * int(held[:, 6].sum()) + SUBTREE_ROWS:
            places = without_spent()
    if len(held):
        yield from emit(held)


_CUT = pa.schema([("did", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in slices(batches, "text"):
        buf = data.tobytes()
        out: dict[str, list] = {f.name: [] for f in _CUT}
        for i, did in enumerate(rows.column("did").to_pylist()):
            parts = buf[off[i] : off[i + 1]].split()
            flags = rows.column("flags")[i].as_py()
            spans: list[dict] = []
            kept, removed = parts, 0
            if flags:
                at = np.array([x["pos"] & POSITION for x in flags], np.int64)
                a, b = merged(at, at + np.array([x["len"] for x in flags], np.int64) + WINDOW - 1)
                spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                kept, last = [], 0
                for s in spans:
                    kept += parts[last : s["start"]]
                    last = s["end"]
                    removed += s["end"] - s["start"]
                kept += parts[last:]
            for name, value in zip(out, (did, len(parts), removed, spans, b" ".join(kept).decode("utf-8", "replace")), strict=True):
                out[name].append(value)
        yield from record_batches(_CUT, out, 2048)


def shared_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k0, k1, k2, did, pos, more, settled): the suffixes at windows whose gram several documents have, k0 being the prefix that they are dealt by."""
    base = _base(docs, id_col, text_col)
    anchors = materialise(base.mapInArrow(_anchors, "h long, did long, tag long"), "anchors", compression="zstd")
    # written, so that the join stands between two exchanges and a gram of very many documents can be split
    shared = materialise(anchors.groupBy("h").agg(F.min("did").alias("a"), F.max("did").alias("b"), F.count("*").alias("n")).filter("a < b").select("h", (F.col("n") >= HOT_GRAM).alias("hot")), "grams", docs)
    of_doc = (F.collect_set("h").alias("shared"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    lists = materialise(anchors.join(shared, "h").groupBy("did", "tag").agg(*of_doc), "shared", docs)
    discard(anchors)
    discard(shared)
    return base.join(lists, ["did", "tag"]).mapInArrow(_suffixes, "k0 long, k1 long, k2 long, did long, pos long, more array<long>, settled boolean")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, pos, len): runs of window starts, in words, whose windows also start in a document with a smaller id."""
    dealt = shared_suffixes(docs, id_col, text_col).repartition("k0").sortWithinPartitions("k0", "k1", "k2", "did")
    return dealt.mapInArrow(_subtrees, "did long, pos long, len long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: did, n_words, n_removed, removed (word spans), kept_text.

    Every word covered by a 50-word window whose sequence also starts in a document with a smaller id is removed.
    A null or empty text has no words; a null id ranks last, and a window in several texts without id stays in all of them, as does
    one in several texts under one id; rows with the same id and text count as one document and get the same result. Texts
    under one id are told apart by 33 bits of their hash. A text of more than a slice's 4 MB is scanned in pieces of whole words, but cut
    as a whole: memory follows the longest text's words. An empty table gives no rows; names of other columns don't matter.
    """
    flags = materialise(repeated_windows(docs, id_col, text_col), "repeats", docs, compression="zstd")
    tag = F.col("pos").bitwiseAND(F.lit(~POSITION)).alias("tag")
    per_doc = flags.groupBy("did", tag).agg(F.collect_list(F.struct("pos", "len")).alias("flags"))
    rows = _base(docs, id_col, text_col).join(per_doc, ["did", "tag"], "left")
    return rows.mapInArrow(_remove, "did long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")


def op1(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(external_id("did").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS s, ws FROM w WHERE len(ws) >= 50
), win AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN firsts USING (h) WHERE doc_id > first
), positions AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS body, count(*) AS n
  FROM positions p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
