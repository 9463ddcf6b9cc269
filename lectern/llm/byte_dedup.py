"""Byte-level substring deduplication by a depth-limited radix sort of suffixes.

Every 100-byte window is a suffix cut at the threshold depth. Its most significant digit is the leftmost 32-byte
gram with the smallest hash in it: equal windows own equal grams, so the first pass deals windows into groups, and
windows whose gram is owned in one place only end there. Windows that stand next to each other and own the same
place travel as one run with the bytes around them. Within a group, further most-significant-digit passes of eight
bytes split the windows until they differ or the depth is reached; groups that are left are exactly the repeats.

Runs with equal bytes need no passes against each other: all but the first are removed whole. Each task does so
among its own texts before the exchange, within a slice and against REMEMBERED runs of its earlier slices, so a hot passage arrives
once a task, not once a copy. Hashes only deal windows out: what is removed has been compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POSITION, byte_pieces, discard, external_id, internal_id, materialise, quoted, raw_bytes, record_batches, slices, text_tag
from .textscan import Ranges, byte_table, flat, merged, mix, sliding_min, unequal

#: Threshold depth and gram length in bytes; bytes a radix pass looks at; low bits that hold a place in a slice.
WINDOW, GRAM, DIGIT, PLACE = 100, 32, 8, (1 << 30) - 1
#: Windows that are sorted in memory at once, and owned places of a gram beyond which its windows are dealt out one by one.
GROUP_WINDOWS, HOT_GRAM = 500_000, 20_000
#: Repeated runs that a task remembers from slice to slice; beyond them copies are only settled after the exchange.
REMEMBERED = 1 << 16

_ANCHOR = pa.schema([("h", pa.int64()), ("did", pa.int64()), ("tag", pa.int64()), ("n", pa.int64())])
_RUN = pa.schema([("h", pa.int64()), ("did", pa.int64()), ("pos", pa.int64()), ("len", pa.int32()), ("bytes", pa.binary())])
_FLAG = pa.schema([("did", pa.int64()), ("pos", pa.int64()), ("len", pa.int64())])


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return docs.select(internal_id(quoted(id_col)).alias("did"), text_tag(text).alias("tag"), text.alias("text"))


def _byte_windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, gram) of the runs of windows of one text that own the same place.

    A window owns the leftmost of its grams with the smallest leading hash bits, which its bytes alone decide. So
    equal windows own equal grams at equal offsets, and two windows of one run never equal each other.
    """
    if len(data) < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64)
    gram = Ranges(data, byte_table(2)).windows(GRAM)
    owned = gram & ~np.uint64(PLACE)
    owned |= np.arange(len(gram), dtype=np.uint64)
    owned = sliding_min(owned, WINDOW - GRAM + 1)
    owned &= np.uint64(PLACE)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[off[1:-1]] = 1
    crossed = np.cumsum(edge, dtype=np.int32)
    inside = crossed[WINDOW - 1 : len(data)] == crossed[: len(data) - WINDOW + 1]
    change = owned[1:] != owned[:-1]
    new = inside.copy()
    new[1:] &= change | ~inside[:-1] | (edge[1 : len(owned)] == 1)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    start, last = np.flatnonzero(new), np.flatnonzero(stop)
    return start, last - start + 1, gram[owned[start].astype(np.int64)]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams that each text owns, and in how many places."""
    for rows, data, off, _ in byte_pieces(batches, "text", WINDOW - 1):
        start, _, owned = _byte_windows(data, off)
        if not len(start):
            continue
        of = np.searchsorted(off, start, side="right") - 1
        order = np.lexsort((owned, of))
        of, owned = of[order], owned[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (owned[1:] != owned[:-1])
        at = np.flatnonzero(new)
        of, owned, n = of[at], owned[at], np.diff(np.append(at, len(new)))
        yield from record_batches(_ANCHOR, {"h": owned.view(np.int64), "did": np.asarray(rows.column("did"))[of], "tag": np.asarray(rows.column("tag"))[of], "n": n})


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The runs' bytes as a binary array."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat(data, start, size)))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs with a shared gram; those that are settled have no bytes and a place of their own as key."""
    firsts: dict[tuple[int, int], tuple[int, int, bytes]] = {}  # by gram and hash of the run: smallest id and place, bytes
    known = np.zeros(0, np.uint64)
    for rows, data, off, base in byte_pieces(batches, "text", WINDOW - 1):
        values = np.unique(np.asarray(rows.column("shared").flatten()).view(np.uint64))
        if not len(values):
            continue
        start, n, owned = _byte_windows(data, off)
        hit = values[np.minimum(np.searchsorted(values, owned), len(values) - 1)] == owned
        start, n, owned = start[hit], n[hit], owned[hit]
        if not len(start):
            continue
        hot = np.unique(np.asarray(rows.column("hot").flatten()).view(np.uint64))
        if len(hot) and (burst := np.isin(owned, hot)).any():  # the windows' further digits become part of the key
            b, m = start[burst], n[burst]
            at = np.repeat(b, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            start = np.concatenate([start[~burst], at])
            owned = np.concatenate([owned[~burst], Ranges(data, byte_table(4)).of(at, at + WINDOW)])
            n = np.concatenate([n[~burst], np.ones(len(at), n.dtype)])
        of = np.searchsorted(off, start, side="right") - 1
        did, tag = np.asarray(rows.column("did"))[of], np.asarray(rows.column("tag"))[of]
        pos = start - off[of] + base
        whole = Ranges(data, byte_table(3)).of(start, start + n + WINDOW - 1)
        order = np.lexsort((pos, did, n, whole, owned))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (owned[a] != owned[b]) | (whole[a] != whole[b]) | (n[a] != n[b])
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        settled = np.zeros(len(order), bool)
        settled[order] = (did[order] > did[head]) | (did[order] == did[head]) & (pos[order] > pos[head])
        first = np.empty(len(order), np.int64)
        first[order] = head
        gone = np.flatnonzero(settled)
        settled[gone[unequal(data, start[gone], start[first[gone]], n[gone] + WINDOW - 1)]] = False
        heads = np.unique(head)
        maybe = heads[np.isin(whole[heads], known)]
        gone_heads = set()
        for i in maybe.tolist():
            before = firsts.get((int(owned[i]), int(whole[i])))
            if before and before[:2] < (int(did[i]), int(pos[i])) and before[2] == data[start[i] : start[i] + n[i] + WINDOW - 1].tobytes():
                gone_heads.add(i)
        if gone_heads:  # their copies have been compared with them
            settled |= np.isin(first, np.fromiter(gone_heads, np.int64)) & (settled | (first == np.arange(len(first))))
        for i in np.setdiff1d(first[settled], np.fromiter(gone_heads, np.int64, len(gone_heads))).tolist():
            place = (int(owned[i]), int(whole[i]))
            before = firsts.get(place)
            if len(firsts) < REMEMBERED if before is None else before[:2] > (int(did[i]), int(pos[i])):
                firsts[place] = (int(did[i]), int(pos[i]), data[start[i] : start[i] + n[i] + WINDOW - 1].tobytes())
        if len(firsts) > len(known):
            known = np.unique(np.fromiter((k[1] for k in firsts), np.uint64, len(firsts)))
        key = np.where(settled, mix(did.view(np.uint64) * np.uint64(31) + pos.view(np.uint64)), owned)
        size = np.where(settled, 0, n + WINDOW - 1)
        for lo in range(0, len(start), 4096):
            s = slice(lo, lo + 4096)
            yield from record_batches(
                _RUN, {"h": key[s].view(np.int64), "did": did[s], "pos": pos[s] + tag[s], "len": n[s].astype(np.int32), "bytes": _gather(data, start[s], size[s])}
            )


def radix_groups(group: np.ndarray, at: np.ndarray, data: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(suffix index, group) of the suffixes data[at : at + depth] that equal another one of their group.

    Most-significant-digit passes of eight bytes; a suffix that is alone in its group leaves at once.
    data needs seven spare bytes at its end.
    """
    digits = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    live = np.arange(len(at))
    for a in [*range(0, depth - DIGIT, DIGIT), depth - DIGIT, None]:
        if a is None:
            break
        digit = digits[at[live] + a].astype(np.uint64)
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new)
        stay = np.bincount(group)[group] > 1
        live, group = live[stay], group[stay]
        if not len(live):
            break
    return live, group


def _later_windows(h: np.ndarray, did: np.ndarray, pos: np.ndarray, n: np.ndarray, begin: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of the windows that also start earlier; runs with the same h may share windows."""
    total = int(n.sum())
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    live, group = radix_groups(h[run], begin[run] + step, data)
    if not len(live):
        return live, live
    place = (pos[run] & POSITION) + step
    order = np.lexsort((place[live], did[run[live]], group))
    live, group = live[order], group[order]
    new = np.ones(len(live), bool)
    new[1:] = group[1:] != group[:-1]
    head = live[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = (did[run[live]] > did[run[head]]) | (place[live] > place[head])
    hit = np.sort(live[later])
    return run[hit], step[hit]


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of gram, bytes, document and place: repeats as runs of window starts.

    Of runs with equal bytes only the first is held, so a group holds at most HOT_GRAM different byte strings.
    """
    held: list[tuple[np.ndarray, ...]] = []  # gram, document, place, windows, size, bytes of the runs that wait
    windows = 0
    last: tuple[int, bytes] | None = None  # gram and bytes of the run before

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, did, pos, n, size, data = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        run, step = _later_windows(h, did, pos, n, np.cumsum(size) - size, np.concatenate([data, np.zeros(7, np.uint8)]))
        if len(run):
            new = np.ones(len(run), bool)
            new[1:] = (run[1:] != run[:-1]) | (step[1:] != step[:-1] + 1)
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(run))
            yield from record_batches(_FLAG, {"did": did[run[at]], "pos": pos[run[at]] + step[at], "len": end - at})

    for batch in batches:
        h, did, pos, n = (np.asarray(batch.column(c)).astype(np.int64) for c in ("h", "did", "pos", "len"))
        data, off = raw_bytes(batch.column("bytes"))
        size = np.diff(off)
        full = np.flatnonzero(size > 0)
        new = np.ones(len(full), bool)
        fresh = np.ones(len(full), bool)  # of another gram than the run before
        if len(full):
            a, b = full[1:], full[:-1]
            fresh[1:] = h[a] != h[b]
            maybe = np.flatnonzero(~fresh[1:] & (size[a] == size[b]))
            new[1 + maybe] = False
            new[1 + maybe[unequal(data, off[a[maybe]], off[b[maybe]], size[a[maybe]])]] = True
            if last is not None and h[full[0]] == last[0]:
                fresh[0] = False
                new[0] = data[off[full[0]] : off[full[0] + 1]].tobytes() != last[1]
            last = (int(h[full[-1]]), data[off[full[-1]] : off[full[-1] + 1]].tobytes())
        gone = np.ones(len(h), bool)
        gone[full[new]] = False
        if gone.any():
            yield from record_batches(_FLAG, {"did": did[gone], "pos": pos[gone], "len": n[gone]})
        # a group is complete where the gram changes; a run that is gone is of the gram of the one before it
        kept, fresh = full[new], fresh[new]
        at = 0
        while at < len(kept):
            upto = windows + np.cumsum(n[kept[at:]])
            full_at = np.flatnonzero((upto - n[kept[at:]] >= GROUP_WINDOWS) & fresh[at:])
            end = at + int(full_at[0]) if len(full_at) else len(kept)
            part = kept[at:end]
            if len(part):
                held.append((h[part], did[part], pos[part], n[part], size[part], flat(data, off[part], size[part])))
            windows = int(upto[end - at - 1]) if end > at else windows
            if len(full_at):
                yield from flush()
                windows = 0
            at = end
    yield from flush()


_CUT = pa.schema([("did", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in slices(batches, "text"):
        buf = data.tobytes()
        out: dict[str, list] = {f.name: [] for f in _CUT}
        for i, did in enumerate(rows.column("did").to_pylist()):
            text = kept = buf[off[i] : off[i + 1]]
            flags = rows.column("flags")[i].as_py()
            spans: list[dict] = []
            if flags:
                at = np.array([x["pos"] & POSITION for x in flags], np.int64)
                a, b = merged(at, at + np.array([x["len"] for x in flags], np.int64) + WINDOW - 1)
                spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
            for name, value in zip(out, (did, len(text), len(text) - len(kept), spans, kept), strict=True):
                out[name].append(value)
        yield from record_batches(_CUT, out, 2048)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, pos, len): runs of window starts, in bytes, whose 100-byte windows also start earlier."""
    base = _base(docs, id_col, text_col)
    anchors = materialise(base.mapInArrow(_anchors, "h long, did long, tag long, n long"), "grams", compression="zstd")
    # written, so that the join stands between two exchanges and a gram of very many texts can be split
    shared = materialise(anchors.groupBy("h").agg(F.sum("n").alias("count")).filter("count > 1"), "counts", docs)
    own = [F.collect_set("h").alias("shared"), F.collect_set(F.when(F.col("count") > HOT_GRAM, F.col("h"))).alias("hot")]
    lists = materialise(anchors.join(shared, "h").groupBy("did", "tag").agg(*own), "shared", docs)
    discard(anchors)
    discard(shared)
    found = base.join(lists, ["did", "tag"]).mapInArrow(_runs, "h long, did long, pos long, len int, bytes binary")
    return found.repartition("h").sortWithinPartitions("h", "bytes", "did", "pos").mapInArrow(_sorted_groups, "did long, pos long, len long")


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: did, n_bytes, n_removed, removed (byte spans), kept (the bytes that are left).

    Every byte covered by a 100-byte string that also starts earlier (in a document with a smaller id, or in the same
    document at a smaller offset) is removed. A null text is empty; a null id ranks last; rows with the same id and text
    count as one document and get the same result; other texts under one id, which 33 bits of their hash tell apart, come in the order
    of places. A text of more than a slice's 4 MB is scanned in overlapping pieces. An empty table gives no rows; names of
    other columns don't matter. What is left may not be valid UTF-8.
    """
    flags = materialise(repeated_bytes(docs, id_col, text_col), "repeats", docs, compression="zstd")
    tag = F.col("pos").bitwiseAND(F.lit(~POSITION)).alias("tag")
    per_doc = flags.groupBy("did", tag).agg(F.collect_list(F.struct("pos", "len")).alias("flags"))
    rows = _base(docs, id_col, text_col).join(per_doc, ["did", "tag"], "left")
    return rows.mapInArrow(_remove, "did long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def op2(docs: DataFrame) -> DataFrame:
    return remove_repeated_bytes(docs).select(
        external_id("did").alias("doc_id"), "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), win AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM t WHERE n >= 100)
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM win
), gone AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM ranked WHERE k > 1
), numbered AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM gone
), spans AS (
  SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans
), kept AS (
  SELECT p.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS front
  FROM pieces p JOIN t ON t.doc_id = p.doc_id GROUP BY p.doc_id
)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
