"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into three blocks. Two fingerprints that differ in at most four bits differ in at most one
bit in some block, so each block is searched with threshold one. In a block the anchors are a covering code: a perfect
Hamming code of length 15 on the first bits, every word on the rest. Its covering radius is one. Each fingerprint has one
home anchor within the radius, and is replicated to every anchor within radius + threshold. If two fingerprints are
close in the block, the second has a copy at the home of the first: comparing homes with copies per anchor finds every link.

A link is tested on all 64 bits. A tile's links are joined at once into a spanning forest, and a task joins the forests of all its
tiles: it hands on an edge from each fingerprint to the smallest that it reaches there. Near copies meet at very many anchors, but
most tasks name the same smallest one, so a group of n gives not many more than n different edges. Anchors with many fingerprints are
split into tiles. Components come from alternating star contractions over edge tables; nothing is collected to the driver.

That is op6. Two texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in 15 % of the bits, which 64 bits can't
tell from unlike texts. near_duplicates() therefore takes fingerprints of 512 bits over the sets, covers 24 blocks of 18 bits by the same
anchors in three rounds, and links at 51 of the first 192 bits what shares an anchor. The groups so joined may hold near copies; the full sets are
compared within each group: a task holds a bounded part of a group, joins links at once into a spanning forest, and so never makes pairs. Groups of several parts share anchors, members that are sent to every
part, so parts that belong together are joined by them; the members that are still outside their group's largest component, the
only ones that can have a link left, then go to every part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, external_id, gathered, internal_id, materialise, quoted, record_batches, scratch_scope, slices
from .textscan import Ranges, mix, range_hashes, words

BITS, THRESHOLD, SHINGLE, SEED = 64, 4, 4, 42
#: (lowest bit, number of bits) of the blocks; each is searched with threshold THRESHOLD // len(BLOCKS).
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE = 15
#: Homes and copies of one tile; comparisons of a tile that are made at once; edges that a task of a round over the graph may have.
TILE, PAIRS, ROUND_ROWS = 4096, 1 << 14, 250_000
#: Edges that a task holds before it joins them, and joined ones before it hands them on and starts anew.
FRESH, HELD = 1 << 17, 1 << 20


class Covering(NamedTuple):
    """What two fingerprints must share to meet and to link."""

    #: (lowest bit, number of bits) of the blocks; none reaches over the end of a 64-bit word.
    blocks: tuple[tuple[int, int], ...]
    #: Differing bits of a block at which two fingerprints are sure to meet.
    reach: int
    #: 64-bit words from the first on that a link is tested on, and the differing bits that a link may have there.
    words: int
    threshold: int


SIMHASH = Covering(BLOCKS, THRESHOLD // len(BLOCKS), 1, THRESHOLD)
#: near_duplicates(): words of a shingle, least similarity, 64-bit words of a fingerprint. At 0.8 a pair of larger sets has no common anchor
#: in 24 blocks once in 18,000 and differs in more than 51 of 192 bits once in 67,000.
NEAR_SHINGLE, SIMILARITY, NEAR_WORDS = 5, 0.8, 8
NEAR = Covering(tuple((64 * w + 18 * i, 18) for w in range(NEAR_WORDS) for i in range(3)), 1, 3, 51)
#: Blocks that are searched at a time: their copies are on disk together.
ROUND_BLOCKS = 8
#: Texts and bytes of shingles that one task compares at once (one longer text is held whole); anchors of a group of several parts.
PART_ROWS, PART_BYTES, ANCHORS = 1024, 8 << 20, 64

_PRINT = pa.schema([("did", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_SKETCH = pa.schema([(name, pa.int64()) for name in ("did", "tag", "fp", "size", *(f"w{i}" for i in range(NEAR_WORDS)))])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of one UTF-8 text: A-Z lower-cased, words by ASCII white space, repeats counted."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    starts = [0, *ends[:-1]]
    k = min(shingle, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[a : a + (1 << 15)], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def _prints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for rows, data, off in slices(batches, "text"):
        buf = data.tobytes()
        prints = [fingerprint(buf[a:b], shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield from record_batches(_PRINT, {"did": rows.column("did"), "tag": rows.column("tag"), "fp": np.array(prints, np.uint64).view(np.int64)})


@lru_cache(maxsize=8)
def _patterns(bits: int, radius: int) -> list[np.ndarray]:
    """By syndrome of the code bits: the differences of up to `radius` bits that lead from a word to an anchor."""
    found: list[list[int]] = [[] for _ in range(CODE + 1)]

    def grow(pattern: int, syndrome: int, low: int, left: int) -> None:
        found[syndrome].append(pattern)
        if left:
            for i in range(low, bits):
                grow(pattern | 1 << i, syndrome ^ (i + 1 if i < CODE else 0), i + 1, left - 1)

    grow(0, 0, 0, radius)
    return [np.array(x, np.int64) for x in found]


def _syndrome(block: np.ndarray) -> np.ndarray:
    s = np.zeros(len(block), np.int64)
    for i in range(CODE):
        s ^= np.where(block >> i & 1, i + 1, 0)
    return s


def home_anchor(block: np.ndarray) -> np.ndarray:
    """The anchor within one bit of each word: the decoded word of the Hamming code, the other bits as they are."""
    s = _syndrome(block)
    return np.where(s > 0, block ^ (1 << np.maximum(s - 1, 0)), block)


def replicas(fp: np.ndarray, cover: Covering = SIMHASH, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor key, is home) of every anchor within covering radius + reach, block by block, for ROUND_BLOCKS from the first on.

    A wide fingerprint is a row of words.
    """
    fp = fp.reshape(len(fp), -1)
    radius = 1 + cover.reach
    for number, (low, bits) in enumerate(cover.blocks[first : first + ROUND_BLOCKS], first):
        block = (fp[:, low // 64] >> np.uint64(low % 64) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s, home = _syndrome(block), home_anchor(block)
        for value, pattern in enumerate(_patterns(bits, radius)):
            rows = np.flatnonzero(s == value)
            if len(rows):
                anchor = block[rows, None] ^ pattern[None, :]
                yield np.repeat(rows, len(pattern)), (anchor | number << 32).ravel(), (anchor == home[rows, None]).ravel()


def _word_names(n: int) -> list[str]:
    return [f"w{i}" for i in range(n)]


def _replicate(batches: Iterator[pa.RecordBatch], cover: Covering, first: int) -> Iterator[pa.RecordBatch]:
    tested = _word_names(cover.words)
    schema = pa.schema([("anchor", pa.int64()), ("home", pa.int64()), ("node", pa.int64()), *((w, pa.int64()) for w in tested)])
    for batch in batches:
        node = np.asarray(batch.column("node"))
        spread = (mix(np.asarray(batch.column("own")).view(np.uint64)) >> np.uint64(48)).astype(np.int64)
        fp = np.stack([np.asarray(batch.column(w)) for w in batch.schema.names if w not in ("node", "own")], axis=1)
        for a in range(0, len(fp), 4096):
            part = fp[a : a + 4096]
            for row, anchor, home in replicas(part.view(np.uint64), cover, first):
                copies = {"anchor": anchor, "home": spread[a : a + 4096][row] << 1 | home, "node": node[a : a + 4096][row]}
                yield from record_batches(schema, copies | {w: part[row, i] for i, w in enumerate(tested)})


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ, with a row of a and b for each word."""
    return np.bitwise_count(a ^ b).sum(axis=0, dtype=np.uint16)


def _forest(h_fp: np.ndarray, h_node: np.ndarray, c_fp: np.ndarray, c_node: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between homes and copies of one tile.

    Each home is compared with every row; of the rows that it links to, one of each component that it is not in yet gives an
    edge, and the components are joined. The comparisons are done in full and the edges stay fewer than the fingerprints.
    """
    h_fp, c_fp = np.atleast_2d(h_fp), np.atleast_2d(c_fp)  # a row for each word
    nodes, place = np.unique(np.concatenate([h_node, c_node]), return_inverse=True)
    h_at, c_at = place[: len(h_node)], place[len(h_node) :]
    label = np.arange(len(nodes))
    of = label[c_at]
    u, v = [], []
    for i in range(len(h_node)):
        mine = label[h_at[i]]
        hit = np.flatnonzero((_differing(c_fp, h_fp[:, i : i + 1]) <= threshold) & (of != mine))
        if not len(hit):
            continue
        others, first = np.unique(of[hit], return_index=True)
        u.append(np.full(len(others), h_node[i]))
        v.append(c_node[hit[first]])
        label[np.isin(label, others)] = mine
        of = label[c_at]
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *u]), np.concatenate([z, *v])


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as (u, v) do: from each node to the smallest that it reaches, if that is another."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _edges(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("u")), np.asarray(batch.column("v"))


def _joined(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars; what it holds meanwhile is bounded."""
    z = np.zeros(0, np.int64)
    held, fresh, n = (z, z), [], 0
    for edges in found:
        fresh.append(edges)
        n += len(edges[0])
        if n < max(FRESH, len(held[0])):
            continue
        held, fresh, n = _stars(*map(np.concatenate, zip(held, *fresh, strict=True))), [], 0
        if len(held[0]) >= HELD:
            yield from record_batches(_EDGE, dict(zip("uv", held, strict=True)))
            held = (z, z)
    held = _stars(*map(np.concatenate, zip(held, *fresh, strict=True)))
    if len(held[0]):
        yield from record_batches(_EDGE, dict(zip("uv", held, strict=True)))


def _compare(batches: Iterator[pa.RecordBatch], cover: Covering) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in order of tile: the links within each tile. Tiles are bounded; small ones are compared together."""

    def work(key: np.ndarray, home: np.ndarray, node: np.ndarray, *words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fp = np.stack(words).view(np.uint64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        homes = np.add.reduceat(home.astype(np.int64), at)
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []
        small = (homes > 0) & (size > 1) & (homes * size <= PAIRS)
        large = (homes > 0) & (size > 1) & ~small
        if small.any():  # every home against its tile's rows, all tiles at once
            tile = np.cumsum(new) - 1
            h = np.flatnonzero(home & small[tile])
            for part in np.array_split(h, max(1, int(size[tile[h]].sum()) >> 18)):
                n = size[tile[part]]
                left = np.repeat(part, n)
                right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[tile[part]], n)
                hit = (_differing(fp[:, left], fp[:, right]) <= cover.threshold) & (node[left] != node[right])
                left, right = left[hit], right[hit]
                many = np.bincount(tile[left], minlength=len(at)) > 2 * size  # mostly near copies: a forest has fewer edges
                large |= many
                few = ~many[tile[left]]
                u.append(node[left[few]])
                v.append(node[right[few]])
        for k in np.flatnonzero(large).tolist():
            s = slice(at[k], at[k] + size[k])
            mine = home[s]
            a, b = _forest(fp[:, s][:, mine], node[s][mine], fp[:, s], node[s], cover.threshold)
            u.append(a)
            v.append(b)
        if u:
            yield np.concatenate(u), np.concatenate(v)

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column("tile")), np.asarray(batch.column("home")) & 1 > 0, np.asarray(batch.column("node"))]
        cols += [np.asarray(batch.column(w)) for w in _word_names(cover.words)]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(held[0]) < 1 << 17:
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield from work(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None:
        yield from work(*held)


def links(nodes: DataFrame, cover: Covering = SIMHASH) -> DataFrame:
    """Edges (u, v) that connect the same nodes as all links between fingerprints that meet do; nodes are node, w0, w1 and so on.

    A round compares many copies of each node in as many tasks as its exchange has; the few edges that come out pass another one, so that
    only the files of its table are as few as the nodes'.

    After the first round a node goes by the name of the smallest that it has an edge to: what is joined already gives no edges again.
    """
    nodes = nodes.withColumn("own", F.col("node"))
    if len(cover.blocks) <= ROUND_BLOCKS:
        return _links(nodes, cover, 0)
    # written round by round, so that one round's copies are on disk at a time
    written = lambda edges: materialise(edges.repartition("u", "v"), "round", nodes)
    rounds = [written(_links(nodes, cover, 0))]
    named = rounds[0].groupBy(F.col("u").alias("own")).agg(F.min("v").alias("name"))
    nodes = materialise(nodes.join(named, "own", "left").withColumn("node", F.coalesce("name", "node")).drop("name"), "named", nodes)
    rounds += [written(_links(nodes, cover, a)) for a in range(ROUND_BLOCKS, len(cover.blocks), ROUND_BLOCKS)]
    return gathered(reduce(DataFrame.unionByName, rounds)).mapInArrow(lambda it: _joined(map(_edges, it)), "u long, v long")


def _links(nodes: DataFrame, cover: Covering, first: int) -> DataFrame:
    """links() over a round of blocks. The lowest bit of `home` says if a copy is at home, the others deal it to a tile."""
    tested = _word_names(cover.words)
    schema = ", ".join(["anchor long", "home long", "node long", *(f"{w} long" for w in tested)])
    copies = nodes.mapInArrow(lambda it: _replicate(it, cover, first), schema)
    load = copies.groupBy("anchor").agg(F.count("*").alias("rows"), F.sum(F.col("home").bitwiseAND(1)).alias("homes"))
    crowded = load.filter(F.col("rows") > TILE).select(
        "anchor", F.ceil(F.col("rows") / TILE).cast("int").alias("columns"), F.greatest(F.ceil(F.col("homes") / TILE), F.lit(1)).cast("int").alias("lines")
    )
    crowded = materialise(crowded, "crowded", nodes)
    compared = lambda rows: rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda it: _joined(_compare(it, cover)), "u long, v long")
    if crowded.isEmpty():
        return compared(copies.select(F.col("anchor").alias("tile"), "home", "node", *tested))
    calm = copies.join(crowded, "anchor", "left_anti").select(F.col("anchor").alias("tile"), "home", "node", *tested)
    wide = copies.join(crowded, "anchor")
    # in a crowded anchor, a line holds some of the homes and a column some of the rows; each tile is a pair of them
    spread = F.shiftright("home", 1)
    line = F.pmod(F.xxhash64(spread), F.col("lines"))
    column = F.pmod(F.xxhash64(spread, F.lit(1)), F.col("columns"))
    as_home = wide.filter("home & 1 = 1").select("*", line.alias("l"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"))
    as_copy = wide.select("*", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("l"), column.alias("c"))
    tile = F.xxhash64("anchor", "l", "c").alias("tile")
    tiled = as_home.select(tile, "home", "node", *tested).unionByName(as_copy.select(tile, F.lit(0).cast("long").alias("home"), "node", *tested))
    return compared(calm.unionByName(tiled))


def _min_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, label: str = "components", source: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that reaches a smaller one.

    Large-star and small-star steps alternate until the edge table is a set of stars. Each step is a grouped minimum
    and a join on the node; each round is written to the shared folder, so a lost executor costs one round at most.
    """
    table = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), label, source)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(table)
    while before[0]:
        few = 1 + before[0] // ROUND_ROWS  # a round over few edges needs few tasks, and files
        # minima are written, so that the joins stand between two exchanges and the edges of a node that has very many can be split
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(_min_of(both).coalesce(few), label)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.coalesce(few), label)
        own = materialise(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few), label)
        small = large.join(own, "u")
        hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialise(hung.unionByName(own.select("u", F.col("m").alias("v"))).distinct().coalesce(few), label)
        for spent in (table, least, large, own):
            discard(spent)
        table = following
        after = state(table)
        if after == before:
            break
        before = after
    return table.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: did, tag (hash of the text), fp (the fingerprint's bits as a signed integer), component, component_tag.

    Fingerprints link at THRESHOLD or fewer differing bits; component is the smallest id reachable over links, component_tag the
    smallest tag of the rows with that id. Nodes are fingerprints, so unlike texts under one id, or under none, are not joined by it.
    A text without words (null, empty, blank) has fingerprint zero and links like any other; a null id ranks last;
    repeated rows share their component; a very long text is one slice; an empty table gives no rows; names of other columns don't matter.
    """
    text = F.col(quoted(text_col)).cast("string")
    base = docs.select(internal_id(quoted(id_col)).alias("did"), F.xxhash64(text).alias("tag"), F.coalesce(text, F.lit("")).alias("text"))
    prints = materialise(base.mapInArrow(lambda it: _prints(it, shingle), "did long, tag long, fp long"), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min(F.struct("did", "tag")).alias("first")), "nodes")
    return _grouped(prints, nodes, links(nodes.select(F.col("fp").alias("node"), F.col("fp").alias("w0"))), docs)


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Of each text of a slice: the sorted hashes of its distinct shingles, A-Z lower-cased; a shorter text is one shingle."""
    start, end, text = words(data, off)
    own = range_hashes(_LOWER[data], start, end)
    windows = Ranges(own).windows(shingle)
    bounds = np.searchsorted(text, np.arange(len(off)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(windows[a : b - shingle + 1] if b - a >= shingle else Ranges(own[a:b]).windows(b - a)[:1] if b > a else own[:0])


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set of hashes, a row of NEAR_WORDS words: a bit is 1 if set in over half the members' hashes of that word."""
    size = np.array([len(x) for x in sets], np.int64)
    ones = np.zeros((len(sets), NEAR_WORDS, 8, 8), np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    filled = np.flatnonzero(size)
    pieces = -(-size[filled] // 255)  # of one set each, so that a byte holds the count of a piece
    of = np.repeat(filled, pieces)
    number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(size) - size)[of] + 255 * number
    end = np.minimum(start + 255, np.cumsum(size)[of])
    low = np.uint64(0x0101010101010101)
    for a in range(0, len(of), 256):
        lo, hi = start[a], end[min(a + 256, len(of)) - 1]
        at = start[a : a + 256] - lo
        new = np.flatnonzero(np.diff(of[a : a + 256], prepend=-1))
        for w in range(NEAR_WORDS):
            own = mix(flat[lo:hi] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            for k in range(8):
                counts = np.add.reduceat(own >> np.uint64(k) & low, at).view(np.uint8).reshape(-1, 8)
                ones[of[a : a + 256][new], w, :, k] += np.add.reduceat(counts, new, axis=0, dtype=np.int64)
    bits = ones.reshape(len(sets), -1) * 2 > size[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for rows, data, off in slices(batches, "text"):
        sets = list(shingle_sets(data, off, shingle))
        fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        prints = set_fingerprints(sets).view(np.int64)
        columns = {"did": rows.column("did"), "tag": rows.column("tag"), "fp": fp, "size": [len(x) for x in sets]}
        yield from record_batches(_SKETCH, columns | {w: np.ascontiguousarray(prints[:, i]) for i, w in enumerate(_word_names(NEAR_WORDS))}, 4096)


def spanning_links(sets: list[np.ndarray], similarity: float, queries: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join the same components as all links between a query and any set do.

    A set in turn is compared with all others. Those of small components come first: once all that have not had
    their turn are in one component, every link between two components has been seen from its other end.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, flat = np.unique(flat, return_inverse=True)
    begin = np.cumsum(size) - size
    filled = size > 0
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    label, waiting, everyone = np.arange(n), queries & filled, bool(queries.all())
    links: list[tuple[int, int]] = []
    while waiting.any():
        open_ = np.flatnonzero(waiting)
        if (label[open_ if everyone else slice(None)] == label[open_[0]]).all():
            break
        i = open_[np.argmin(np.bincount(label, minlength=n)[label[open_]])]
        waiting[i] = False
        own = flat[begin[i] : begin[i] + size[i]]
        mark[own] = True
        shared = np.zeros(n, np.int64)
        shared[filled] = np.add.reduceat(mark[flat], begin[filled], dtype=np.int64)
        mark[own] = False
        hit = np.flatnonzero(filled & (label != label[i]) & (shared + 1e-9 >= similarity * (size + size[i] - shared)))
        if len(hit):
            others, first = np.unique(label[hit], return_index=True)
            links += [(i, j) for j in hit[first].tolist()]
            label[np.isin(label, others)] = label[i]
    return links


def _resolve(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Texts in order of group, part, chunk and fingerprint: the links within each."""
    held: list[tuple[int, bool, np.ndarray]] = []
    place: tuple | None = None
    u: list[int] = []
    v: list[int] = []

    def settle() -> None:
        if len(held) > 1:
            fp = [x[0] for x in held]
            for i, j in spanning_links([x[2] for x in held], similarity, np.array([x[1] for x in held])):
                u.append(fp[i])
                v.append(fp[j])
        held.clear()

    for rows, data, off in slices(batches, "text"):
        columns = [rows.column(c).to_pylist() for c in ("grp", "part", "chunk", "fp", "query")]
        for grp, part, chunk, fp, query, found in zip(*columns, shingle_sets(data, off, shingle), strict=True):
            if (grp, part, chunk) != place:
                settle()
                place = (grp, part, chunk)
            if held and held[-1][0] == fp:  # the same set again: a repeated row, or a query in its own part
                held[-1] = (fp, held[-1][1] or query, held[-1][2])
            else:
                held.append((fp, query, found))
        if u:
            yield from record_batches(_EDGE, {"u": np.array(u, np.int64), "v": np.array(v, np.int64)})
            u.clear()
            v.clear()
    settle()
    if u:
        yield from record_batches(_EDGE, {"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _parts(rows: str, shingles: str) -> Column:
    """How many parts so many texts with so many shingles are dealt into."""
    return F.greatest(F.ceil(F.col(rows) / PART_ROWS), F.ceil(8 * F.col(shingles) / PART_BYTES), F.lit(1)).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: did, tag (hash of the text), fp (hash of the shingle set), component, component_tag.

    Texts link where their sets of shingles have a Jaccard similarity of at least `similarity`. Texts whose fingerprints meet at an anchor
    and are close, directly or through others, are one group, and the links within a group are found on the full sets whatever its
    size: work grows with its square only where it falls into many components. NEAR is set for a similarity of 0.8 and more; a lower one is refused.
    component is the smallest id reachable over links, component_tag the smallest tag of the rows with that id. Texts without words are
    alike; A-Z are lower-cased; a null id ranks last; texts that share an id stay apart; repeated rows share their component; an
    empty table gives no rows.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"fingerprints meet reliably from a similarity of {SIMILARITY} on: {similarity}")
    text = F.col(quoted(text_col)).cast("string")
    base = docs.select(internal_id(quoted(id_col)).alias("did"), F.xxhash64(text).alias("tag"), F.coalesce(text, F.lit("")).alias("text"))
    sketch = ", ".join(f"{name} long" for name in _SKETCH.names)
    rows = materialise(base.mapInArrow(lambda it: _sketches(it, shingle), sketch), "sketches")
    own_words = _word_names(NEAR_WORDS)
    nodes = rows.groupBy("fp").agg(F.min(F.struct("did", "tag")).alias("first"), F.min("size").alias("size"), *(F.min(w).alias(w) for w in own_words))
    nodes = materialise(nodes, "nodes")

    prints = nodes.filter("size > 0").select(F.col("fp").alias("node"), *own_words)
    with scratch_scope() as spent:
        reached = materialise(components(links(prints, NEAR), "meetings", docs), "groups", docs)
    for table in spent:
        if table is not reached:
            discard(table)
    members = reached.select(F.col("node").alias("fp"), F.col("component").alias("grp")).unionByName(reached.select(F.col("component").alias("fp"), F.col("component").alias("grp")).distinct())
    # written, so that the join below stands between two exchanges and a group of very many texts can be split
    sized = materialise(members.join(nodes, "fp").select("fp", "grp", "size", "first.did", "first.tag"), "members", docs)
    load = sized.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).withColumn("parts", _parts("n", "shingles"))
    every = F.greatest(F.floor(F.col("n") / ANCHORS), F.lit(1))
    anchor = (F.col("parts") > 1) & (F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), every) == 0)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = materialise(sized.join(load, "grp").select("fp", "grp", "did", "tag", "size", "parts", own.alias("part"), anchor.alias("anchor")), "places", docs)
    for table in (reached, sized):
        discard(table)

    def links_of(sent: DataFrame) -> DataFrame:
        texts = base.join(sent, ["did", "tag"]).select("grp", "part", "chunk", "fp", "query", "text")
        dealt = texts.repartition("grp", "part", "chunk").sortWithinPartitions("grp", "part", "chunk", "fp")
        return materialise(dealt.mapInArrow(lambda it: _resolve(it, shingle, similarity), "u long, v long"), "links", docs)

    everywhere = F.explode(F.when(F.col("anchor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part")))
    found = links_of(placed.select("fp", "grp", "did", "tag", everywhere.alias("part"), F.lit(0).alias("chunk"), F.lit(True).alias("query")))
    wide = placed.filter("parts > 1")
    if not wide.isEmpty():
        labels = components(found, "labels", docs)
        labelled = wide.join(labels, wide["fp"] == labels["node"], "left").select(*wide.columns, F.coalesce("component", "fp").alias("label"))
        labelled = materialise(labelled, "labelled", docs)
        count = labelled.groupBy("grp", "label").agg(F.count("*").alias("n"))
        largest = count.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("x")).select("grp", F.col("x.label").alias("largest"))
        rest = labelled.join(largest, "grp").filter("label <> largest").drop("label", "largest")
        chunks = rest.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).select("grp", _parts("n", "shingles").alias("chunks"))
        chunks = materialise(chunks, "chunks", docs)
        of_part = wide.join(chunks, "grp").select("fp", "grp", "did", "tag", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("query"))
        asked = rest.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64(F.col("fp"), F.lit(2)), F.col("chunks")).cast("int"))
        asked = asked.select("fp", "grp", "did", "tag", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk", F.lit(True).alias("query"))
        more = links_of(of_part.unionByName(asked))
        for table in (labelled, chunks):
            discard(table)
        found = found.unionByName(more)
    discard(placed)
    return _grouped(rows.select("did", "tag", "fp"), nodes, found, docs)


def _grouped(rows: DataFrame, nodes: DataFrame, edges: DataFrame, source: DataFrame) -> DataFrame:
    """rows (did, tag, fp) with the smallest (did, tag) of their component; nodes (fp, first) hold each fingerprint's smallest."""
    labels = components(edges, source=source).withColumnRenamed("component", "reached")
    rooted = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("reached", "fp").alias("root"))
    # written, both, so that the join stands between two exchanges and a component with very many fingerprints can be split
    rooted = materialise(rooted, "rooted", source)
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("least")), "least", source)
    where = rooted.join(least, "root").select("fp", F.col("least.did").alias("component"), F.col("least.tag").alias("component_tag"))
    return rows.join(where, "fp").select("did", "tag", "fp", "component", "component_tag")


def op6(docs: DataFrame) -> DataFrame:
    return fingerprint_groups(docs).select(
        external_id("did").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), external_id("component").alias("component_id")
    )
