import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import byte_dedup, exact_dedup, simhash, substring_dedup

LAST = 1 << 62


def rank(doc_id):
    return LAST if doc_id is None else doc_id


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: (rank(r[0]), str(r)))


def test_words_are_removed_as_by_brute_force(docs, rows):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, LAST + 1), rank(d))
    want = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < rank(d):
                gone.update(range(i, i + 50))
        want.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert collected(substring_dedup.op1(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=lambda r: (rank(r[0]), str(r)))
    assert sum(r[2] for r in want) > 1000


def test_subtrees_within_a_small_budget(docs, monkeypatch):
    # a budget below a node's size takes the path that carries a node across parts
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 3, (4000, 3)), axis=0)
    keys = keys[np.lexsort(keys.T[::-1])]
    did = np.zeros(len(keys), np.int64)
    for _, at in _groups(keys):
        did[at] = np.sort(rng.integers(0, 50, len(at)))
    more = [[10_000 + i, 20_000 + i] if i % 9 == 0 else [] for i in range(len(keys))]
    batch = pa.RecordBatch.from_arrays(
        [*(pa.array(keys[:, i]) for i in range(3)), pa.array(did), pa.array(np.arange(len(keys))), pa.array(more, pa.list_(pa.int64())), pa.array(np.zeros(len(keys), bool))],
        names=["k0", "k1", "k2", "did", "pos", "more", "settled"],
    )
    results = []
    for budget in (10**6, 64):
        monkeypatch.setattr(substring_dedup, "SUBTREE_ROWS", budget)
        found = set()
        for out in substring_dedup._subtrees(iter([batch.slice(i, 500) for i in range(0, len(keys), 500)])):
            for d, p, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                found.update((d, p + k) for k in range(n))
        results.append(found)
    want = set()
    for _, at in _groups(keys):
        want.update((did[i], p) for i in at if did[i] > did[at[0]] for p in (i, *more[i]))
    assert results[0] == want
    assert results[1] == want


def test_a_common_header_makes_no_hot_prefix(spark):
    """Thousands of documents begin alike and go on differently: their suffixes are dealt by more than the header's words."""
    header = " ".join(f"h{i}" for i in range(40))
    df = spark.createDataFrame([(i, header + " " + " ".join(f"t{i}x{k}" for k in range(30))) for i in range(2000)] + [(5000 + i, header + " same " * 15) for i in range(40)], "doc_id long, text string")
    suffixes = substring_dedup.shared_suffixes(df).filter("NOT settled").groupBy("k0").count().agg({"count": "max", "*": "count"}).first()
    assert suffixes["max(count)"] <= 20 and suffixes["count(1)"] > 2000
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.op1(df).collect()}
    assert {i for i, n in got.items() if n} == {5000 + i for i in range(1, 40)} and got[5001] == 55


def test_many_repeats_within_documents_take_linear_time():
    """160,000 suffixes, all with further places of their own document, all repeated: no array grows row by row."""
    import time

    import pyarrow as pa

    n = 80_000
    keys = np.repeat(np.arange(n), 2)
    did = np.tile([1, 2], n)
    more = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 2), pa.int32()), pa.array(np.arange(4 * n) + 10**6))
    batch = pa.RecordBatch.from_arrays([*(pa.array(keys) for _ in range(3)), pa.array(did), pa.array(np.arange(2 * n)), more, pa.array(np.zeros(2 * n, bool))], names=["k0", "k1", "k2", "did", "pos", "more", "settled"])
    began = time.process_time()
    out = list(substring_dedup._subtrees(iter([batch.slice(i, 10_000) for i in range(0, 2 * n, 10_000)])))
    assert time.process_time() - began < 2
    assert sum(sum(b.column("len").to_pylist()) for b in out) == 3 * n and {d for b in out for d in b.column("did").to_pylist()} == {2}


def _groups(keys):
    groups = {}
    for i, k in enumerate(map(tuple, keys)):
        groups.setdefault(k, []).append(i)
    return groups.items()


def test_bytes_are_removed_as_by_brute_force(docs, rows):
    seen, got = {}, {}
    order = sorted({(rank(d), (t or "").encode()) for d, t, *_ in rows})
    for d, b in order:
        for i in range(len(b) - 99):
            key = b[i : i + 100]
            seen[key] = min(seen.get(key, (LAST + 1, 0)), (d, i))
    for d, b in order:
        cover = bytearray(len(b))
        for i in range(len(b) - 99):
            if seen[b[i : i + 100]] < (d, i):
                cover[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        got[d, b] = (len(b), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), sha(kept))
    want = [(d, *got[rank(d), (t or "").encode()]) for d, t, *_ in rows]
    result = collected(byte_dedup.op2(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert result == sorted(want, key=lambda r: (rank(r[0]), str(r)))


def test_hot_grams_are_dealt_out_by_window(docs, monkeypatch):
    before = collected(byte_dedup.op2(docs), "doc_id", "n_removed", "kept_sha256")
    monkeypatch.setattr(byte_dedup, "HOT_GRAM", 2)
    assert collected(byte_dedup.op2(docs), "doc_id", "n_removed", "kept_sha256") == before


def test_radix_groups_are_the_equal_windows():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 3000, dtype=np.uint8)
    data[1500:1700] = data[200:400]
    at = np.arange(len(data) - 100)
    live, group = byte_dedup.radix_groups(np.zeros(len(at), np.int64), at, np.append(data, np.zeros(7, np.uint8)))
    windows = {}
    for i in at:
        windows.setdefault(data[i : i + 100].tobytes(), []).append(int(i))
    want = {tuple(v) for v in windows.values() if len(v) > 1}
    got = {}
    for i, g in zip(live.tolist(), group.tolist(), strict=True):
        got.setdefault(g, []).append(i)
    assert {tuple(sorted(v)) for v in got.values()} == want


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_components_as_by_brute_force(docs, rows, monkeypatch):
    prints = np.array([fingerprint(t) for _, t, *_ in rows], np.uint64)
    ids = np.array([rank(d) for d, *_ in rows])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = ids.copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want = sorted(((d, f"{int(p):016x}", None if c == LAST else int(c)) for (d, *_), p, c in zip(rows, prints, label, strict=True)), key=lambda r: (rank(r[0]), str(r)))
    assert collected(simhash.op6(docs), "doc_id", "fingerprint", "component_id") == want
    assert (label != ids).sum() > 10
    monkeypatch.setattr(simhash, "TILE", 8)  # crowded anchors
    assert collected(simhash.op6(docs), "doc_id", "fingerprint", "component_id") == want


def test_unlike_texts_under_one_id_or_none_stay_apart(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(4)]
    variants = lambda t: (" ".join(["new"] * n + t.split()[n:]) for n in range(1, 20))
    near = lambda t: next(v for v in variants(t) if 0 < (fingerprint(v) ^ fingerprint(t)).bit_count() <= 4)
    copy, other = near(texts[0]), near(texts[2])
    assert np.bitwise_count(np.uint64(fingerprint(texts[1]) ^ fingerprint(texts[0]))) > 4
    rows = [(None, texts[0]), (None, texts[1]), (5, copy), (7, texts[2]), (7, texts[3]), (6, other)]
    docs = spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["fingerprint"]: r["component_id"] for r in simhash.op6(docs).collect()}
    assert got == {f"{fingerprint(t):016x}": c for t, c in zip([*texts, copy, other], (5, None, 6, 7, 5, 6), strict=True)}
    kept = corpus_pipeline.drop_near(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(None, texts[1]), (5, copy), (7, texts[3]), rows[5]}


def brute_near(ids, texts):
    """The component of every row: texts link at a similarity of 0.8 of their sets of five-word shingles."""
    split = [words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {""} for w in split]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    links = [[j for j, b in enumerate(sets) if near(a, b)] for a in sets]
    label = [rank(d) for d in ids]
    while (new := [min(label[j] for j in x) for x in links]) != label:
        label = new
    return label


def test_near_copies_of_the_pipeline_as_by_brute_force(spark, rows):
    rng = np.random.default_rng(8)
    texts = [t for _, t, *_ in rows]
    for k in range(40):  # copies with a few words changed, on either side of the limit
        w = [f"w{k}x{i}" for i in range(100)]
        texts.append(" ".join(w))
        for i in rng.choice(100, 1 + k % 4, replace=False):
            w[i] = "new"
        texts.append(" ".join(w))
    ids = [*(d for d, *_ in rows), *range(1000, 1080)]
    label = brute_near(ids, texts)
    table = spark.createDataFrame([(d, t) for d, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    got = sorted((min(r["did"], LAST), min(r["component"], LAST)) for r in simhash.near_duplicates(table).collect())
    assert got == sorted((rank(d), c) for d, c in zip(ids, label, strict=True))
    assert sum(label[i] != ids[i] for i in range(len(rows), len(ids))) > 15


def test_groups_of_several_parts_as_by_brute_force(spark, monkeypatch):
    """Chains of near copies, so that no text is like all of its group, in parts of a few texts with one anchor or none."""
    rng = random.Random(3)
    texts = []
    for g in range(6):
        w = [f"g{g}x{i}" for i in range(60)]
        for k in range(25):
            texts.append(" ".join(w))
            w[(k * 17 + g) % 60] = f"n{g}x{k}" if k % 9 else f"far{k}"
            if k % 8 == 7:  # a step that is too far: the group falls into components
                for i in rng.sample(range(60), 12):
                    w[i] = f"m{g}x{k}x{i}"
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [[j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    label = list(range(len(texts)))
    while (new := [min(label[j] for j in x) for x in links]) != label:
        label = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 12 < len(set(label)) < 60
    for rows, size, anchors in ((4, 8 << 20, 1), (3, 900, 1), (2, 8 << 20, 10**9)):
        monkeypatch.setattr(simhash, "PART_ROWS", rows)
        monkeypatch.setattr(simhash, "PART_BYTES", size)
        monkeypatch.setattr(simhash, "ANCHORS", anchors)
        got = {r["did"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
        assert got == dict(enumerate(label))


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(5)
    for trial in range(60):
        sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25))).astype(np.uint64) for _ in range(40)]
        queries = np.ones(40, bool) if trial % 2 else rng.random(40) < 0.3
        near = lambda a, b: len(a) and len(b) and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b))
        every = [(i, j) for i in range(40) for j in range(40) if i != j and (queries[i] or queries[j]) and near(sets[i], sets[j])]
        found = simhash.spanning_links(sets, 0.5, queries)
        assert set(found) <= set(every)
        assert joined(40, found) == joined(40, every)
        assert len(found) < 40


def joined(n, edges):
    label = list(range(n))
    for _ in range(n):
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_forest_joins_what_all_links_join():
    rng = np.random.default_rng(6)
    for _ in range(20):
        fp = rng.integers(0, 1 << 64, 12, dtype=np.uint64).repeat(10)
        for b in range(5):
            fp = fp ^ (rng.integers(0, 2, len(fp)).astype(np.uint64) << rng.integers(0, 64, len(fp)).astype(np.uint64))
        home = rng.random(len(fp)) < 0.5
        node = np.arange(len(fp))
        u, v = simhash._forest(fp[home], node[home], fp, node)
        every = [(i, j) for i in np.flatnonzero(home) for j in node if i != j and (int(fp[i]) ^ int(fp[j])).bit_count() <= 4]
        assert joined(len(fp), list(zip(u.tolist(), v.tolist(), strict=True))) == joined(len(fp), every)
        assert len(u) < len(fp)


@pytest.mark.parametrize("n", [1024, 4096])
def test_periodic_words_are_told_apart(spark, n):
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    b = a.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*around[:30], x, *around[30:]])) for k, x in enumerate((a, b, a))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 61}


def test_texts_under_one_id_or_none(spark):
    """Windows in several texts under one id are no later document's; each text gets its own flags."""
    shared, other = [f"s{i}" for i in range(70)], [f"o{i}" for i in range(60)]
    rows = [(1, " ".join(shared)), (None, " ".join(["x", *shared])), (None, " ".join([*other, "y"])), (None, " ".join([*other, "z"])), (7, " ".join(["p", "q", *shared])), (7, "nothing"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("did", F.lit(9)).withColumn("a.b", F.lit(9))
    want = sorted([(1, 70, 0), (None, 71, 70), (None, 61, 0), (None, 61, 0), (7, 72, 70), (7, 1, 0), (None, 0, 0), (None, 0, 0)], key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.op1(docs).collect()), key=str) == want


def test_every_close_pair_meets_at_a_home():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(0, 1 << 64, dtype=np.uint64)
        y = x
        for b in rng.choice(64, 4, replace=False):
            y = y ^ np.uint64(1 << int(b))
        homes = {int(a) for _, anchor, home in simhash.replicas(np.array([x], np.uint64)) for a, h in zip(anchor, home, strict=True) if h}
        copies = {int(a) for _, anchor, _ in simhash.replicas(np.array([y], np.uint64)) for a in anchor}
        assert len(homes) == 3
        assert homes & copies


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_exact_groups_as_by_brute_force(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = {}
    for (d, *_), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(rank(d))
    want = []
    for (d, *_), n in zip(rows, norm, strict=True):
        keep = min(groups[n])
        want.append((d, None if keep == LAST else keep, len(groups[n]), rank(d) == keep, sha(n)))
    got = collected(exact_dedup.op9(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=lambda r: (rank(r[0]), str(r)))


def test_chunks_follow_content():
    rng = np.random.default_rng(2)
    body = rng.integers(97, 123, 40_000, dtype=np.uint8).tobytes()
    cuts = lambda t: {t[a:b] for a, b in zip([0, *exact_dedup.cut_points(t)[:-1]], exact_dedup.cut_points(t), strict=True)}
    assert b"".join(t for t in [body]) == body
    assert exact_dedup.cut_points(body)[-1] == len(body)
    assert len(cuts(body) & cuts(b"a new head " + body)) > 0.8 * len(cuts(body))


def test_empty_tables(empty):
    for op in (substring_dedup.op1, byte_dedup.op2, simhash.op6, exact_dedup.op9):
        assert op(empty).count() == 0


@pytest.mark.parametrize("budget", [10**6, 60])
@pytest.mark.parametrize("op", [substring_dedup, byte_dedup])
def test_a_task_hands_on_a_shared_passage_once(op, budget, monkeypatch):
    """Slice by slice: what earlier slices of the task have settled is settled at once, unless a smaller document comes."""
    import pyarrow as pa

    monkeypatch.setattr(op, "SUBTREE_ROWS" if op is substring_dedup else "GROUP_WINDOWS", budget)
    passage = " ".join(f"p{i}" for i in range(300))
    ids = [[5, 6], [7, 8, 9], [2, 10], [3, 11]]
    texts = {d: f"{d} {passage} {d}" for x in ids for d in x}

    def batches():
        shared = set()
        for x in ids:
            for out in op._anchors(iter([pa.RecordBatch.from_pydict({"did": x, "tag": [0] * len(x), "text": [texts[d] for d in x]})])):
                shared.update(out.column("h").to_pylist())
        for x in ids:
            columns = {"did": pa.array(x, pa.int64()), "tag": pa.array([0] * len(x), pa.int64()), "text": pa.array([texts[d] for d in x]), "shared": pa.array([sorted(shared)] * len(x), pa.list_(pa.int64())), "hot": pa.array([[]] * len(x), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)

    scan, order = (op._suffixes, ["k0", "k1", "k2", "did"]) if op is substring_dedup else (op._runs, ["h", "bytes", "did", "pos"])
    rows = pa.Table.from_batches(list(scan(batches())))
    if op is substring_dedup:
        handed = {d: n for d, n in zip(*np.unique(np.array(rows.filter(pa.compute.invert(rows["settled"]))["did"]), return_counts=True), strict=True)}
        assert handed[5] > 10 <= handed[2]
        assert all(handed.get(d, 0) <= 4 for d in (7, 8, 9, 10, 3, 11))  # windows with a number of their own
    else:
        size = pa.compute.binary_length(rows["bytes"])
        handed = {d: sum(1 for x, s in zip(rows["did"].to_pylist(), size.to_pylist(), strict=True) if x == d and s) for d in texts}
        assert max(handed[d] for d in (7, 8, 9, 10, 3, 11)) <= 6 < 20 < handed[5]
    table = rows.sort_by([(c, "ascending") for c in order])
    flagged = {d: set() for d in texts}
    for out in (op._subtrees if op is substring_dedup else op._sorted_groups)(iter(table.combine_chunks().to_batches(max_chunksize=7 if budget < 100 else None))):
        for d, p, n in zip(*(out.column(c).to_pylist() for c in ("did", "pos", "len")), strict=True):
            flagged[d].update(range(p, p + n))
    width = 50 if op is substring_dedup else 100
    units = {d: t.split() if op is substring_dedup else t for d, t in texts.items()}
    for d, u in units.items():
        earlier = {tuple(x[i : i + width]) for e, x in units.items() if e < d for i in range(len(x) - width + 1)}
        assert flagged[d] == {i for i in range(len(u) - width + 1) if tuple(u[i : i + width]) in earlier}, d


def near_pair(rng, both, a, b):
    """Two sets of hashes that share `both` members."""
    x = rng.integers(0, 1 << 64, both + a + b, dtype=np.uint64)
    return x[: both + a], np.concatenate([x[:both], x[both + a :]])


def test_wide_fingerprints_as_by_brute_force():
    rng = np.random.default_rng(12)
    sets = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (0, 1, 2, 255, 256, 700, 0, 9)]
    for x, own in zip(sets, simhash.set_fingerprints(sets), strict=True):
        for w in range(simhash.NEAR_WORDS):
            hashes = simhash.mix(x + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).tolist()
            assert int(own[w]) == sum((2 * sum(h >> b & 1 for h in hashes) > len(x)) << b for b in range(64))


def test_sets_at_the_least_similarity_meet_at_a_home_and_link():
    rng = np.random.default_rng(11)
    pairs = [near_pair(rng, 80, *((10, 10) if k % 2 else (20, 0))) for k in range(200)]
    left, right = (simhash.set_fingerprints(list(x)) for x in zip(*pairs, strict=True))
    met = [set(), set()]
    for which, (x, y) in enumerate(((left, right), (right, left))):
        for first in range(0, len(simhash.NEAR.blocks), simhash.ROUND_BLOCKS):
            home, copy = (list(simhash.replicas(z, simhash.NEAR, first)) for z in (x, y))
            homes = {(r, a) for rows, anchors, own in home for r, a, h in zip(rows.tolist(), anchors.tolist(), own.tolist(), strict=True) if h}
            met[which] |= {r for rows, anchors, _ in copy for r, a in zip(rows.tolist(), anchors.tolist(), strict=True) if (r, a) in homes}
    assert met[0] | met[1] == set(range(200))
    far = np.bitwise_count(left[:, :3] ^ right[:, :3]).sum(axis=1)
    assert (far <= simhash.NEAR.threshold).all()
    assert (np.bitwise_count(left[:-1, :3] ^ right[1:, :3]).sum(axis=1) > simhash.NEAR.threshold).all()


def test_near_copies_of_the_pipeline_come_through_fingerprints_and_anchors(spark, monkeypatch):
    """Without a link between fingerprints there is no near copy; crowded anchors change nothing."""
    texts = [f"{k} " + " ".join(f"w{k // 30}x{i}" for i in range(200)) for k in range(60)]
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, "").collect())
    monkeypatch.setattr(simhash, "TILE", 16)
    assert kept() == [0, 30]
    monkeypatch.setattr(simhash, "NEAR", simhash.NEAR._replace(threshold=-1))
    assert kept() == list(range(60))


def test_edges_grow_with_the_nodes_of_a_group(spark):
    """Near copies meet at very many anchors; what is handed on is an edge or two for each of them."""
    rng = np.random.default_rng(13)
    names = [f"w{i}" for i in range(simhash.NEAR_WORDS)]
    for n in (150, 300):
        prints = np.concatenate([rng.integers(0, 1 << 63, (1, simhash.NEAR_WORDS), np.int64).repeat(n, axis=0), rng.integers(0, 1 << 63, (50, simhash.NEAR_WORDS), np.int64)])
        for _ in range(20):
            prints[np.arange(len(prints)), rng.integers(0, simhash.NEAR_WORDS, len(prints))] ^= 1 << rng.integers(0, 63, len(prints))
        near = np.bitwise_count(prints[:, None, :3] ^ prints[None, :, :3]).sum(axis=2) <= simhash.NEAR.threshold
        want = joined(len(prints), np.argwhere(near).tolist())
        assert want == [0] * n + list(range(n, n + 50))
        nodes = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(prints)], f"node long, {', '.join(f'{w} long' for w in names)}").repartition(4)
        edges = [(r["u"], r["v"]) for r in simhash.links(nodes, simhash.NEAR).distinct().collect()]
        assert joined(len(prints), edges) == want
        assert n - 1 <= len(edges) < 2 * n


def test_a_task_joins_what_its_tiles_link(monkeypatch):
    rng = np.random.default_rng(14)
    for fresh, held in ((1 << 17, 1 << 20), (7, 1 << 20), (7, 9), (1, 1)):
        monkeypatch.setattr(simhash, "FRESH", fresh)
        monkeypatch.setattr(simhash, "HELD", held)
        for tiles in (0, 1, 40):
            every = [rng.integers(0, 80, (2, rng.integers(0, 6))) for _ in range(tiles)]
            found = [r for x in simhash._joined((u, v) for u, v in every) for r in zip(x["u"].to_pylist(), x["v"].to_pylist(), strict=True)]
            assert joined(80, found) == joined(80, [e for x in every for e in x.T.tolist()])
            assert all(u > v for u, v in found)
            assert held < 80 or len(found) == sum(k != x for k, x in enumerate(joined(80, found)))


def test_what_a_round_has_joined_gives_no_edges_in_the_next(spark, monkeypatch):
    rng = np.random.default_rng(15)
    prints = rng.integers(0, 1 << 63, (1, simhash.NEAR_WORDS), np.int64).repeat(150, axis=0)
    for _ in range(20):
        prints[np.arange(150), rng.integers(0, simhash.NEAR_WORDS, 150)] ^= 1 << rng.integers(0, 63, 150)
    made, links = [], simhash._links

    def counted(nodes, cover, first):
        made.append(links(nodes, cover, first).count())
        return links(nodes, cover, first)

    monkeypatch.setattr(simhash, "_links", counted)
    names = [f"w{i}" for i in range(simhash.NEAR_WORDS)]
    nodes = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(prints)], f"node long, {', '.join(f'{w} long' for w in names)}")
    edges = [(r["u"], r["v"]) for r in simhash.links(nodes, simhash.NEAR).collect()]
    assert joined(150, edges) == [0] * 150
    assert made[0] >= 149
    assert sum(made[1:]) < 15


def test_a_similarity_that_is_not_covered_is_refused(docs):
    for similarity in (0.79, 0.0, 1.2):
        with pytest.raises(ValueError, match="similarity"):
            simhash.near_duplicates(docs, similarity=similarity)
