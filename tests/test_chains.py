"""Chains, tracks, frontiers and scans against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.operators import chains, geometry, scroll, temporal, tracks


def test_roots_of_long_chains(spark):
    rng = random.Random(1)
    before, root, node = {}, {}, 0
    for size in (1, 1, 2, 3, 16, 130):
        start = node
        for i in range(size):
            before[node], root[node] = (node - 1 if i else None), start
            node += 1
    data = list(before.items())
    rng.shuffle(data)
    df = spark.createDataFrame([*data, (9001, 9000)], "node int, before int")
    got = {r["node"]: r["root"] for r in chains.roots(df, "node", "before").collect()}
    assert got == root | {9001: 9000}


def kept_by_hand(values, gap):
    out = []
    for v in sorted({v for v in values if v is not None}):
        if not out or gap is not None and v >= out[-1] + gap:
            out.append(v)
    return out


def test_last_kept_equals_a_loop(spark):
    rng = random.Random(2)
    data, want = [], []
    for doc in range(12):
        gap = rng.choice([0.0, 0.5, 3.0, 17.0, None])
        values = [None if rng.random() < 0.05 else rng.randint(0, 4 * 60) / 4 for _ in range(rng.choice([1, 2, 40, 200]))]
        data += [(doc, v, gap) for v in values]
        want += [(doc, v) for v in kept_by_hand(values, gap)]
    df = spark.createDataFrame(data, "doc int, v double, gap double")
    assert sorted(tuple(r) for r in chains.last_kept(df, ["doc"], "v", "gap").collect()) == sorted(want)
    assert chains.last_kept(df.limit(0), ["doc"], "v", "gap").collect() == []


def test_last_kept_of_one_long_document(spark):
    """All in one key: a chain of two thousand is followed in rounds, not collected."""
    df = spark.range(8_000).select(F.lit(1).alias("doc"), (F.col("id") * 0.25).alias("v"), F.lit(1.0).alias("gap"))
    got = chains.last_kept(df, ["doc"], "v", "gap")
    assert got.agg(F.count("*"), F.sum("v")).first()[:] == (2_000, sum(range(2_000)))


def test_reading_order_equals_a_loop(spark):
    rng = random.Random(3)
    lines = [(doc, i, rng.randint(0, 160) / 2, rng.choice([8.0, 12.0, 16.0])) for doc in range(5) for i in range(25)]
    words = [(doc, i, w, rng.randint(0, 90) / 2, rng.randint(0, 160) / 2) for doc in range(5) for i in range(25) for w in range(3)]
    line_df = spark.createDataFrame(lines, "doc int, line_idx int, top double, h double").select("doc", "line_idx", S.bbox(F.lit(0), "top", F.lit(9), F.col("top") + F.col("h")).alias("bbox"))
    word_df = spark.createDataFrame(words, "doc int, line_idx int, word_idx int, x double, y double").select("doc", "line_idx", "word_idx", S.bbox("x", "y", F.col("x") + 2, F.col("y") + 6).alias("bbox"))
    got = {(r["doc"], r["line_idx"], r["word_idx"]): r["reading_idx"] for r in geometry.reading_order(word_df, line_df, ["doc"]).collect()}
    for doc in range(5):
        heights = sorted(h for d, _, _, h in lines if d == doc)
        centres = kept_by_hand([t + h / 2 for d, _, t, h in lines if d == doc], heights[len(heights) // 2] / 2)
        mine = sorted((min((abs(c - (y + 3)), c) for c in centres)[1], x + 1, i, w) for d, i, w, x, y in words if d == doc)
        assert [got[doc, i, w] for _, _, i, w in mine] == list(range(75))


def test_cutoffs_equal_a_loop(spark):
    rng = random.Random(4)
    for size, top, parts in ((1, 1, 4), (50, 5, 4), (3000, 2000, 7), (400, 3, 10)):
        values = [rng.randint(0, top) for _ in range(size)]
        run, want = 0, []
        for v, n in sorted(Counter(values).items()):
            run += n
            if run >= size / parts:
                want.append(float(v))
                run = 0
        df = spark.createDataFrame([(v,) for v in values], "v int")
        assert geometry.equal_mass_cutoffs(df, "v", parts).first()[0] == want
    assert geometry.equal_mass_cutoffs(df.limit(0), "v", 4).first()[0] == []


def test_cutoffs_of_many_distinct_values(spark):
    assert geometry.equal_mass_cutoffs(spark.range(1_000_000).withColumnRenamed("id", "v"), "v", 4).first()[0] == [249_999.0, 499_999.0, 749_999.0, 999_999.0]


@pytest.mark.parametrize("normalise", [False, True])
def test_stitching_is_a_running_product(spark, normalise):
    """A page of a hundred thousand lines, against the recurrence line by line; one page with a gap, one with a line of no height."""
    rng = random.Random(5)
    n = 100_000
    high = [rng.randint(10, 20) + 0.5 for _ in range(n)]  # each frame shows a line and the one before it, zoomed and moved
    zoom = [(rng.choice([0.5, 1.0, 1.5]), rng.randint(-50, 50) + 0.25) for _ in range(n)]
    made = [("long", i, y, y + z * high[i - 1], y + 30 * z, y + 30 * z + z * high[i]) for i, (z, y) in enumerate(zoom)]
    made += [("gap", i, 0.0, 10.0, 20.0, 30.0) for i in range(6) if i != 3] + [("flat", i, 0.0, 10.0, 20.0, 20.0 if i == 2 else 32.0) for i in range(6)]
    refs = spark.createDataFrame([(p, i) for p, size in (("long", n), ("gap", 6), ("flat", 6)) for i in range(size)], "doc_name string, line_idx int").withColumn("line", F.concat(F.lit("line "), "line_idx"))
    df = spark.createDataFrame(made, "doc_name string, ref_idx int, pt double, pb double, t double, b double").withColumn("s", F.col("doc_name"))
    first = F.col("ref_idx") == 0
    adjacent = df.select("s", "doc_name", "ref_idx", S.bbox(F.lit(0), "t", F.lit(9), "b").alias("bbox"), F.when(~first, S.bbox(F.lit(0), "pt", F.lit(9), "pb")).alias("prev"))
    got = defaultdict(list)
    for r in scroll.stitched_lines(adjacent, refs, ["s"], normalise=normalise).orderBy("line_idx").collect():
        got[r["doc_name"]].append((r["top"], r["bottom"]))
    by = defaultdict(dict)
    for p, i, *sides in made:
        by[p][i] = sides
    for p, rows in got.items():
        top = h = None
        for i, (a, b) in enumerate(rows):
            if i == 0:
                top, h = by[p][0][2], by[p][0][3] - by[p][0][2]
            elif top is not None and i in by[p] and (normalise or h):
                pt, pb, t, b_ = by[p][i]
                f = h / (pb - pt) if normalise else (pb - pt) / h
                top, h = top + (t - pt) * f, (b_ - t) * f
            else:
                top = None
            if top is None:
                assert a is None and b is None, (p, i)
            else:
                assert a == pytest.approx(top, rel=1e-9) and b == pytest.approx(top + h, rel=1e-9), (p, i)


def test_frontier_finds_what_bisection_finds(spark):
    """All sessions at once: the same changes, every tick asked once, as many rounds as the longest span has halvings."""
    rng = random.Random(6)
    spans = [("a", 0, 1000), ("b", 5, 6), ("c", 7, 7), ("d", 3, 260), ("e", None, 9), ("f", 0, 512)]
    value = {}
    for s, lo, hi in spans:
        steps = sorted(rng.sample(range(1, 1000), 6))
        value[s] = [None if sum(x <= t for x in steps) == 2 else f"v{sum(x <= t for x in steps) % 4}" for t in range(1001)]
    table = spark.createDataFrame([(s, t, v) for s, vs in value.items() for t, v in enumerate(vs)], "s string, tick long, value string").cache()
    asked = []

    def probe(points):
        asked.extend(tuple(r) for r in points.select("s", "tick").collect())
        return points.join(table, ["s", "tick"])

    got = defaultdict(list)
    for r in temporal.frontier_changes(spark.createDataFrame(spans, "s string, lo long, hi long"), ["s"], probe).collect():
        got[r["s"]].append(r["tick"])
    probes = 0
    for s, lo, hi in spans:
        seen = set()
        want = [] if lo is None or lo >= hi else temporal.bisect_changes(lambda t, s=s, seen=seen: (seen.add(round(t)), value[s][round(t)])[1], lo, hi, 1.0)
        assert sorted(got[s]) == [round(t) for t in want]
        probes += len(seen)
    assert len(asked) == len(set(asked)) == probes
    assert temporal.frontier_changes(spark.createDataFrame(spans[:1], "s string, lo long, hi long").limit(0), ["s"], probe).collect() == []


def frames_of(spark, frames):
    """{(session, time): [text, ...]} as lines."""
    return spark.createDataFrame([(s, t, i, text) for (s, t), texts in frames.items() for i, text in enumerate(texts)], "s string, t int, line_idx int, text string").repartition(3)


def tracks_of(df, **options):
    return {(r["s"], r["t"], r["line_idx"]): (r["track_time"], r["track_line"]) for r in tracks.line_tracks(df, ["s"], "t", **options).collect()}


def test_tracks_survive_noise_scrolling_and_a_lost_frame(spark):
    text = [f"{w} line of the page number {w}{i}" for i, w in enumerate("alpha bravo charlie delta echo foxtrot golf hotel".split())]
    frames = {
        ("a", 10): text[0:4],
        ("a", 25): [text[1].replace("e", "c"), "????", text[3], text[4]],  # noise, and a line that is not recognised
        ("a", 40): text[2:6],
        ("a", 70): [text[3], None, "", text[6]],  # a line gone for good, blank ones
        ("b", 10): ["same", "same", "other words here"],
        ("b", 11): ["same", "other words here", "same", "same"],
    }
    got = tracks_of(frames_of(spark, frames))
    assert got["a", 25, 0] == (10, 1) and got["a", 25, 2] == (10, 3)
    assert got["a", 40, 0] == (10, 2)  # charlie, past the frame that lost it
    assert got["a", 40, 1] == (10, 3) and got["a", 40, 2] == (25, 3)
    assert got["a", 70, 0] == (10, 3) and got["a", 70, 3] == (70, 3) and got["a", 70, 1] == (70, 1)
    assert [got["b", 11, i] for i in range(4)] == [(10, 0), (10, 2), (10, 1), (11, 3)]
    assert len(got) == sum(map(len, frames.values()))
    near = tracks_of(frames_of(spark, frames), reach=1)
    assert near["a", 40, 0] == (40, 0)
    assert tracks_of(frames_of(spark, frames).limit(0)) == {}


def test_tracks_of_many_frames(spark):
    """A line that is always there is one track, from its first frame on."""
    got = tracks_of(frames_of(spark, {("s", t): ["the headline", f"passing {t * t}"] for t in range(60)}))
    assert {got["s", t, 0] for t in range(60)} == {(0, 0)}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def tracks_by_hand(frames, reach, limit):
    """Links by loops over pairs of lines, tracks by following them."""
    ahead, behind = {}, {}
    sessions = defaultdict(list)
    for s, t in sorted(frames):
        sessions[s].append(t)
    for hop in range(1, reach + 1):
        found = []
        for s, times in sessions.items():
            for t, u in zip(times, times[hop:], strict=False):
                left = [i for i, x in enumerate(frames[s, t]) if x and x.strip() and (s, t, i) not in ahead]
                right = [j for j, x in enumerate(frames[s, u]) if x and x.strip() and (s, u, j) not in behind]
                a, b = frames[s, t], frames[s, u]
                for i in list(left):
                    same = [j for j in right if a[i].strip() == b[j].strip()]
                    if same:
                        found.append(((s, t, i), (s, u, same[0])))
                        left.remove(i)
                        right.remove(same[0])
                once = lambda texts, at: {w: k[0] for w, k in ((w, [i for i in at for v in texts[i].strip().split(" ") if v == w]) for w in {v for i in at for v in texts[i].split(" ")}) if w and len(k) == 1}
                wa, wb = once(a, left), once(b, right)
                pairs = {(wa[w], wb[w]) for w in wa.keys() & wb.keys()}
                near = {p: levenshtein(a[p[0]].strip(), b[p[1]].strip()) / max(len(a[p[0]].strip()), len(b[p[1]].strip())) for p in pairs}
                near = {p: d for p, d in near.items() if d <= limit}
                for i, j in near:
                    if min((d, q) for (p, q), d in near.items() if p == i)[1] == j and min((d, p) for (p, q), d in near.items() if q == j)[1] == i:
                        found.append(((s, t, i), (s, u, j)))
        ahead.update(found)
        behind.update({y: x for x, y in found})
    out = {}
    for key in sorted(frames):
        for i in range(len(frames[key])):
            at = (*key, i)
            while at in behind:
                at = behind[at]
            out[(*key, i)] = at[1:]
    return out


def test_tracks_equal_brute_force(spark):
    rng = random.Random(9)
    words = "river stone light house blue seven quiet paper walks north".split()
    frames = {}
    for s in "abc":
        page = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(40)]
        for k in range(12):
            shown = page[k * 2 : k * 2 + 8]
            noisy = ["".join(rng.choice("xyz ") if rng.random() < 0.08 else c for c in line) if rng.random() < 0.5 else line for line in shown]
            frames[s, k * 3] = [x if rng.random() < 0.9 else None for x in noisy]
    for reach, limit in ((2, 0.4), (3, 0.2)):
        assert tracks_of(frames_of(spark, frames), reach=reach, limit=limit) == tracks_by_hand(frames, reach, limit)


def test_sightings_are_exchanged_once(spark):
    """A recording's sightings come to one task in one exchange, without stage tables; rows without keys or repeated ones are places, no more."""
    rows = [("a", 1, 0, "one line here"), ("a", 2, 0, "one line here"), ("a", 2, 0, "one line here"), ("a", 3, 1, "one lime here"), ("a", None, 0, "one line here"), (None, 1, 0, "x"), (None, 2, 0, "x")]
    df = spark.createDataFrame(rows, "s string, t int, line_idx int, text string").repartition(2)
    found = tracks.line_tracks(df, ["s"], "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan.replace("Scan ExistingRDD[s", "")
    got = sorted((r["s"] or "", r["t"] or 0, r["line_idx"], r["track_time"] or 0, r["track_line"]) for r in found.collect())
    assert got == [("", 1, 0, 1, 0), ("", 2, 0, 2, 0), ("a", 0, 0, 0, 0), ("a", 1, 0, 1, 0), ("a", 2, 0, 1, 0), ("a", 3, 1, 1, 0)]
    assert [tuple(r) for r in tracks.line_links(df, ["s"], "t").orderBy("time").collect()] == [("a", 1, 0, 2, 0), ("a", 2, 0, 3, 1)]
