"""Hough segments: planted ones are found, and all are those of a plain computation."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lectern.operators import gaze, hough


def plain(cells, steps, threshold, least, gap):
    votes, on = defaultdict(int), defaultdict(list)
    for x, y in sorted(set(cells)):
        for t, c, s in hough.angles(steps):
            r = math.floor(x * c + y * s + 0.5)
            votes[t, r] += 1
            on[t, r].append((y * c - x * s, x, y))
    votes = {k: v for k, v in votes.items() if v >= threshold}
    out = []
    for (t, r), v in sorted(votes.items()):
        def beside(dt, dr, t=t, r=r):
            u = t + dt
            return (u % steps, -(r + dr)) if not 0 <= u < steps else (u, r + dr)

        rivals = [(votes[n], -n[0], -n[1]) for n in (beside(dt, dr) for dt in (-1, 0, 1) for dr in (-1, 0, 1) if (dt, dr) != (0, 0)) if n in votes]
        if any(x > (v, -t, -r) for x in rivals):
            continue
        piece = []
        for p in sorted(on[t, r]) + [None]:
            if p is None or piece and p[0] - piece[-1][0] > gap:
                if piece[-1][0] - piece[0][0] >= least:
                    out.append((t, r, *piece[0][1:], *piece[-1][1:], len(piece)))
                piece = []
            piece.append(p)
    return out


def test_segments_equal_a_plain_computation(spark):
    rng = random.Random(1)
    frames = {}
    for f in range(3):
        cells = [(float(rng.randint(0, 60)), float(rng.randint(0, 60))) for _ in range(60)]
        cells += [(float(x), 20.0 + f) for x in range(5, 45)] + [(30.0, float(y)) for y in range(10, 55) if y not in (30, 31, 32, 33)] + [(float(k), float(k + f)) for k in range(40)]
        frames[f] = cells + cells[:5]
    df = spark.createDataFrame([(f, x, y) for f, cells in frames.items() for x, y in cells] + [(0, None, 1.0)], "f int, x double, y double").repartition(3)
    options = {"steps": 36, "threshold": 15, "least_length": 8.0, "most_gap": 2.5}
    got = defaultdict(list)
    for r in hough.segments(df, ["f"], **options).orderBy("segment_id").collect():
        got[r["f"]].append(tuple(r)[2:])
    for f, cells in frames.items():
        assert got[f] == plain(cells, 36, 15, 8.0, 2.5)
        upright = [s for s in got[f] if s[0] == 0 and s[1] == 30]
        assert len(upright) == 2  # one line in two pieces
        assert any(s[0] == 18 and s[1] == 20 + f and {s[2], s[4]} >= {44.0} for s in got[f])
    assert hough.segments(df.limit(0), ["f"]).collect() == []


def test_edges_of_a_picture_feed_the_matching_of_segments(spark):
    """A rectangle's sides are found, and each labelled side gets the found one that is nearest."""
    pixels = [(1, x, y, 200.0 if 10 <= x < 50 and 8 <= y < 30 else 0.0) for x in range(64) for y in range(40)]
    edges = hough.edge_cells(spark.createDataFrame(pixels, "f int, x int, y int, v double"), ["f"], "v", 100)
    found = hough.segments(edges, ["f"], steps=12, threshold=15, least_length=15.0)
    sides = [("top", 10.0, 8.0, 49.0, 8.0), ("bottom", 10.0, 30.0, 49.0, 30.0), ("left", 10.0, 8.0, 10.0, 29.0), ("right", 50.0, 8.0, 50.0, 29.0)]
    labelled = spark.createDataFrame([(1, *s) for s in sides], "f int, label_id string, x1 double, y1 double, x2 double, y2 double")
    ends = lambda a, b: F.when((F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")), F.col(a)).otherwise(F.col(b))
    turned = found.select("f", "segment_id", ends("x1", "x2").alias("x1"), ends("y1", "y2").alias("y1"), ends("x2", "x1").alias("x2"), ends("y2", "y1").alias("y2"))
    near = {r["label_id"]: r["dist"] for r in gaze.nearest_segments(turned, labelled, ["f"]).collect()}
    assert set(near) == {"top", "bottom", "left", "right"} and all(d is not None and d <= 2.5 for d in near.values()), near


def test_votes_stay_in_the_task_of_their_frame(spark):
    """Cells alone are exchanged, once; runs of cells are the cells that they stand for."""
    runs = spark.createDataFrame([(f, 3.0, float(4 * k), (7 * k + f) % 40) for f in range(4) for k in range(30)] + [(None, 0.0, 0.0, 20)], "f int, x double, y double, more int")
    cells = runs.select("f", F.explode(F.sequence(F.lit(0), "more")).alias("k"), "x", "y").select("f", (F.col("x") + F.col("k")).alias("x"), "y")
    options = {"steps": 12, "threshold": 8, "least_length": 6.0, "most_gap": 2.0}
    found = hough.segments(cells, ["f"], **options)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "theta" not in plan[plan.index("Exchange hashpartitioning") :]
    got = found.orderBy("f", "segment_id").collect()
    assert got and got == hough.run_segments(runs, ["f"], **options).orderBy("f", "segment_id").collect()
    own = [(r["x"], r["y"]) for r in cells.filter("f = 1").collect()]
    assert [tuple(r)[2:] for r in got if r["f"] == 1] == plain(own, 12, 8, 6.0, 2.0)
