"""Overlap of polygons, hulls, common parts, unions, drainage: brute force and hand-worked cases."""

import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import iterative, polygons, scenes
from hydrospark.plans.components import drained, nearest_stops, reached

RING = "array<struct<x:double,y:double>>"


def star(rng, x, y, sides, size):
    """A ring around a point, with notches, counter-clockwise."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(sides))
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t in turns for r in [size * rng.uniform(0.2, 1)]]


def heights(rings, x):
    """The parts of an upright line that rings hold, by even and odd crossings."""
    at = sorted(p[1] + (q[1] - p[1]) * (x - p[0]) / (q[0] - p[0]) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1]) if min(p[0], q[0]) <= x < max(p[0], q[0]))
    return list(zip(at[::2], at[1::2]))


def shared_area(a, b):
    """Area that two polygons share, by all slabs between corners and crossings of sides, each measured at its middle."""
    sides = [(p, q) for ring in [*a, *b] for p, q in zip(ring, ring[1:] + ring[:1])]
    xs = {p[0] for p, _ in sides}
    for (p, q), (r, s) in itertools.combinations(sides, 2):
        d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
        if d:
            t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
            if 0 <= t <= 1:
                xs.add(p[0] + t * (q[0] - p[0]))
    xs, total = sorted(xs), 0.0
    for lo, hi in zip(xs, xs[1:]):
        mid = (lo + hi) / 2
        total += (hi - lo) * sum(max(0.0, min(t, v) - max(s, u)) for s, t in heights(a, mid) for u, v in heights(b, mid))
    return total


def points(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def polygon_table(spark, polygons_, key):
    return spark.createDataFrame([(i, points(r)) for i, rings in enumerate(polygons_) for r in rings], f"{key} long, ring {RING}")


@pytest.mark.parametrize("width", [6.0, 0.7])
def test_overlaps_of_notched_polygons(spark, width):
    rng = random.Random(5)
    a = [[star(rng, rng.uniform(0, 6), rng.uniform(0, 6), rng.randrange(5, 12), 2)] for _ in range(12)]
    b = [[star(rng, rng.uniform(0, 6), rng.uniform(0, 6), rng.randrange(5, 12), 2)] for _ in range(12)]
    # a box with a hole and one around everything
    a += [[[(0, 0), (5, 0), (5, 5), (0, 5)], [(1, 1), (1, 4), (4, 4), (4, 1)]], [[(-9, -9), (19, -9), (19, 19), (-9, 19)]]]
    got = {(r["i"], r["j"]): r for r in polygons.ring_overlaps(polygon_table(spark, a, "i"), polygon_table(spark, b, "j"), "i", "j", width).collect()}
    for (i, p), (j, q) in itertools.product(enumerate(a), enumerate(b)):
        want = shared_area(p, q)
        assert (got[i, j]["area"] if (i, j) in got else 0.0) == pytest.approx(want, abs=1e-9), (i, j)
    assert got[13, 3]["b_share"] == pytest.approx(1.0) and len(got) > 40


def test_overlap_as_a_column(spark):
    rng = random.Random(6)
    pairs = [(star(rng, 0, 0, 9, 2), star(rng, 1, 0.5, 7, 2)) for _ in range(20)]
    df = spark.createDataFrame([(i, points(a), points(b)) for i, (a, b) in enumerate(pairs)], f"i long, a {RING}, b {RING}")
    for r in df.select("i", polygons.overlap_of(F.col("a"), F.col("b")).alias("area")).collect():
        assert r["area"] == pytest.approx(shared_area(*[[p] for p in pairs[r["i"]]]), abs=1e-9)


def test_polygons_that_touch_do_not_overlap(spark):
    a = polygon_table(spark, [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(0.1, 0.3), (0.7, 0.2), (0.3, 0.9)]]], "i")
    b = polygon_table(spark, [[[(1, 0), (2, 0), (2, 1), (1, 1)]], [[(0, 1), (1, 1), (0.5, 2)]]], "j")
    assert polygons.ring_overlaps(a, b, "i", "j").collect() == [] and polygons.ring_overlaps(a.limit(0), b, "i", "j").collect() == []


def hull_of(at):
    """Corners of the convex hull: those that are on no segment and in no triangle of others."""
    at = sorted(set(at))
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out = set()
    for p, q in itertools.permutations(at, 2):
        rest = [cross(p, q, r) for r in at if r not in (p, q)]
        on_line = [r for r in at if r not in (p, q) and cross(p, q, r) == 0]
        if all(c >= 0 for c in rest) and all(min(p, q) <= r <= max(p, q) for r in on_line):
            out |= {p, q}
    return out or set(at)


def test_hulls(spark):
    rng = random.Random(7)
    sets = [[(float(rng.randrange(5)), float(rng.randrange(5))) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, points(s)) for i, s in enumerate(sets)], f"i long, p {RING}")
    for r in df.select("i", polygons.hull_ring(F.col("p")).alias("h")).collect():
        ring = [(p["x"], p["y"]) for p in r["h"]]
        assert set(ring) == hull_of(sets[r["i"]]) and len(ring) == len(set(ring))
        turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2])]
        assert len(ring) < 3 or all(t > 0 for t in turns)


def scene_rows(spark, rows):
    return spark.createDataFrame([(i, datetime.datetime(2024, 1, d, 5 + i % 9), 9, "VV+VH", direction, x, y) for i, d, direction, x, y in rows], "event_id long, start_time timestamp_ntz, basin_key long, polarization string, flight_direction string, xlo double, ylo double")


def test_two_diagonal_captures(spark):
    s = scene_rows(spark, [(1, 1, "ASCENDING", 0.0, 0.0), (2, 1, "ASCENDING", 2.0, 2.0), (3, 3, "DESCENDING", 0.0, 2.0), (4, 3, "DESCENDING", 2.0, 0.0)])
    groups = scenes.scene_day_groups(s)
    area = {r["day"].day: r["a"] for r in groups.select("day", polygons.ring_area(F.col("ring")).alias("a")).collect()}
    # a box of 4.5 less two corners of 2 by 2 halves
    assert area == pytest.approx({1: 4.5**2 - 4, 3: 4.5**2 - 4})
    both = scenes.footprint_intersection(groups, "basin_key").first()
    # all four corners are cut off now
    assert both["area"] == pytest.approx(4.5**2 - 8)
    far = scenes.footprint_intersection(scenes.scene_day_groups(scene_rows(spark, [(1, 1, "ASCENDING", 0.0, 0.0), (2, 3, "ASCENDING", 9.0, 0.0)])), "basin_key").first()
    assert far["area"] == 0.0


def test_tuplets_equal_a_search_over_hulls(spark):
    rng = random.Random(8)
    rows = [(i, d, rng.choice(["ASCENDING", "DESCENDING"]), rng.choice([0.0, 1.0, 2.0, 3.0]), rng.choice([0.0, 1.5, 3.0])) for i, d in enumerate([d for d in range(1, 25) for _ in range(rng.randrange(1, 4))])]
    groups = scenes.scene_day_groups(scene_rows(spark, rows))
    event = spark.createDataFrame([(9, datetime.date(2024, 1, 9))], "basin_key long, began date")
    listed = {}
    for r in groups.orderBy("flight_direction", "day", "grp").collect():
        listed.setdefault(r["flight_direction"], []).append(([(p["x"], p["y"]) for p in r["ring"]], r["first_time"]))

    def clip(a, b):
        for (px, py), (qx, qy) in zip(b, b[1:] + b[:1]):
            side = lambda r: (qx - px) * (r[1] - py) - (qy - py) * (r[0] - px)  # noqa: B023, E731
            out = []
            for r, t in zip(a, a[1:] + a[:1]):
                if side(r) >= 0:
                    out.append(r)
                if (side(r) >= 0) != (side(t) >= 0):
                    w = side(r) / (side(r) - side(t))
                    out.append((r[0] + (t[0] - r[0]) * w, r[1] + (t[1] - r[1]) * w))
            a = out
        return a

    area = lambda a: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a, a[1:] + a[:1])) / 2
    for n, least in ((3, 2.0), (3, 5.0), (2, 4.0)):
        want = set()
        for direction, own in listed.items():
            for k, (ring, first) in enumerate(own):
                if first < datetime.datetime(2024, 1, 9):
                    continue
                for before in ([(j,) for j in reversed(range(k))] if n == 2 else [(j, i) for j in reversed(range(k)) for i in reversed(range(j))]):
                    both = ring
                    for at in before:
                        both = clip(both, own[at][0])
                    if area(both) > least:
                        want.add((direction, k + 1, before[0] + 1, before[1] + 1 if n == 3 else None, round(area(both), 6)))
                        break
        got = {(r["flight_direction"], r["k"], r["j"], r["i"], round(r["area"], 6)) for r in scenes.scene_tuplets(groups, event, least, n).collect()}
        assert got == want and got


def test_matching_needs_all_days_in_one_direction(spark):
    groups = scenes.scene_day_groups(scene_rows(spark, [(1, 1, "ASCENDING", 0.0, 0.0), (2, 1, "ASCENDING", 2.0, 2.0), (3, 3, "DESCENDING", 0.0, 0.0), (4, 5, "ASCENDING", 0.0, 0.0)]))
    day = lambda *ds: [datetime.date(2024, 1, d) for d in ds]
    tiles = [(1, 9, day(1), 0.0, 0.0, 1.0, 1.0), (2, 9, day(1, 3), 0.0, 0.0, 1.0, 1.0), (3, 9, day(1, 5), 0.0, 0.0, 1.0, 1.0), (4, 9, day(1), 0.0, 3.0, 1.0, 4.0), (5, 9, day(5, 1), 2.0, 2.0, 3.0, 3.0), (6, 9, day(1, 1), 1.0, 1.0, 3.0, 3.0)]
    df = spark.createDataFrame(tiles, "tile_id long, basin_key long, days array<date>, xlo double, ylo double, xhi double, yhi double")
    # 2 has no day in one direction, 4 lies in the corner that the hull cuts off, 5 beyond its first day's capture
    assert sorted(r["tile_id"] for r in scenes.matching_scene(df, groups).collect()) == [1, 3, 6]


@pytest.mark.parametrize("width", [6.0, 0.9])
def test_unions(spark, width):
    rng = random.Random(9)
    rows = [(g, x := rng.uniform(-3, 3), y := rng.uniform(-3, 3), x + rng.uniform(0, 2), y + rng.choice([0.0, 0.5, rng.uniform(0, 2)])) for g in range(4) for _ in range(25)]
    rows += [(4, 0.0, 0.0, 1.0, 1.0)] * 3 + [(5, -6.0, 0.0, 6.0, 1.0), (5, 0.0, -6.0, 1.0, 6.0)]
    got = {r["g"]: r["area"] for r in polygons.union_area(spark.createDataFrame(rows, "g long, xlo double, ylo double, xhi double, yhi double"), ["g"], width).collect()}
    for g in range(6):
        own = [r[1:] for r in rows if r[0] == g]
        xs, ys = sorted({b[0] for b in own} | {b[2] for b in own}), sorted({b[1] for b in own} | {b[3] for b in own})
        want = sum((x1 - x0) * (y1 - y0) for x0, x1 in zip(xs, xs[1:]) for y0, y1 in zip(ys, ys[1:]) if any(b[0] <= x0 and b[2] >= x1 and b[1] <= y0 and b[3] >= y1 for b in own))
        assert got[g] == pytest.approx(want, abs=1e-9)


def test_shares_that_a_union_covers(spark):
    areas = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 2.0), (2, 10.0, 0.0, 11.0, 1.0)], "k long, xlo double, ylo double, xhi double, yhi double")
    boxes = spark.createDataFrame([(-1.0, -1.0, 1.0, 1.0), (0.5, 0.5, 1.5, 9.0), (0.5, 0.5, 1.5, 9.0)], "xlo double, ylo double, xhi double, yhi double")
    got = {r["k"]: r["share"] for r in polygons.exact_covered_share(areas, boxes, ["k"]).collect()}
    assert got == pytest.approx({1: (1.0 + 1.5 - 0.25) / 8})


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from hydrospark.plans import components

    n, tables = 10_000, []
    real = components.written
    monkeypatch.setattr(components, "written", lambda df, name: (tables.append(name), real(df, name))[1])
    after = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("next"))
    found = nearest_stops(after, spark.createDataFrame([(0,)], "node long"))
    assert found.agg(F.max("steps"), F.count("*"), F.sum(F.abs(F.col("steps") - F.col("node")))).first() == (n - 1, n, 0)
    assert len(tables) - 1 <= 16


def test_drainage_of_nested_targets(spark):
    rng = random.Random(10)
    rows = [(i, rng.randrange(max(0, i - 6), i) if i > 2 else None) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (400, 999)]
    after = spark.createDataFrame(rows, "node long, next long")
    goals = [0, 1, 5, 17, 60, 61, 150, 301, 400]
    targets = spark.createDataFrame([(g,) for g in goals], "node long")
    got = sorted(map(tuple, drained(after, targets).collect()))
    up = after.where("next IS NOT NULL").select(F.col("next").alias("node"), F.col("node").alias("next"))
    want = sorted((r["root"], r["node"], r["level"]) for r in reached(targets.select(F.col("node").alias("root"), "node"), up).collect())
    assert got == want and len({t for t, _, _ in got}) == len(goals)


def test_upstream_of_inner_targets(spark):
    basins = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 2), (5, 0)], "hybas_id long, next_down long")
    got = sorted(map(tuple, iterative.upstream_of(basins, spark.createDataFrame([(1,), (2,), (5,)], "hybas_id long")).collect()))
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 2, 0), (2, 3, 1), (2, 4, 1), (5, 5, 0)]
