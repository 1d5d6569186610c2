"""Outlines of regions: areas, sides, holes, corners that touch, outlines that the edge of the image cuts."""

import random

from pyspark.sql import functions as F

from hydrospark.operators import outlines as module
from hydrospark.operators.outlines import outlines
from hydrospark.operators.spatial import ring_area


def rings_of(spark, cells, frame=None):
    df = spark.createDataFrame([(k, r, x, y) for k, r, x, y in cells], "k long, region long, gx long, gy long")
    edge = None if frame is None else spark.createDataFrame(frame, "k long, x0 long, y0 long, x1 long, y1 long")
    rows = outlines(df, "k", edge).withColumn("area", ring_area(F.col("ring"))).collect()
    return [(r["k"], r["region"], r["closed"], [(int(p["x"]), int(p["y"])) for p in r["ring"]], r["area"]) for r in rows]


def unit_sides(ring, closed):
    out = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + (ring[:1] if closed else [])):
        assert (x0 == x1) != (y0 == y1)
        n = abs(x1 - x0) + abs(y1 - y0)
        dx, dy = (x1 - x0) // n, (y1 - y0) // n
        out += [((x0 + i * dx, y0 + i * dy), (x0 + (i + 1) * dx, y0 + (i + 1) * dy)) for i in range(n)]
    return out


def border(own):
    sides = []
    for x, y in own:
        for (a, b), (c, d), (i, j) in (((0, 0), (1, 0), (0, -1)), ((1, 0), (1, 1), (1, 0)), ((1, 1), (0, 1), (0, 1)), ((0, 1), (0, 0), (-1, 0))):
            if (x + i, y + j) not in own:
                sides.append(((x + a, y + b), (x + c, y + d)))
    return sorted(sides)


def test_random_regions(spark):
    rng = random.Random(1)
    cells = [(k, rng.randrange(2), x, y) for k in (1, 2) for x in range(9) for y in range(8) if rng.random() < 0.9]
    got = rings_of(spark, cells)
    for k in (1, 2):
        for region in (0, 1):
            own = {(x, y) for k2, r, x, y in cells if (k2, r) == (k, region)}
            mine = [g for g in got if g[:2] == (k, region)]
            assert all(g[2] for g in mine) and sum(g[4] for g in mine) == len(own)
            assert sorted(s for g in mine for s in unit_sides(g[3], True)) == border(own)


def test_hole_and_touching_corners(spark):
    square = [(1, 5, x, y) for x in range(4) for y in range(4) if (x, y) != (1, 2)]
    got = sorted(g[4] for g in rings_of(spark, square))
    assert got == [-1.0, 16.0]
    outer = max(rings_of(spark, square), key=lambda g: g[4])[3]
    assert set(outer) == {(0, 0), (4, 0), (4, 4), (0, 4)} and len(outer) == 4
    # two cells that share a corner alone have an outline each
    got = rings_of(spark, [(1, 5, 0, 0), (1, 5, 1, 1)])
    assert sorted(sorted(g[3]) for g in got) == [[(0, 0), (0, 1), (1, 0), (1, 1)], [(1, 1), (1, 2), (2, 1), (2, 2)]]


def test_outlines_that_the_edge_cuts_stay_open(spark):
    cells = [(1, 5, x, y) for x in range(3) for y in range(2)] + [(1, 6, 4, 4)]
    got = {g[1]: g for g in rings_of(spark, cells, [(1, 0, 0, 9, 9)])}
    assert got[6][2] and got[6][4] == 1.0
    assert not got[5][2] and got[5][3] == [(3, 0), (3, 2), (0, 2)]
    # a band from edge to edge has two outlines, one that fills the image has none
    band = rings_of(spark, [(1, 5, x, 1) for x in range(4)], [(1, 0, 0, 3, 3)])
    assert sorted(g[3] for g in band) == [[(0, 1), (4, 1)], [(4, 2), (0, 2)]]
    assert rings_of(spark, [(1, 5, x, y) for x in range(2) for y in range(2)], [(1, 0, 0, 1, 1)]) == []


def test_a_long_outline(spark):
    """A spiral: one ring of some thousand sides."""
    cells, x, y, n = {(0, 0)}, 0, 0, 1
    for k, (dx, dy) in enumerate([(1, 0), (0, 1), (-1, 0), (0, -1)] * 10):
        n += 2 * (k % 2 == 0)
        for _ in range(n):
            x, y = x + dx, y + dy
            cells.add((x, y))
    got = rings_of(spark, [(1, 1, x, y) for x, y in cells])
    assert sum(g[4] for g in got) == len(cells) and sorted(s for g in got for s in unit_sides(g[3], True)) == border(cells)


def test_blocks_change_no_outline(spark):
    """Outlines in blocks of six corners are those in one block: rings that go round through many blocks, open ones, a key and a region that are null."""
    rng = random.Random(3)
    cells = [(k, rng.choice([1, 1, 1, None]), x, y) for k in (1, None) for x in range(-9, 9) for y in range(-5, 9) if rng.random() < 0.85]
    df = spark.createDataFrame(cells, "k long, region long, gx long, gy long")
    frame = spark.createDataFrame([(1, -9, -5, 8, 8)], "k long, x0 long, y0 long, x1 long, y1 long")
    rows = lambda found: sorted([(r["k"], r["region"], r["closed"], [(int(p["x"]), int(p["y"])) for p in r["ring"]]) for r in found.collect()], key=repr)
    one, many = (rows(outlines(df, "k", frame, block)) for block in (64, 6))
    assert one == many and len(one) > 20 and {r[2] for r in one} == {True, False}
    own = {(x, y) for k, r, x, y in cells if k is r is None}
    assert sorted(s for r in rows(outlines(df.where("k IS NULL AND region IS NULL"), "k", None, 64)) for s in unit_sides(r[3], True)) == border(own)


def test_rounds_are_over_pieces_of_blocks(spark, monkeypatch):
    """Outlines within a block need no rounds; of one that goes through blocks its sides are folded."""
    ranked, keep = [], module.nearest_stops
    monkeypatch.setattr(module, "nearest_stops", lambda links, *more: (ranked.append(links.count()), keep(links, *more))[1])
    cells = spark.range(200).selectExpr("1 AS k", "2 AS region", "id AS gx", "0 AS gy")
    assert [len(r["ring"]) for r in outlines(cells.where("gx < 100"), "k").collect()] == [4] and ranked == []
    assert [len(r["ring"]) for r in outlines(cells, "k").collect()] == [4] and ranked == [2]
