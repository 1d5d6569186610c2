"""Segments on a grid, rings, scenes of one day and hot months: hand-worked cases and brute force."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators import events, rasters, scenes, spatial


def test_segments_of_all_directions_hit_the_tiles_that_they_touch(spark):
    rng = np.random.default_rng(1)
    ends = [(4.0, 1.0, 1.0, 4.0), (1.0, 4.0, 4.0, 1.0), (2.5, 0.5, 2.5, 3.5), (3.0, 3.0, 3.0, 0.0), (1.5, 1.5, 1.5, 1.5), (0.0, 2.0, 5.0, 2.0)] + [tuple(map(float, rng.integers(0, 12, 4) / 2)) for _ in range(40)]
    rivers = spark.createDataFrame([(i, 900, *e) for i, e in enumerate(ends)], "river_id long, riv_tc_usu long, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in spatial._hits(rivers).collect():
        got.setdefault(r["river_id"], set()).add((r["tx"], r["ty"]))
    for i, (x1, y1, x2, y2) in enumerate(ends):
        want = set()
        for tx in range(-2, 8):
            for ty in range(-2, 8):
                sides = [np.sign((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) for x in (tx, tx + 1) for y in (ty, ty + 1)]
                if tx <= max(x1, x2) and tx + 1 >= min(x1, x2) and ty <= max(y1, y2) and ty + 1 >= min(y1, y2) and min(sides) <= 0 <= max(sides):
                    want.add((tx, ty))
        assert got[i] == want, ends[i]
    assert got[0] == got[1]


def test_starts_fall_back_to_small_rivers_and_the_middle(spark):
    tiles = spark.createDataFrame([(roi, roi * 1000 + x * 20 + y, x, y) for roi, lo in ((1, 0), (2, 10), (3, 14)) for x in range(lo, 20) for y in range(8)], "roi_id long, tile_id long, tx long, ty long")
    rivers = spark.createDataFrame([(1, 900, 1.5, 1.5, 1.5, 1.5), (2, 10, 11.5, 6.5, 11.5, 6.5)], "river_id long, riv_tc_usu long, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in spatial.initial_tiles(rivers, tiles, most=200, around=1, centre=1).collect():
        got.setdefault(r["roi_id"], set()).add((r["tx"], r["ty"]))
    assert got[1] == {(0, 0), (0, 1), (1, 0), (1, 1)} and got[2] == {(10, 5), (10, 6), (11, 5), (11, 6)}
    assert got[3] == {(x, y) for x in (8, 9, 10) for y in (2, 3, 4)}


def ring(*corners):
    return spatial.ring_of(*[(F.lit(float(x)), F.lit(float(y))) for x, y in corners])


def test_rings_are_clipped(spark):
    arrow = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    square = lambda x, y, s: ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))
    found = spark.range(1).select(*[spatial.overlap_area(arrow, square(*at)).alias(f"s{i}") for i, at in enumerate(((0, 0, 4), (0, 0, 1), (5, 5, 1), (1, 2, 2), (-1, -1, 9)))], spatial.overlap_area(arrow, ring((0, 0), (4, 0), (0, 4))).alias("t")).first()
    assert [found[f"s{i}"] for i in range(5)] == pytest.approx([10, 1, 0, 1 / 6, 10])
    grid = np.array([(x + 0.5, y + 0.5) for x in range(800) for y in range(800)]) / 200
    inside = (grid[:, 1] < np.where(grid[:, 0] < 2, 4 - 1.5 * grid[:, 0], 1 + 1.5 * (grid[:, 0] - 2))) & (grid.sum(1) < 4)
    assert found["t"] == pytest.approx(inside.mean() * 16, abs=0.02)


def test_ring_shares_add_up(spark):
    areas = spatial.with_bounds(spark.range(1).withColumn("ring", ring((0.3, 0.2), (7.7, 1.1), (6.2, 5.9), (4.1, 2.2), (1.0, 6.3))))
    got = spatial.ring_overlay_weights(areas, 1.5).collect()
    assert sum(r["area_share"] for r in got) == pytest.approx(1) and all(0 < r["cell_share"] <= 1 for r in got)


def test_points_on_either_side_of_a_notch(spark):
    areas = spatial.with_bounds(spark.range(1).select(F.lit(7).alias("k"), ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4)).alias("ring")))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 3.0), (3, 3.7, 3.0), (4, 5.0, 1.0)], "i long, px double, py double")
    assert sorted(r["i"] for r in spatial.points_in_areas(points, areas, "k").collect()) == [1, 3]


def test_a_day_of_two_captures_has_the_box_around_both(spark):
    t = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [(1, t(1, 5), 0.0, 0.0), (2, t(1, 6), 2.0, 0.0), (3, t(3, 5), 1.0, 0.0), (4, t(5, 5), 40.0, 0.0), (5, t(6, 5), 2.0, 0.0), (6, t(7, 5), 3.5, 0.0)]
    s = spark.createDataFrame([(i, at, 9, "VV+VH", "ASCENDING", x, y) for i, at, x, y in rows], "event_id long, start_time timestamp_ntz, basin_key long, polarization string, flight_direction string, xlo double, ylo double")
    groups = scenes.scene_day_groups(s)
    got = {r["day"].day: (r["xlo"], r["xhi"], r["n_scenes"]) for r in groups.collect()}
    assert got == {1: (0.0, 4.5, 2), 3: (1.0, 3.5, 1), 5: (40.0, 42.5, 1), 6: (2.0, 4.5, 1), 7: (3.5, 6.0, 1)}
    e = spark.createDataFrame([(9, datetime.date(2024, 1, 6))], "basin_key long, began date")
    found = [(r["k"], r["j"], r["i"], r["area"]) for r in scenes.scene_tuplets(groups, e, 1.0).orderBy("k").collect()]
    # day 6 meets days 3 and 1; day 7 meets day 6 in one degree, but with day 3 nothing and with day 1 just that degree
    assert found == [(4, 2, 1, 1.5 * 2.5), (5, 4, 1, 1.0 * 2.5)]
    assert [(r["k"], r["j"]) for r in scenes.scene_tuplets(groups, e, 1.0, 2).orderBy("k").collect()] == [(4, 2), (5, 4)]
    funnel = scenes.search_funnel(s.where("event_id IN (1, 2, 5)"), e).first()
    assert (funnel["searched"], funnel["dual"], funnel["days"], funnel["before"], funnel["after"]) == (1, 1, 0, 0, 0)


def test_a_hot_month_is_dealt_out(spark):
    day = F.lit("2000-03-05").cast("date")
    a = spark.range(300).select("id", F.date_add(day, (F.col("id") % 20).cast("int")).alias("began")).withColumn("ended", F.date_add("began", 30))
    b = spark.range(20).select(F.col("id").alias("k"), F.date_add(day, F.col("id").cast("int")).alias("first_track")).withColumn("last_track", F.date_add("first_track", 2))
    whole = sorted((r["id"], r["k"]) for r in events.time_overlap_join(a, b).collect())
    assert whole and whole == sorted((r["id"], r["k"]) for r in events.time_overlap_join(a, b, per_bucket=7).collect())
    assert whole == sorted((x["id"], y["k"]) for x in a.collect() for y in b.collect() if x["began"] < y["last_track"] and y["first_track"] < x["ended"])


def test_deviations_of_large_means(spark):
    values = [1e9 + i % 7 for i in range(500)]
    rows = spark.createDataFrame([("b", i % 5, v) for i, v in enumerate(values)], "band string, fold int, value double")
    assert rasters.band_stats(rows).first()["std"] == pytest.approx(np.std(values), rel=1e-8)
    for r in rasters.fold_stats(rows).collect():
        rest = [v for i, v in enumerate(values) if i % 5 != r["fold"]]
        assert r["std"] == pytest.approx(np.std(rest), rel=1e-6) and r["mean"] == pytest.approx(np.mean(rest), rel=1e-12)
