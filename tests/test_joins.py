"""Crowded joins in space, as-of joins, checks that ride along: brute force, plans and errors."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import asof, quadtree, scenes, spatial
from hydrospark.plans import checks
from hydrospark.sources.views import Views

SF = "/root/testdata/sf0.001"
BOX = "xlo double, ylo double, xhi double, yhi double"


def crowd(rng, n, m):
    """Many tiny boxes in one place, some everywhere, some large."""
    at = lambda x, y, s: (x, y, x + rng.uniform(0, s), y + rng.uniform(0, s))
    rows = [at(rng.uniform(10, 10.05), rng.uniform(-20, -19.95), 0.001) for _ in range(n)]
    rows += [at(rng.uniform(-50, 50), rng.uniform(-50, 50), 1) for _ in range(m)] + [at(rng.uniform(-50, 20), rng.uniform(-50, 20), 60) for _ in range(5)]
    return [(i, *r) for i, r in enumerate(rows)]


def test_crowded_cells_are_split_and_pairs_are_right(spark):
    rng = random.Random(1)
    a, b = crowd(rng, 600, 100), crowd(rng, 400, 100)
    b += [(900, 11.0, -19.0, 11.0, -19.0), (901, *a[3][1:3], *a[3][1:3])]
    left, right = spark.createDataFrame(a, f"i long, {BOX}"), spark.createDataFrame(b, f"j long, {BOX}")
    got = sorted((r["i"], r["j"]) for r in quadtree.crowd_join(left, right, crowded=40).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    splits = quadtree.crowded_cells([left, right], crowded=40)
    levels = splits.agg(F.max("level")).first()[0] + 1
    filed = lambda df: {(r["level"], r["cx"], r["cy"]): r["n"] for r in quadtree.in_leaves(df, splits, levels).groupBy("level", "cx", "cy").agg(F.count("*").alias("n")).collect()}
    p, q = filed(left), filed(right)
    work = [n * q.get(cell, 0) for cell, n in p.items()]
    # the crowd of 600 by 400 is compared leaf by leaf, and no leaf has much more than a split would leave
    assert sum(work) < 600 * 400 / 10 and max(p.values()) < 4 * 40 and max(work) < sum(work) / 10
    assert len(p) < 40 * len(a)


def test_large_boxes_do_not_split_a_cell(spark):
    rows = [(i, 0.1, 0.1, 2.0, 2.0) for i in range(50)]
    assert quadtree.crowded_cells([spark.createDataFrame(rows, f"i long, {BOX}")], crowded=10).count() == 0


@pytest.mark.parametrize("find", [spatial.points_in_areas, quadtree.crowded_points_in_areas])
def test_repeated_points_stay_repeated(spark, find):
    areas = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 1.0), (8, 0.0, 0.0, 2.0, 2.0)], f"k long, {BOX}")
    points = spark.createDataFrame([("a", 0.5, 0.5)] * 3 + [("a", 1.5, 0.5), ("b", 0.5, 0.5), ("c", 2.0, 2.0), (None, 0.0, 0.0)], "n string, px double, py double")
    got = sorted(((r["n"], r["px"], r["k"]) for r in find(points, areas, "k").collect()), key=repr)
    assert got == sorted([("a", 0.5, 7)] * 3 + [("a", 1.5, 8), ("b", 0.5, 7), (None, 0.0, 7)], key=repr)


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.mark.parametrize("after,strict", [(True, False), (True, True), (False, False), (False, True)])
def test_asof_equals_brute_force(spark, after, strict):
    rng = random.Random(2)
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None] + [at(60 * rng.randrange(2000))] * 9)) for i in range(150)]
    right = [(rng.choice([1, 1, 1, 2, 3, None]), at(60 * rng.randrange(2000)) if rng.random() < 0.95 else None, rng.randrange(3)) for _ in range(90)]
    a = spark.createDataFrame(left, "i long, k long, t timestamp_ntz")
    b = spark.createDataFrame(right, "k long, u timestamp_ntz, v int")
    got = {r["i"]: r["m"] and (r["m"]["u"], r["m"]["v"]) for r in asof.asof_join(a, b, ["k"], "t", "u", "m", after, strict, days=5).collect()}
    for i, k, t in left:
        fits = [(u, v) for k2, u, v in right if k is not None and t is not None and u is not None and k2 == k and ((u > t or u == t and not strict) if after else (u < t or u == t and not strict))]
        assert got[i] == (None if not fits else min(fits) if after else max(fits)), (i, k, t)
    assert len(got) == len(left)


def test_many_events_of_a_basin(spark):
    rng = random.Random(3)
    shots = [(i, at(60 * 24 * rng.randrange(400) + i), rng.randrange(2), "VV+VH", "ASCENDING", rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 0.5])) for i in range(300)]
    s = spark.createDataFrame(shots, "event_id long, start_time timestamp_ntz, basin_key long, polarization string, flight_direction string, xlo double, ylo double")
    events = [(k, (at(0) + datetime.timedelta(days=7 * d)).date(), x, 0.0, x + 2.0, 2.0) for k in range(3) for d, x in ((d, rng.choice([0.5, 1.0])) for d in range(50))]
    e = spark.createDataFrame(events, f"basin_key long, began date, {BOX}")
    first = scenes.first_scene_after(s, e)
    got = {(r["basin_key"], r["began"]): r["event_id"] for r in first.collect()}
    newest = scenes.latest_covering_scene(s, e)
    found = {(r["basin_key"], r["began"]): (r["event_id"], r["day"]) for r in newest.collect()}
    for k, began, xlo, ylo, xhi, yhi in events:
        later = [(t, i) for i, t, k2, *_ in shots if k2 == k and t >= datetime.datetime.combine(began, datetime.time())]
        assert got[k, began] == (min(later)[1] if later else None)
        fit = [(t, i) for i, t, k2, _, _, x, y in shots if k2 == k and 7 <= (began - t.date()).days <= 67 and x <= xlo and y <= ylo and x + 2.5 >= xhi and y + 2.5 >= yhi]
        assert found[k, began] == ((max(fit)[1], max(fit)[0].date()) if fit else (None, began))
    # no join on the basin alone
    for plan in (first, newest):
        joins = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert joins and all("span" in x or "of_began" in x for x in joins), joins


def test_nothing_is_lost_in_one_scan(spark, tmp_path):
    spark.range(20).withColumn("v", F.col("id") * 2).write.parquet(f"{tmp_path}/a")
    left = spark.read.parquet(f"{tmp_path}/a")
    whole, part = spark.range(25).withColumn("w", F.lit(1)), spark.range(17).withColumn("w", F.lit(1))
    merged = checks.merge_none_lost(left, whole, ["id"])
    assert merged.rows.count() == 20 and merged.verify() == {"lost": 0, "rows": 20}
    assert merged.rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    merged = checks.merge_none_lost(left, part, ["id"])
    assert sorted(merged.rows.columns) == ["id", "v", "w"] and len(merged.rows.collect()) == 17
    with pytest.raises(checks.CheckFailed, match="3 rows"):
        merged.verify()


def test_grids_that_differ_are_refused(spark):
    rows = [(1, 0.1, "EPSG:4326", 1.0), (2, 0.1, "EPSG:4326", 2.0)]
    table = lambda more: spark.createDataFrame(rows + more, "i int, step double, crs string, v double")
    good = checks.grid_checked(table([]), ["step", "crs"], ["v"])
    good.rows.collect()
    good.verify()
    for more, what in (([(3, 0.2, "EPSG:4326", 1.0)], "step differs"), ([(3, 0.1, "EPSG:3857", 1.0)], "crs differs"), ([(3, 0.1, None, 1.0)], "crs is missing"), ([(3, 0.1, "EPSG:4326", float("nan"))], "v is missing in 1")):
        bad = checks.grid_checked(table(more), ["step", "crs"], ["v"])
        bad.rows.collect()
        with pytest.raises(checks.CheckFailed, match=what):
            bad.verify()


def test_checks_on_the_stand_in_tables(spark):
    v = Views(spark, SF)
    merged = checks.merge_none_lost(v("g_tile"), v("g_roi").select("roi_id", "continent"), ["roi_id"])
    n = merged.rows.count()
    assert merged.verify()["rows"] == n == v("g_tile").count()
