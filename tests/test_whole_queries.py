"""Registered queries that leave no part of their tables out."""

import datetime

from pyspark.sql import functions as F

from hydrospark.catalog import QUERIES
from hydrospark.operators.events import count_by_domain, drop_near_existing
from hydrospark.operators.iterative import balanced_partitions
from hydrospark.operators.spatial import lines_hit_grid
from hydrospark.sources.views import Views

SF = "/root/testdata/sf0.001"


def test_area_average_takes_all_days(spark):
    found = QUERIES["area_average_all_days"](spark, SF)
    last = Views(spark, SF)("g_weather").agg(F.max("day").alias("d")).first()["d"]
    assert found.agg(F.max(F.year("day"))).first()[0] == last.year
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, QUERIES["area_average"](spark, SF).collect()))


def test_floods_grow_from_all_river_tiles(spark):
    v = Views(spark, SF)
    rivers = {(r["roi_id"], r["tx"], r["ty"]) for r in lines_hit_grid(v("g_river"), v("g_tile"), 500).collect()}
    got = {(r["roi_id"], r["tx"], r["ty"]) for r in QUERIES["grow_flood_extent"](spark, SF).collect()}
    assert rivers and rivers <= got


def test_all_basins_are_counted(spark):
    found = {r["k"]: r["n"] for r in QUERIES["count_by_domain_all_basins"](spark, SF).collect()}
    assert sum(found.values()) == Views(spark, SF)("g_basin").count() and all(found[k] for k in (4, 8, 12, 16))
    few = spark.createDataFrame([(1,), (1,)], "z int")
    assert {r["k"]: r["n"] for r in count_by_domain(few, "z", {1: "a", 2: "b"}).collect()} == {1: 2, 2: 0}


def test_candidates_near_no_site_are_kept(spark):
    day = datetime.date(2000, 1, 1)
    row = lambda i, x, d: (i, day + datetime.timedelta(d), x, 0.0, x + 1.0, 1.0)
    box = "day date, xlo double, ylo double, xhi double, yhi double"
    # 1 shares area, 2 is near in both, 3 is not near in time any more, 4 not in space, 5 only touches and is late
    candidates = spark.createDataFrame([row(1, 0.5, 900), row(2, 3.0, 19), row(3, 3.0, 20), row(4, 9.0, 0), row(5, 1.0, 900)], f"event_id long, {box}")
    sites = spark.createDataFrame([row(0, 0.0, 0)], f"basin_key long, {box}").withColumnRenamed("day", "began")
    assert sorted(r["event_id"] for r in drop_near_existing(candidates, sites).collect()) == [3, 4, 5]


def test_the_time_of_day_counts(spark):
    at = lambda h: datetime.datetime(2000, 1, 21, h)
    candidates = spark.createDataFrame([(1, at(0), 3.0, 0.0, 4.0, 1.0), (2, at(1), 3.0, 0.0, 4.0, 1.0)], "event_id long, day timestamp_ntz, xlo double, ylo double, xhi double, yhi double")
    sites = spark.createDataFrame([(datetime.datetime(2000, 1, 1, 0, 30), 0.0, 0.0, 1.0, 1.0)], "began timestamp_ntz, xlo double, ylo double, xhi double, yhi double")
    assert [r["event_id"] for r in drop_near_existing(candidates, sites).collect()] == [2]


def test_gauges_and_sites_count_and_are_assigned(spark):
    basins = spark.createDataFrame([(i, i % 2, 1) for i in range(10)], "hybas_id long, continent int, clz_cl_smj int")
    points = spark.createDataFrame([("gauge", i, i // 4) for i in range(20)], "kind string, id long, hybas_id long")
    found = {r["hybas_id"]: r["part"] for r in balanced_partitions(basins, points=points).collect()}
    assert len({found[i] for i in range(5)}) >= 4
    assigned = QUERIES["partition_assignments"](spark, SF).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert {r["kind"] for r in assigned} == {"gauge", "labelled", "generated"} and all(r["n"] == r["d"] for r in assigned)
