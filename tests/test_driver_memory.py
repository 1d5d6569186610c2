"""Joins of sides that grow are never collected on the driver, and rows that are alike are one until they have met."""

import pytest
from pyspark.sql import functions as F

from hydrospark.catalog import QUERIES
from hydrospark.operators import events, iterative, lines, quadtree, spatial
from hydrospark.plans import components, joins

SF = "/root/testdata/sf0.001"
BOX = "xlo double, ylo double, xhi double, yhi double"


def joins_of(df):
    """The joins of the plan that Spark makes before it has seen any rows, and of the one that it ends with."""
    execution = df._jdf.queryExecution()
    first = execution.executedPlan().toString()
    df.write.format("noop").mode("overwrite").save()
    return first


@pytest.mark.parametrize("name", ["spatial_join", "overlap_join", "points_in_areas", "points_in_rings", "crowded_points_in_areas", "covered_share", "climate_zone_of", "zone_counts", "flood_distribution", "time_overlap_join", "storm_flood_basins", "storm_floods", "uncovered_storms"])
def test_no_side_is_collected_whole(spark, name):
    plan = joins_of(QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_deals_are_not_collected(spark):
    found = iterative.balanced_partitions(spark.range(40).selectExpr("id AS hybas_id", "CAST(id % 3 AS INT) AS clz_cl_smj", "CAST(id % 2 AS INT) AS continent"), 2, 2)
    # the best trial is one row
    assert joins_of(found).count("BroadcastHashJoin") == 1 and found.count() == 40


def test_a_tile_meets_its_basin_without_a_broadcast(spark):
    tiles = spark.createDataFrame([(1, 10, 0.0, 0.0, 0.25, 0.25), (1, 11, 9.0, 9.0, 9.25, 9.25)], f"roi_id long, tile_id long, {BOX}")
    basins = spark.createDataFrame([(8, 0.0, 0.0, 3.0, 3.0), (7, 0.0, 0.0, 3.0, 3.0)], f"hybas_id long, {BOX}")
    found = spatial.majority_basin(tiles, basins)
    # only the table of one row a ROI may be collected
    assert joins_of(found).count("BroadcastHashJoin") <= 1
    assert sorted(found.collect()) == [(1, 10, 7, False), (1, 11, 7, True)]


@pytest.mark.parametrize("find", [spatial.points_in_areas, quadtree.crowded_points_in_areas])
def test_equal_areas_are_compared_once(spark, find, monkeypatch):
    areas = spark.createDataFrame([(k, 0.0, 0.0, 1.0, 1.0) for k in range(50, 1, -1)] + [(1, 5.0, 5.0, 6.0, 6.0)], f"k long, {BOX}")
    points = spark.createDataFrame([("a", 0.5, 0.5), ("b", 5.0, 5.5), ("c", 3.0, 3.0)], "n string, px double, py double")
    assert sorted(find(points, areas, "k").collect()) == [("a", 0.5, 0.5, 2), ("b", 5.0, 5.5, 1)]
    assert spatial.unequal(areas, "k").count() == 2


def test_equal_rings_are_told_from_equal_boxes(spark):
    at = lambda *corners: [{"x": float(x), "y": float(y)} for x, y in corners]
    low, high, box = at((0, 0), (2, 0), (0, 2)), at((2, 0), (2, 2), (0, 2)), (0.0, 0.0, 2.0, 2.0)
    areas = spark.createDataFrame([(4, low, *box), (3, low, *box), (2, high, *box)], f"k long, ring array<struct<x:double,y:double>>, {BOX}")
    points = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5)], "px double, py double")
    assert sorted(spatial.points_in_areas(points, areas, "k").collect()) == [(0.5, 0.5, 3), (1.5, 1.5, 2)]


def test_repeated_rows_count_as_often_as_they_are_there(spark):
    areas = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0), (3, 8.0, 8.0, 9.0, 9.0)], f"k long, {BOX}")
    boxes = spark.createDataFrame([(10, 0.0, 0.0, 0.5, 0.5), (20, 0.0, 0.0, 0.5, 0.5), (5, 0.5, 0.5, 1.0, 1.0)], f"ids long, {BOX}")
    assert sorted(spatial.met_boxes(areas, boxes, "k", "ids").collect()) == [(1, 3, 35), (2, 6, 70)]
    assert sorted(spatial.covered_share(areas, boxes, 0.5, "k").collect()) == [(1, 0.5), (2, 1.0)]
    zones = areas.withColumnsRenamed({"k": "hybas_id"}).withColumn("clz_cl_smj", F.lit(4))
    assert spatial.zone_counts(zones, boxes.where("ids = 5").withColumn("s", F.lit("x")), "s", 0.2).collect() == [("x", 4, 3)]
    both = events.flood_distribution(zones.withColumn("continent", F.lit(2)), boxes.withColumnRenamed("ids", "id"), 0.2)
    assert sorted(both.collect(), key=repr) == sorted([(2, 4, 9), (2, None, 9), (None, None, 9)], key=repr)


def test_floods_of_one_time_are_one_until_they_have_met(spark):
    at = "date'2000-01-{}'".format
    floods = spark.sql(f"SELECT id, {at('05')} AS began, {at('09')} AS ended FROM VALUES (1), (2) v(id) UNION ALL SELECT 4, {at('20')}, {at('21')}")
    storms = spark.sql(f"SELECT s AS storm_key, {at('01')} AS first_track, {at('06')} AS last_track FROM VALUES ('a'), ('b'), ('b') v(s) UNION ALL SELECT 'c', {at('09')}, {at('20')}")
    assert sorted(events.floods_of_storms(floods, storms).collect()) == [("a", 2, 3), ("b", 4, 6)]


def test_storms_are_covered_where_they_meet_as_by_the_pairs(spark):
    at = "date'2000-01-{}'".format
    floods = spark.sql(f"SELECT id, {at('05')} AS began, {at('09')} AS ended, 0D AS xlo, 0D AS ylo, 4D AS xhi, 4D AS yhi FROM VALUES (1), (2), (3) v(id)")
    storms = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0), ("b", 3.0, 3.0, 5.0, 5.0), ("b", -1.0, -1.0, 1.5, 1.5), ("c", 50.0, 0.0, 51.0, 1.0)], f"storm_key string, {BOX}").withColumns({"first_track": F.lit("2000-01-01").cast("date"), "last_track": F.lit("2000-01-07").cast("date")})
    chosen = spark.createDataFrame([(1, 0.5, 0.5, 1.5, 1.5), (1, 9.0, 9.0, 9.5, 9.5), (2, 1.0, 1.0, 2.0, 2.0)], f"id int, {BOX}")
    want = sorted(events.uncovered_storms(events.storm_floods(floods, storms), chosen, storms).collect())
    found = events.uncovered_meetings(floods, storms, chosen)
    # the pairs stay where they are made
    assert joins_of(found).count("SortMergeJoin") == 3
    assert sorted(found.collect()) == want == [(2, "b"), (2, "b"), (3, "a"), (3, "b"), (3, "b")]


def test_no_point_carries_its_line(spark):
    points = spark.sql("SELECT 1 AS i, transform(sequence(0, 4), k -> struct(CAST(k AS DOUBLE) AS x, CAST(k % 2 AS DOUBLE) AS y)) AS points")
    seen = []
    keep = lines.written
    lines.written, back = lambda df, name: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df, name))[1], lines.written
    try:
        assert len(lines.simplified(points, "i", 0.2).first()["points"]) == 5
    finally:
        lines.written = back
    above = seen[0].split("Generate")[0]
    assert "element_at" not in above and "size(" not in above


def test_many_edges_are_merged(spark, monkeypatch):
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b").where("a % 10 <> 9")
    monkeypatch.setattr(joins, "MANY", 10)
    hinted = joins.by_size(edges, 11).join(edges.withColumnRenamed("b", "c"), "a")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in hinted and "SortMergeJoin" in hinted
    assert {r["label"] for r in components.components(edges).collect()} == {0, 10, 20, 30}
