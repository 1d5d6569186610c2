"""Hand-worked cases and properties of the operators that SQL does not check, or not enough."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators import iterative, rasters, scoring, spatial, tiles
from hydrospark.operators.evaluation import confusion_matrix, flatten_classes
from hydrospark.plans.components import components, reached
from hydrospark.plans.scratch import new_path
from hydrospark.sources import scans
from hydrospark.sources.views import Views
from hydrospark.streaming.scenes import CACHE, follow_results

SF = "/root/testdata/sf0.001"


def test_components_and_reached(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (52, 51)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(21)) and {found[50], found[51], found[52]} == {50}
    steps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "node long, next long")
    got = {(r["node"], r["level"]) for r in reached(spark.createDataFrame([(1, 1)], "root long, node long"), steps).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cell_join_is_the_nested_loop_join(spark):
    rng = np.random.default_rng(1)
    box = lambda n: [(int(i), *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(rng.uniform(-20, 20, n), rng.uniform(-20, 20, n), rng.integers(0, 9, n), rng.integers(0, 9, n)))]
    a = spark.createDataFrame(box(60), "i long, xlo double, ylo double, xhi double, yhi double")
    b = spark.createDataFrame(box(60), "j long, xlo double, ylo double, xhi double, yhi double")
    got = sorted((r["i"], r["j"]) for r in spatial.spatial_join(a, b, 2.5).collect())
    want = sorted((p["i"], q["j"]) for p in a.collect() for q in b.collect() if p["xlo"] <= q["xhi"] and q["xlo"] <= p["xhi"] and p["ylo"] <= q["yhi"] and q["ylo"] <= p["yhi"])
    assert got == want


def test_touching_boxes_meet_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 3.0)], "i long, xlo double, ylo double, xhi double, yhi double")
    b = spark.createDataFrame([(2, 3.0, 3.0, 6.0, 6.0)], "j long, xlo double, ylo double, xhi double, yhi double")
    assert spatial.spatial_join(a, b, 3.0).count() == 1


def test_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    row = spark.range(1).select(*[spatial.ring_holds(ring, F.lit(x), F.lit(y)).alias(n) for n, x, y in (("a", 0.5, 0.5), ("b", 2.0, 3.0), ("c", 3.7, 3.0), ("d", 5.0, 1.0))], spatial.ring_area(ring).alias("area")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (True, False, True, False) and row["area"] == pytest.approx(10.0)


def test_hull(spark):
    points = spark.createDataFrame([(1, float(x), float(y)) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0))], "k long, px double, py double")
    ring = spatial.hull(points, "k").first()["ring"]
    assert [(p["x"], p["y"]) for p in ring] == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_coast_band_of_a_block(spark):
    block = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "gx long, gy long")
    got = {tuple(r) for r in spatial.coast_band(block).collect()}
    inner = {(x, y) for x in (1, 2) for y in (1, 2)}
    assert got == {(x, y) for x in range(-1, 5) for y in range(-1, 5)} - inner


GRID = ["111000", "100020", "100020", "000000", "002200", "000000"]


def cells(spark, grid=GRID):
    return spark.createDataFrame([(1, x, y, int(c)) for y, line in enumerate(grid) for x, c in enumerate(line)], "roi_id long, gx long, gy long, value int")


def test_connected_regions(spark):
    sizes = sorted(r["n"] for r in iterative.connected_regions(cells(spark), "roi_id").groupBy("region", "value").agg(F.count("*").alias("n")).collect())
    assert sizes == [2, 2, 5, 27]


def test_fill_small_holes_leaves_the_edge_alone(spark):
    got = {(r["gx"], r["gy"]): r["value"] for r in iterative.fill_small_holes(cells(spark), "roi_id", 5, 1).collect()}
    assert got[0, 0] == 1 and got[4, 1] == 0 and got[2, 4] == 0


def test_grow_walk_and_sets_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(r, x, y, bool(rng.random() < 0.5), bool(rng.random() < 0.1)) for r in (1, 2) for x in range(8) for y in range(8)]
    t = spark.createDataFrame(rows, "roi_id long, tx long, ty long, flooded boolean, open boolean")
    starts = t.where("tx = 3 AND ty = 3")
    every = sorted(map(tuple, iterative.grow_flood_extent(t, starts).collect()))
    assert every == sorted(map(tuple, iterative.grow_flood_extent(t, starts, most=10_000).collect()))
    assert len(iterative.grow_flood_extent(t, starts, most=1).collect()) == 2


def test_balanced_partitions(spark):
    basins = Views(spark, SF)("g_basin")
    found = iterative.balanced_partitions(basins)
    assert found.count() == basins.count() == found.select("hybas_id").distinct().count()
    per_zone = found.groupBy("clz_cl_smj", "part").count().groupBy("clz_cl_smj").agg((F.max("count") - F.min("count")).alias("d"))
    assert per_zone.agg(F.max("d")).first()[0] <= 1


def test_fold_stats_and_own_fold_are_the_total(spark):
    rows = spark.createDataFrame([("b", i % 5, float(i * i % 17)) for i in range(200)], "band string, fold int, value double")
    others = {r["fold"]: r for r in rasters.fold_stats(rows).collect()}
    values = {k: [float(i * i % 17) for i in range(200) if i % 5 != k] for k in range(5)}
    for k, v in values.items():
        assert others[k]["n"] == len(v) and others[k]["mean"] == pytest.approx(np.mean(v)) and others[k]["std"] == pytest.approx(np.std(v))


def test_confusion_sums_to_valid_pixels_however_dealt(spark):
    pixels = flatten_classes(Views(spark, SF)("g_pixel"))
    valid = pixels.where("targ IS NOT NULL AND pred IS NOT NULL").count()
    got = sorted(map(tuple, confusion_matrix(pixels).collect()))
    assert sum(r[2] for r in got) == valid
    assert got == sorted(map(tuple, confusion_matrix(pixels.repartition(7)).collect()))


def test_blend_is_the_plain_sum(spark):
    side, half, rng = 8, 4, np.random.default_rng(5)
    t = {(ox, oy, x, y): rng.random((side, side)) for ox in (0, 1) for oy in (0, 1) for x in range(2) for y in range(2) if rng.random() < 0.9 or (ox, oy) == (0, 0)}
    rows = spark.createDataFrame([(*k, v.ravel().tolist()) for k, v in t.items()], "ox int, oy int, tx long, ty long, values array<double>")
    w = scoring.edge_weights(side)
    for r in scoring.blend_offset_tiles(rows, side).collect():
        want = np.zeros((side, side))
        for i in range(3):
            for j in range(3):
                key = (int(j != 1), int(i != 1), r["tx"] - (j == 0), r["ty"] - (i == 0))
                dx, dy = (0 if j == 1 else half if j == 0 else -half), (0 if i == 1 else half if i == 0 else -half)
                if key in t:
                    for y in range(side):
                        for x in range(side):
                            if 0 <= x + dx < side and 0 <= y + dy < side:
                                want[y, x] += w[i, j][y, x] * t[key][y + dy, x + dx]
        assert np.allclose(np.array(r["blended"]).reshape(side, side), want)
    assert np.allclose(w.sum((0, 1)), 1)


def test_score_tiles_loads_the_model_in_tasks(spark):
    tiles_ = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 5.0])], "vec_id long, v array<double>")
    got = {r["vec_id"]: list(r["scores"]) for r in scoring.score_tiles(tiles_, "v", "vec_id", scoring.three_sums).collect()}
    assert got == {1: [1, 0, 0], 2: [0, 0, 5]}


def test_pixel_logreg_tells_classes_apart(spark):
    rows = spark.createDataFrame([(1, x, y, float(x < 5), int(x < 5)) for x in range(10) for y in range(10)], "roi_id long, gx long, gy long, value double, label int")
    weights = scoring.pixel_logreg(rows, "label")
    scores = scoring.pixel_logreg_scores(rows, weights).join(rows, ["roi_id", "gx", "gy"])
    assert scores.where((F.col("p") > 0.5).cast("int") != F.col("label")).count() == 0


def test_augment_keeps_values(spark):
    from hydrospark.operators.projections import augment_tiles

    t = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)], "vec_id long, v array<double>")
    got = augment_tiles(t, "v", 2, noise=0.0).collect()
    assert {r["flipped"] for r in got} == {True, False}
    assert all(list(r["augmented"]) == ([2, 1, 4, 3] if r["flipped"] else [1, 2, 3, 4]) for r in got)


def test_manifest_takes_exactly_one_list(spark):
    rows = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(ValueError):
        scans.manifest_filter(rows, "k")
    with pytest.raises(ValueError):
        scans.manifest_filter(rows, "k", rows, rows)


def test_cyclone_basin_na_is_no_null(spark, tmp_path):
    (tmp_path / "s.csv").write_text("YEAR,BASIN,NAME,FIRST,LAST\n1999,NA,FLOYD,1999090718,1999091900\n")
    r = scans.read_cyclones(spark, str(tmp_path)).first()
    assert r["storm_key"] == "1999_NA_FLOYD" and r["first_track"] == datetime.date(1999, 9, 7)


def test_files_of_metas_labels_folds_and_norms(spark, tmp_path):
    for i, m in enumerate(({"roi_id": 1, "type": "generated", "HYBAS_ID": 7}, {"roi_id": 2, "type": "kurosiwo", "HYBAS_ID_4": 8}, {"roi_id": 3, "type": "other"})):
        (tmp_path / f"{i}-meta.json").write_text(json.dumps(m, indent=1))
    got = scans.read_roi_meta(spark, f"{tmp_path}/*-meta.json", ["generated", "kurosiwo"]).select("roi_id", "basin").collect()
    assert sorted(map(tuple, got)) == [(1, 7), (2, 8)]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "info.json").write_text(json.dumps({"flood_date": "2020-01-01", "actid": 5}))
    assert scans.scan_label_tiles(spark, str(tmp_path / "a")).first()["actid"] == 5
    (tmp_path / "folds").mkdir()
    for k in range(2):
        (tmp_path / "folds" / f"floodmap_partition_{k}.txt").write_text(f"x{k}\ny{k}\n")
    assert sorted(map(tuple, scans.read_folds(spark, f"{tmp_path}/folds/*.txt").collect())) == [("x0", 0), ("x1", 1), ("y0", 0), ("y1", 1)]
    scans.write_norms(spark.createDataFrame([("t", 1.0, 2.0, 0)], "band string, mean double, std double, fold int"), str(tmp_path / "norms"))
    assert spark.read.csv(str(tmp_path / "norms"), header=True).count() == 1


def test_stream_adds_each_key_once(spark, tmp_path):
    arriving, cache, check = (new_path(spark, x) for x in ("arriving", "cache", "check"))
    for lot in ([("k1", "[1]"), ("k2", "[2]")], [("k2", "[9]"), ("k3", "[3]")]):
        spark.createDataFrame(lot, CACHE).write.mode("append").json(arriving)
        query = follow_results(spark, arriving, cache, check)
        assert query.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(cache).collect())) == [("k1", "[1]"), ("k2", "[2]"), ("k3", "[3]")]


def test_scans_reach_the_reader(spark):
    views = Views(spark, SF)
    path = new_path(spark, "basins")
    views("g_basin").write.parquet(path)
    plan = scans.scan_basins(spark.read.parquet(path), ["hybas_id"], (-30, -20, 60, 50))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(xhi)" in plan and "ReadSchema: struct<hybas_id:bigint,xlo:double" in plan


def test_upstream_has_no_nested_loop(spark):
    v = Views(spark, SF)
    plan = spatial.spatial_join(v("g_basin").select("hybas_id", "xlo", "ylo", "xhi", "yhi"), v("g_flood").select("id", "xlo", "ylo", "xhi", "yhi"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_run_diff_counts_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(1,), (3,)], "k long")
    assert sorted(map(tuple, tiles.run_diff(a, b).collect())) == [(1, "both"), (1, "only_a"), (2, "only_a"), (3, "only_b")]


def test_empty_tables_give_no_rows(spark):
    v = Views(spark, SF)
    none = v("g_tile").where("false")
    assert tiles.tile_distribution(none, "roi_id").count() == 0
    assert spatial.majority_basin(none, v("g_basin")).count() == 0
    assert iterative.connected_regions(cells(spark).where("false"), "roi_id").count() == 0
    assert rasters.majority_filter(cells(spark).where("false"), "roi_id").count() == 0
