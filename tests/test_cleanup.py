"""The clean-up chain of maps, reports by zone and labelled sites, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from hydrospark.catalog import QUERIES
from hydrospark.operators import events, iterative, selection
from hydrospark.operators.evaluation import flatten_classes, stratified_f1
from hydrospark.sources.views import Views

SF = "/root/testdata/sf0.001"


def most_common(values):
    counts = Counter(values)
    return min(counts, key=lambda v: (-counts[v], v))


def cleaned(cells, keep, ocean=None, most=50, grow=2):
    """The chain for one ROI: {(x, y): class}."""
    disk = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
    smooth = {(x, y): most_common(cells[x + i, y + j] for i, j in disk if (x + i, y + j) in cells) for x, y in cells}
    region, seen = [], set()
    for start in smooth:
        if start not in seen:
            part, queue = set(), [start]
            while queue:
                x, y = queue.pop()
                if (x, y) not in part:
                    part.add((x, y))
                    queue += [n for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if smooth.get(n) == smooth[x, y]]
            seen |= part
            region.append(part)
    xs, ys = [x for x, _ in smooth], [y for _, y in smooth]
    out = dict(smooth)
    for part in region:
        px, py = [x for x, _ in part], [y for _, y in part]
        if smooth[next(iter(part))] in (1, 2) and len(part) < most and min(px) > min(xs) and max(px) < max(xs) and min(py) > min(ys) and max(py) < max(ys):
            new = most_common(v for (x, y), v in smooth.items() if min(px) - grow <= x <= max(px) + grow and min(py) - grow <= y <= max(py) + grow)
            out |= dict.fromkeys(part, new)
    out = {k: v for k, v in out.items() if k in keep}
    for k, cover in (ocean or {}).items():
        if k in out and cover in (None, 80):
            out[k] = 1
    return out


def test_clean_up_chain(spark):
    rng = random.Random(1)
    grids = {}
    for roi in (1, 2):
        cells = {(x, y): 0 for x in range(26) for y in range(20) if rng.random() < 0.98}
        for _ in range(7):
            cx, cy, r, v = rng.randrange(26), rng.randrange(20), rng.randrange(1, 5), rng.choice([1, 2])
            cells |= {(x, y): v for x, y in cells if (x - cx) ** 2 + (y - cy) ** 2 <= r * r}
        grids[roi] = {k: (rng.randrange(3) if rng.random() < 0.1 else v) for k, v in cells.items()}
    keep = {roi: {k for k in g if rng.random() < 0.9} for roi, g in grids.items()}
    ocean = {roi: {k: rng.choice([80, 10, None]) for k in g if rng.random() < 0.2} for roi, g in grids.items()}
    table = lambda of, kind: spark.createDataFrame([(roi, x, y, *rest) for roi, g in of.items() for (x, y), *rest in (g.items() if isinstance(g, dict) else ((k,) for k in g))], f"roi_id long, gx long, gy long{kind}")
    for sea in (None, ocean):
        got = iterative.postprocess_maps(table(grids, ", value int"), table(keep, ""), None if sea is None else table(sea, ", cover int"))
        found = {}
        for r in got.collect():
            found.setdefault(r["roi_id"], {})[r["gx"], r["gy"]] = r["value"]
        want = {roi: cleaned(g, keep[roi], sea and sea[roi]) for roi, g in grids.items()}
        assert found == want
    assert any(v in (1, 2) for v in want[1].values()) and found != {roi: cleaned(g, keep[roi]) for roi, g in grids.items()}


def test_clean_up_query(spark):
    v = Views(spark, SF)
    keep, ocean = iterative._layers(v)
    grids, kept, sea = {}, {}, {}
    for r in iterative._cells(v).collect():
        grids.setdefault(r["roi_id"], {})[r["gx"], r["gy"]] = r["value"]
    for r in keep.collect():
        kept.setdefault(r["roi_id"], set()).add((r["gx"], r["gy"]))
    for r in ocean.collect():
        sea.setdefault(r["roi_id"], {})[r["gx"], r["gy"]] = r["cover"]
    found = {}
    for r in QUERIES["postprocess_maps"](spark, SF).collect():
        found.setdefault(r["roi_id"], {})[r["gx"], r["gy"]] = r["value"]
    want = {roi: cleaned(g, kept.get(roi, set()), sea.get(roi, {})) for roi, g in grids.items()}
    assert found == {roi: w for roi, w in want.items() if w}


def test_report_by_zone(spark):
    expected = spark.createDataFrame([(1, 1, 4), (1, 2, 6), (2, 1, 1)], "continent int, zone int, basins long")
    covered = spark.createDataFrame([(1, 1, 3, True), (1, 1, 1, False), (2, 3, 2, True), (2, 1, 5, False)], "continent int, zone int, n long, flooding boolean")
    got = {(r["by"], r["value"]): (r["expected"], r["created"], r["negative"]) for r in events.distribution_report(expected, covered).collect()}
    assert got == {("continent", 1): (10, 3, 0.5), ("continent", 2): (1, 2, 2.5), ("zone", 1): (5, 3, 3.0), ("zone", 2): (6, 0, 0.0), ("zone", 3): (0, 2, 0.0)}


def test_zones_of_overlapping_tiles(spark):
    box = "xlo double, ylo double, xhi double, yhi double"
    basins = spark.createDataFrame([(1, 5, 0.0, 0.0, 1.0, 1.0), (2, 5, 1.0, 0.0, 2.0, 1.0), (3, 6, 0.0, 1.0, 1.0, 2.0)], f"hybas_id long, clz_cl_smj int, {box}")
    # site 1 covers 0.4 of basin 1 twice over and a third of 3, site 2 two quarters of basin 2 that overlap by half
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.4), (1, 0.0, 0.0, 1.0, 0.4), (1, 0.1, 1.0, 0.4, 2.0), (2, 1.0, 0.0, 1.5, 0.5), (2, 1.0, 0.25, 1.5, 0.75)], f"k long, {box}")
    got = sorted(map(tuple, selection.zones_of_tiles(basins, tiles, "k", 0.3).collect()))
    assert got == [(1, 5, 1), (2, 5, 1)]  # 0.3 is not more than 0.3


def test_single_scan_of_stratified_f1(spark):
    pixels = flatten_classes(Views(spark, SF)("g_pixel"))
    plan = stratified_f1(pixels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    # a tile that lies in two strata counts in both, once each
    rows = [("t", 1, 1, True, 0, 0), ("t", 1, 2, True, 1, 0), ("t", 2, None, False, 2, 2), ("u", 1, 1, True, 1, 1)]
    df = spark.createDataFrame(rows, "tile_id string, continent int, clim_zone int, coast boolean, targ int, pred int")
    got = {(r["stratum"], r["value"], r["class"]): (round(r["f1"], 6), r["n_tiles"]) for r in stratified_f1(df).collect()}
    assert got[("all", "all", 0)] == (round(2 / 3, 6), 2) and got[("continent", "1", 1)] == (round(2 / 3, 6), 2) and got[("continent", "2", 2)] == (1.0, 1)
    assert got[("clim_zone", "1", 1)] == (1.0, 2) and ("clim_zone", "None", 2) not in got and got[("coast", "inland", 2)] == (1.0, 1)


def test_labelled_footprints(spark):
    rois = spark.createDataFrame([(1, "kurosiwo"), (2, "generated")], "roi_id long, type string").withColumn("post_date", F.lit("2000-01-01").cast("date"))
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 2.0, 2.0), (2, 0.0, 0.0, 1.0, 1.0)], "roi_id long, xlo double, ylo double, xhi double, yhi double")
    got = selection.label_footprints(rois, tiles).collect()
    assert [r["roi_id"] for r in got] == [1] and {(p["x"], p["y"]) for p in got[0]["ring"]} == {(0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (0.0, 1.0)}
