"""What a task keeps does not grow with the keys that it reads."""

import random
import re
from collections import defaultdict

from hydrospark.catalog import QUERIES
from hydrospark.operators.evaluation import counted, stratified_f1

SF = "/root/testdata/sf0.001"
PIXELS = "tile_id string, continent int, clim_zone int, coast boolean, targ int, pred int"


def test_stratified_f1_keeps_no_sums_for_each_tile(spark):
    plan = QUERIES["stratified_f1"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keyed = [k for k in re.findall(r"Aggregate\(keys?=\[(.*?)\], functions", plan) if "tile_id" in k]
    # tiles are dealt once, to a number of tasks that Spark does not lower, and not spread over strata
    assert not keyed and plan.count("hashpartitioning(tile_id") == 1 and "REPARTITION_BY_NUM" in plan


def test_counted_rows_are_as_many_as_before(spark):
    rows = spark.createDataFrame([("t", 1, None, True, 0, 1)] * 5000 + [(None, 1, 2, None, 2, 2)] * 3, PIXELS).coalesce(1)
    got = counted(rows).collect()
    assert len(got) < 20 and sum(r["n"] for r in got if r["tile_id"] == "t" and r["clim_zone"] is None) == 5000 and sum(r["n"] for r in got if r["tile_id"] is None and r["coast"] is None) == 3


def test_stratified_f1_by_brute_force(spark):
    # a tile may lie in several strata, a zone, a coast flag and a tile's name may be missing, one tile has a third of all pixels
    rng = random.Random(7)
    name = lambda: rng.choice(["hot", *[f"t{k}" for k in range(40)], None]) if rng.random() > 0.3 else "hot"
    rows = [(name(), rng.randint(1, 3), rng.choice([None, 1, 2, 3]), rng.choice([None, True, False]), rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1, 2])) for _ in range(600)]
    hits, tiles = defaultdict(lambda: [0, 0, 0]), defaultdict(set)
    for tile, continent, zone, coast, t, p in rows:
        if t is None or p is None:
            continue
        for s in (("all", "all"), ("continent", str(continent)), *([("clim_zone", str(zone))] if zone else []), ("coast", "coast" if coast else "inland")):
            tiles[s] |= {tile} - {None}
            hits[*s, t][0 if t == p else 2] += 1
            if t != p:
                hits[*s, p][1] += 1
    expected = {(s, v, c): (round(2 * tp / (2 * tp + fp + fn), 9), len(tiles[s, v])) for (s, v, c), (tp, fp, fn) in hits.items()}
    got = {(r["stratum"], r["value"], r["class"]): (round(r["f1"], 9), r["n_tiles"]) for r in stratified_f1(spark.createDataFrame(rows, PIXELS)).collect()}
    assert got == expected
