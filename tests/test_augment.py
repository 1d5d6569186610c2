"""Augmented tiles, context windows, names, merges that lose nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators import events, projections, tiles
from hydrospark.plans.checks import CheckFailed


def some_tiles(spark, n=300, side=4, high=3):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 9, side * high)], [int(x) for x in rng.integers(0, 3, side * high)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, v array<double>, lab array<int>")


def mean_of_nine(a):
    out = np.zeros(a.shape)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            out[y, x] = a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean()
    return out


def test_flip_and_blur(spark):
    rows, df = some_tiles(spark)
    got = {r["vec_id"]: r for r in projections.augment_tiles(df, "v", 4, seed=5, noise=0.0, label="lab", flip=0.4, blur=0.3).collect()}
    for i, v, lab in rows:
        want, own = np.array(v).reshape(3, 4), np.array(lab).reshape(3, 4)
        if got[i]["blurred"]:
            want = mean_of_nine(want)
        if got[i]["flipped"]:
            want, own = want[:, ::-1], own[:, ::-1]
        assert got[i]["augmented"] == pytest.approx(want.ravel().tolist()) and got[i]["lab"] == own.ravel().tolist()
    assert 0.3 < np.mean([r["flipped"] for r in got.values()]) < 0.5 and 0.2 < np.mean([r["blurred"] for r in got.values()]) < 0.4


def test_noise_is_normal_and_repeatable(spark):
    rows, df = some_tiles(spark, 800)
    make = lambda d, seed=0: {r["vec_id"]: r["augmented"] for r in projections.augment_tiles(d, "v", 4, seed=seed, noise=0.5, flip=0.0).collect()}
    got = make(df)
    assert got == make(df.repartition(5)) and got != make(df, 1)
    draws = np.array([(a - x) / (0.5 * max(v)) for i, v, _ in rows for a, x in zip(got[i], v) if max(v)])
    assert abs(draws.mean()) < 0.05 and abs(draws.std() - 1) < 0.05 and abs((np.abs(draws) < 1).mean() - 0.683) < 0.03 and abs(np.corrcoef(draws[:-1], draws[1:])[0, 1]) < 0.05


def test_context_windows(spark):
    df = spark.createDataFrame([(1.05, -0.31, 1.29, 0.2), (2.0, 2.0, 2.1, 2.1)], "xlo double, ylo double, xhi double, yhi double")
    a, b = projections.context_window(df, (0.1, 0.0, 0.0, 0.0, -0.1, 10.0), 2).collect()
    assert (a["pxlo"], a["pxhi"], a["pylo"], a["pyhi"]) == (8, 15, 96, 106)
    assert (a["xlo"], a["xhi"], a["ylo"], a["yhi"]) == pytest.approx((0.8, 1.5, -0.6, 0.4))
    assert (b["pxlo"], b["pxhi"], b["pylo"], b["pyhi"]) == (18, 23, 77, 82)


def test_keys_and_stems(spark):
    df = spark.createDataFrame([("4459-4080025450", "2018-03-02"), ("KS-1", "2018-03-02"), (None, "2018-03-02")], "k string, d string").withColumn("d", F.col("d").cast("date"))
    got = [tuple(r) for r in df.select(projections.flood_of_key(F.col("k")), projections.scene_stem(F.col("k"), F.col("d"))).collect()]
    assert got == [(4459, "4459-4080025450-2018-03-02"), (None, "KS-1-2018-03-02"), (None, "2018-03-02")]


def test_causes_of_sites(spark):
    rois = spark.createDataFrame([(1, "generated", 0, "7-1"), (2, "kurosiwo", 0, "7-1"), (3, "generated", 1, "8-1"), (4, "generated", 1, "x")], "roi_id long, type string, fold int, key string")
    t = spark.createDataFrame([(i, 5, 0.0, 0.0, 1.0, 1.0) for i in (1, 2, 3, 4)], "roi_id long, n_flooded long, xlo double, ylo double, xhi double, yhi double")
    floods = spark.createDataFrame([(7, "Heavy rain")], "id long, maincause string")
    got = {r["roi_id"]: r["cause"] for r in tiles.site_summary(rois, t, F.col("n_flooded") > 3, 0, floods).collect()}
    assert got == {1: "Heavy rain", 2: None, 3: None, 4: None}


def test_merges_that_lose_rows_raise(spark):
    rows, needed, more = (spark.createDataFrame(x, s) for x, s in (([(1, 5), (2, 6)], "k int, m int"), ([(1, "a")], "k int, n string"), ([(5, "z")], "m int, o string")))
    merged = events.attr_merge(rows, needed, ["k"], more, ["m"])
    assert [tuple(r) for r in merged.rows.select("k", "n", "o").collect()] == [(1, "a", "z")]
    with pytest.raises(CheckFailed, match="1 rows"):
        merged.verify()
