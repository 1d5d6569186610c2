"""Products by name: seams, missing tiles, tiles that are not read."""

import pytest
from pyspark.sql import functions as F

from hydrospark.sources import products


@pytest.fixture()
def known(spark, tmp_path):
    pixels = spark.range(13 * 13).select((F.col("id") % 13).cast("double").alias("x"), F.floor(F.col("id") / 13).cast("double").alias("y"), "id")
    seamed = products.Product("dem", 4, f"{tmp_path}/dem", products.without_seam(4))
    plain = products.Product("cover", 4, f"{tmp_path}/cover")
    holes = products.Product("holes", 4, f"{tmp_path}/holes")
    products.write_product(pixels, seamed, seam=True)
    products.write_product(pixels, plain)
    products.write_product(pixels.where("NOT (x >= 4 AND x < 8 AND y < 4)"), holes)
    return products.Products(spark).add(seamed).add(plain).add(holes)


def held(df):
    return sorted((r["x"], r["y"], r["id"]) for r in df.collect())


def test_a_seam_counts_once(spark, known):
    stored = spark.read.parquet(known.known["dem"].path)
    assert stored.count() > stored.select("id").distinct().count()
    box = (1.0, 2.0, 9.5, 7.0)
    want = sorted((float(x), float(y), y * 13 + x) for x in range(1, 10) for y in range(2, 8))
    assert held(known.mosaic("dem", box)) == held(known.mosaic("cover", box)) == want


def test_missing_tiles(known):
    with pytest.raises(products.MissingTiles, match=r"\(0, 4\)"):
        known.mosaic("holes", (1.0, 1.0, 9.0, 5.0))
    got = held(known.mosaic("holes", (1.0, 1.0, 9.0, 5.0), lenient=True))
    assert got == sorted((float(x), float(y), y * 13 + x) for x in range(1, 10) for y in range(1, 6) if not (4 <= x < 8 and y < 4))
    assert held(known.mosaic("holes", (8.0, 1.0, 9.0, 3.0))) and known.mosaic("holes", (50.0, 50.0, 51.0, 51.0), lenient=True).count() == 0


def test_unknown_and_repeated_names(known):
    with pytest.raises(KeyError, match="cover, dem, holes"):
        known.mosaic("slope", (0.0, 0.0, 1.0, 1.0))
    with pytest.raises(ValueError):
        known.add(known.known["dem"])


def test_other_tiles_are_not_read(known):
    plan = known.mosaic("cover", (1.0, 1.0, 3.0, 3.0))._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "north" in filters and "east" in filters and "ReadSchema: struct<x:double,y:double,id:bigint>" in plan


def test_many_areas_at_once(spark, known):
    boxes = [(1, 0.0, 0.0, 3.0, 3.0), (2, 2.0, 3.0, 9.0, 6.0), (3, 4.0, 4.0, 4.0, 4.0), (4, 90.0, 0.0, 91.0, 1.0)]
    areas = spark.createDataFrame(boxes, "k long, xlo double, ylo double, xhi double, yhi double")
    for name in ("dem", "cover", "holes"):
        got = {}
        for r in known.mosaics(name, areas, "k").collect():
            got.setdefault(r["k"], []).append((r["x"], r["y"], r["id"]))
        for k, *box in boxes:
            assert sorted(got.get(k, [])) == held(known.mosaic(name, tuple(box), lenient=True)), (name, k)
