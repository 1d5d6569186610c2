"""Joins in space where boxes crowd: cells that hold many small boxes are split into four, again and again.

A grid of one cell size makes one task of a crowded cell, and compares all of its boxes with all others there. Here a
histogram of both sides says which cells are crowded by boxes much smaller than themselves, and these are split; cells that large
boxes crowd stay whole, as splitting would only copy them. A box descends from the cells of the coarsest grid that it touches to
the leaves below, by one equi-join a level, so it is filed where its neighbours are few, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.operators.spatial import CELL, MARGIN, in_cells, ring_holds, unequal
from hydrospark.plans.joins import by_sort
from hydrospark.plans.registry import query
from hydrospark.plans.scratch import written

CROWDED = 2000  # boxes, from which a cell is split
DEPTH = 20  # splits of one cell at most: three degrees become three millionths of one
BOUNDS = ("xlo", "ylo", "xhi", "yhi")


def crowded_cells(sides: list[DataFrame], size: float = CELL, crowded: int = CROWDED, depth: int = DEPTH) -> DataFrame:
    """(level, cx, cy) of the cells to split: more than ``crowded`` boxes with their middle in it are at most half as wide and high as it is.

    Cells of level k are 2^k times smaller than ``size``. A box counts at all levels down to that of its size, and folds with
    its neighbours before it moves.
    """
    boxes = sides[0].select(*BOUNDS)
    for more in sides[1:]:
        boxes = boxes.unionByName(more.select(*BOUNDS))
    # the last level at which a cell is twice the box
    wide = F.greatest(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"), F.lit(size / 2.0**depth))
    last = F.least(F.floor(F.log2(F.lit(size) / wide)).cast("int") - 1, F.lit(depth - 1))
    at = boxes.where(last >= 0).select(((F.col("xlo") + F.col("xhi")) / 2).alias("x"), ((F.col("ylo") + F.col("yhi")) / 2).alias("y"), F.explode(F.sequence(F.lit(0), last)).alias("level"))
    of = lambda c: F.floor(F.col(c) / size * F.pow(F.lit(2.0), F.col("level")))
    return at.select("level", of("x").alias("cx"), of("y").alias("cy")).groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("level", "cx", "cy")


def touched(lo: Column, hi: Column, cell: Column, side: Column) -> Column:
    """The halves of a cell (their numbers at the next level, cells of width ``side``) that a span touches."""
    return F.sequence(F.greatest(cell * 2, F.floor((lo - MARGIN) / side)), F.least(cell * 2 + 1, F.floor((hi + MARGIN) / side)))


def in_leaves(boxes: DataFrame, splits: DataFrame, levels: int, size: float = CELL) -> DataFrame:
    """Each box once for each leaf (level, cx, cy) that it touches; ``splits`` has cells of levels below ``levels``."""
    at = in_cells(boxes, size).withColumn("level", F.lit(0))
    marked = splits.select("level", "cx", "cy", F.lit(True).alias("split"))
    for _ in range(levels):
        at = at.join(marked, ["level", "cx", "cy"], "left")
        side = F.lit(size) / F.pow(F.lit(2.0), F.col("level") + 1)
        leaf = lambda x, y, level: F.struct(level.alias("level"), x.cast("long").alias("cx"), y.cast("long").alias("cy"))
        across, up = touched(F.col("xlo"), F.col("xhi"), F.col("cx"), side), touched(F.col("ylo"), F.col("yhi"), F.col("cy"), side)
        parts = F.flatten(F.transform(across, lambda x: F.transform(up, lambda y: leaf(x, y, F.col("level") + 1))))
        kept = [c for c in at.columns if c not in ("level", "cx", "cy", "split")]
        at = at.select(*kept, F.explode(F.when(F.col("split"), parts).otherwise(F.array(leaf(F.col("cx"), F.col("cy"), F.col("level"))))).alias("leaf")).select(*kept, "leaf.*")
    return at


def crowd_join(a: DataFrame, b: DataFrame, size: float = CELL, crowded: int = CROWDED, depth: int = DEPTH) -> DataFrame:
    """Pairs of boxes that meet, edges included, as ``spatial_join`` has them; crowded cells are split. b's bounds are renamed to b_xlo and so on.

    Columns level, cx, cy must not be among those of the two sides.
    """
    splits = written(crowded_cells([a, b], size, crowded, depth), "crowded")
    last = splits.agg(F.max("level").alias("k")).first()["k"]
    levels = 0 if last is None else last + 1
    right = in_leaves(b, splits, levels, size).withColumnsRenamed({c: f"b_{c}" for c in BOUNDS})
    pairs = by_sort(in_leaves(a, splits, levels, size)).join(right, ["level", "cx", "cy"])
    meet = (F.col("xlo") <= F.col("b_xhi")) & (F.col("b_xlo") <= F.col("xhi")) & (F.col("ylo") <= F.col("b_yhi")) & (F.col("b_ylo") <= F.col("yhi"))
    side = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    # a pair counts in the leaf that holds the lower left corner of what it shares
    home = (F.col("cx") == F.floor((F.greatest("xlo", "b_xlo") - MARGIN) / side)) & (F.col("cy") == F.floor((F.greatest("ylo", "b_ylo") - MARGIN) / side))
    return pairs.where(meet & home).drop("level", "cx", "cy")


def crowded_points_in_areas(points: DataFrame, areas: DataFrame, key: str, size: float = CELL, crowded: int = CROWDED) -> DataFrame:
    """Each point (px, py and any other columns) with the least ``key`` of the areas (box, or ``ring`` with its box) that hold it; repeated
    points stay repeated. Lower and left edges belong to an area."""
    # equal points are one until they have their area, however many there are
    each = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("times"))
    boxes = each.withColumns({"xlo": F.col("px"), "ylo": F.col("py"), "xhi": F.col("px"), "yhi": F.col("py")})
    inside = (F.col("px") < F.col("b_xhi")) & (F.col("py") < F.col("b_yhi"))
    if "ring" in areas.columns:
        inside = inside & ring_holds(F.col("ring"), F.col("px"), F.col("py"))
    found = crowd_join(boxes, unequal(areas, key), size, crowded).where(inside).groupBy(*points.columns, "times").agg(F.min(key).alias(key))
    return found.select(*points.columns, key, F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time")).drop("time")


# --- queries ---------------------------------------------------------------------------------------------------


# tiles of all ROIs, drawn together to a tenth of their place, under gauges' surroundings: small boxes that crowd a few cells
@query("crowd_join", """WITH t AS (SELECT tile_id, xlo / 10 AS xlo, ylo / 10 AS ylo, xhi / 10 AS xhi, yhi / 10 AS yhi FROM g_tile), g AS (SELECT gauge_id, lon / 10 AS x, lat / 10 AS y FROM g_gauge)
    SELECT gauge_id, count(*) AS n, CAST(sum(tile_id) AS BIGINT) AS ids FROM g JOIN t ON x - 0.02E0 <= xhi AND x + 0.02E0 >= xlo AND y - 0.02E0 <= yhi AND y + 0.02E0 >= ylo GROUP BY gauge_id""")  # fmt: skip
def _crowd(v):
    tiles = v("g_tile").select("tile_id", *[(F.col(c) / 10).alias(c) for c in BOUNDS])
    x, y, around = F.col("lon") / 10, F.col("lat") / 10, F.lit(0.02)
    gauges = v("g_gauge").select("gauge_id", (x - around).alias("xlo"), (y - around).alias("ylo"), (x + around).alias("xhi"), (y + around).alias("yhi"))
    return crowd_join(gauges, tiles, crowded=500).groupBy("gauge_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tile_id").alias("ids"))


@query("crowded_points_in_areas", """WITH p AS (SELECT CAST(floor(lon) AS BIGINT) AS px, CAST(floor(lat) AS BIGINT) AS py FROM g_gauge),
    f AS (SELECT px, py, min(hybas_id) AS hybas_id FROM (SELECT DISTINCT px, py FROM p) d JOIN g_basin a ON px >= xlo AND px < xhi AND py >= ylo AND py < yhi GROUP BY px, py)
    SELECT CAST(p.px AS DOUBLE) AS px, CAST(p.py AS DOUBLE) AS py, hybas_id, count(*) AS n FROM p JOIN f ON p.px = f.px AND p.py = f.py GROUP BY p.px, p.py, hybas_id""")  # fmt: skip
def _crowded_points(v):
    """Gauges at whole degrees, so that many stand on one point."""
    points = v("g_gauge").select(F.floor("lon").cast("double").alias("px"), F.floor("lat").cast("double").alias("py"))
    found = crowded_points_in_areas(points, v("g_basin").select("hybas_id", *BOUNDS), "hybas_id")
    return found.groupBy("px", "py", "hybas_id").agg(F.count(F.lit(1)).alias("n"))
