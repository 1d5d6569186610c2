"""Joins in space: boxes, points, segments and grids.

Spark has no spatial join: without help a box join is a nested loop. Here both sides are filed under the grid
cells that they touch and joined on the cell. A pair is kept in one cell only, the one that holds the lower left
corner of what the two boxes share, so no ``distinct`` is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.plans.joins import alike_keys, by_sort, of_alike
from hydrospark.plans.registry import ORACLES, QUERIES, query

CELL = 3.0  # degrees
BOUNDS = ("xlo", "ylo", "xhi", "yhi")
MARGIN = 1e-9  # boxes are snapped outward by it, so that touching ones share a cell


def cells(lo: Column, hi: Column, size: float) -> Column:
    """Numbers of the cells from ``lo`` to ``hi``."""
    return F.sequence(F.floor((lo - MARGIN) / size), F.floor((hi + MARGIN) / size))


def in_cells(boxes: DataFrame, size: float = CELL) -> DataFrame:
    """Each box once for each cell (cx, cy) that it touches."""
    return boxes.withColumn("cx", F.explode(cells(F.col("xlo"), F.col("xhi"), size))).withColumn("cy", F.explode(cells(F.col("ylo"), F.col("yhi"), size)))


def spatial_join(a: DataFrame, b: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs of boxes that meet, edges included; b's bounds are renamed to b_xlo and so on."""
    b = b.withColumnsRenamed({c: f"b_{c}" for c in BOUNDS})
    right = b.withColumn("cx", F.explode(cells(F.col("b_xlo"), F.col("b_xhi"), size))).withColumn("cy", F.explode(cells(F.col("b_ylo"), F.col("b_yhi"), size)))
    pairs = by_sort(in_cells(a, size)).join(right, ["cx", "cy"])
    meet = (F.col("xlo") <= F.col("b_xhi")) & (F.col("b_xlo") <= F.col("xhi")) & (F.col("ylo") <= F.col("b_yhi")) & (F.col("b_ylo") <= F.col("yhi"))
    home = (F.col("cx") == F.floor((F.greatest("xlo", "b_xlo") - MARGIN) / size)) & (F.col("cy") == F.floor((F.greatest("ylo", "b_ylo") - MARGIN) / size))
    return pairs.where(meet & home).drop("cx", "cy")


def shared_area() -> Column:
    """Area that the two boxes of a pair share."""
    w = F.least("xhi", "b_xhi") - F.greatest("xlo", "b_xlo")
    h = F.least("yhi", "b_yhi") - F.greatest("ylo", "b_ylo")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area() -> Column:
    return (F.col("xhi") - F.col("xlo")) * (F.col("yhi") - F.col("ylo"))


def overlap_join(a: DataFrame, b: DataFrame, threshold: float = 0.3, size: float = CELL) -> DataFrame:
    """Pairs of which b covers more than ``threshold`` of a."""
    return spatial_join(a, b, size).withColumn("share", shared_area() / box_area()).where(F.col("share") > threshold)


def alike_overlap_join(a: DataFrame, b: DataFrame, threshold: float = 0.3, size: float = CELL) -> DataFrame:
    """``overlap_join`` for tables in which many rows have the same box: boxes that differ are compared, and each pair of them then stands for all rows that have them."""
    names = {c: f"b_{c}" for c in BOUNDS}
    right = b.withColumnsRenamed(names)
    met = overlap_join(a.select(*BOUNDS).distinct(), b.select(*BOUNDS).distinct(), threshold, size)
    return met.join(by_sort(right), list(names.values())).join(by_sort(a), list(BOUNDS)).select(*a.columns, *right.columns, "share")


def points_in_areas(points: DataFrame, areas: DataFrame, key: str, size: float = CELL) -> DataFrame:
    """The area that holds each point (lower and left edges belong to it); of several the one with the least ``key``. Repeated points stay repeated.

    Areas are boxes, or polygons if they have a ``ring`` beside their box: cells and boxes find the candidates, then
    the ring decides. Points of one place are one until they have their area, and of equal areas the one with the least key stands for all.
    """
    at = points.select("px", "py").distinct().withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    pairs = by_sort(at).join(in_cells(unequal(areas, key), size), ["cx", "cy"])
    inside = (F.col("px") >= F.col("xlo")) & (F.col("px") < F.col("xhi")) & (F.col("py") >= F.col("ylo")) & (F.col("py") < F.col("yhi"))
    if "ring" in areas.columns:
        inside = inside & ring_holds(F.col("ring"), F.col("px"), F.col("py"))
    found = pairs.where(inside).groupBy("px", "py").agg(F.min(key).alias(key))
    return points.join(by_sort(found), ["px", "py"]).select(*points.columns, key)


def unequal(areas: DataFrame, key: str) -> DataFrame:
    """Areas (box, and ``ring`` if they have one) that all differ, each with the least ``key`` of those that are equal to it."""
    return areas.groupBy(*[c for c in (*BOUNDS, "ring") if c in areas.columns]).agg(F.min(key).alias(key))


def with_bounds(areas: DataFrame, ring: str = "ring") -> DataFrame:
    """Areas with the bounds of their rings as xlo, ylo, xhi, yhi."""
    of = lambda c: F.transform(ring, lambda p: p[c])
    return areas.withColumns({"xlo": F.array_min(of("x")), "ylo": F.array_min(of("y")), "xhi": F.array_max(of("x")), "yhi": F.array_max(of("y"))})


def ring_of(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def ring_holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring, array of (x, y), holds a point: an odd number of its sides lie to the right of it."""
    n = F.size(ring)

    def crossings(a: Column, i: Column) -> Column:
        b = F.element_at(ring, F.pmod(i + 1, n) + 1)
        spans = (a["y"] > y) != (b["y"] > y)
        return (spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]).otherwise(1.0) + a["x"])).cast("int")

    return F.aggregate(F.transform(ring, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1


def _hits(rivers: DataFrame, keep: str = "river_id") -> DataFrame:
    """(river_id, tx, ty) of the tiles that segments touch, edges included; each tile once for a segment. ``keep`` may name another column.

    A segment, its ends in the order of x, is cut at whole x; in each column it covers the rows between its heights
    there. An upright one has one column (two on an edge) and all its height.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    back = x1 > x2
    ends = {"ax": F.when(back, x2).otherwise(x1), "ay": F.when(back, y2).otherwise(y1), "bx": F.when(back, x1).otherwise(x2), "by": F.when(back, y1).otherwise(y2)}
    columns = rivers.select(keep, *[c.alias(name) for name, c in ends.items()]).withColumn("tx", F.explode(F.sequence(F.ceil("ax") - 1, F.floor("bx"))))
    run = F.col("bx") - F.col("ax")
    height = lambda x: F.col("ay") + (F.col("by") - F.col("ay")) / F.when(run == 0, 1.0).otherwise(run) * (F.least(F.greatest(x, F.col("ax")), F.col("bx")) - F.col("ax"))
    upright = run == 0
    low, high = height(F.col("tx").cast("double")), height(F.col("tx") + 1.0)
    low, high = F.when(upright, F.col("ay")).otherwise(low), F.when(upright, F.col("by")).otherwise(high)
    return columns.select(keep, "tx", F.explode(F.sequence(F.ceil(F.least(low, high)) - 1, F.floor(F.greatest(low, high)))).alias("ty"))


def _rivers_of_tiles(rivers: DataFrame) -> DataFrame:
    """(tx, ty, n_rivers) of the tiles that rivers touch.

    Rivers of one segment are one for as long as their segments are equal, so their tiles are not listed for each of them; those of several
    segments are told apart in each tile.
    """
    ends = ["x1", "y1", "x2", "y2"]
    # rivers are dealt out first: their files are small, and one task would hold them all
    each = rivers.repartition("river_id").groupBy("river_id").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ends])
    alone = (F.col("n") == 1) & F.col("river_id").isNotNull()
    single = _hits(each.where(alone).groupBy(*ends).agg(F.count(F.lit(1)).alias("n")), "n").groupBy("tx", "ty").agg(F.sum("n").alias("n_rivers"))
    others = each.where(~alone).select(F.col("river_id").alias("other"))
    several = _hits(rivers.join(by_sort(others), F.col("river_id").eqNullSafe(F.col("other")), "left_semi")).groupBy("tx", "ty").agg(F.count_distinct("river_id").alias("n_rivers"))
    return single.unionByName(several).groupBy("tx", "ty").agg(F.sum("n_rivers").alias("n_rivers"))


def lines_hit_grid(rivers: DataFrame, tiles: DataFrame, min_flow: int, most: int | None = None) -> DataFrame:
    """Tiles (tx, ty) that a river with enough flow touches, with the number of rivers; the first ``most`` of each ROI, column by column."""
    found = tiles.join(_rivers_of_tiles(rivers.where(F.col("riv_tc_usu") > min_flow)), ["tx", "ty"])
    if most is None:
        return found
    order = Window.partitionBy("roi_id").orderBy("tx", "ty", "tile_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def initial_tiles(rivers: DataFrame, tiles: DataFrame, min_flow: int = 500, most: int = 200, around: int = 2, centre: int = 3) -> DataFrame:
    """(roi_id, tx, ty) where the search of a ROI's floods starts: its river tiles, grown by ``around``.

    A ROI without large rivers takes rivers of any flow (up to ``min_flow`` tiles), one without rivers the tiles
    around the middle of its grid. Grids go from (0, 0) to the ROI's largest tx and ty.
    """
    from hydrospark.operators.rasters import grow_window

    grid = tiles.groupBy("roi_id").agg((F.max("tx") + 1).alias("w"), (F.max("ty") + 1).alias("h"))
    large = lines_hit_grid(rivers, tiles, min_flow, most).select("roi_id", "tx", "ty")
    left = tiles.join(large.select("roi_id").distinct(), "roi_id", "left_anti")
    small = lines_hit_grid(rivers, left, 0, min_flow).select("roi_id", "tx", "ty")
    bare = grid.join(large.select("roi_id").union(small.select("roi_id")).distinct(), "roi_id", "left_anti")
    middle = grow_window(bare.select("roi_id", F.floor(F.col("w") / 2).alias("tx"), F.floor(F.col("h") / 2).alias("ty")), centre, 1 << 30, 1 << 30)
    starts = large.union(small).union(middle)
    # the starting tiles themselves are always inside of their own window
    grown = grow_window(starts, around, 1 << 30, 1 << 30).join(grid, "roi_id")
    return grown.where((F.col("tx") < F.col("w")) & (F.col("ty") < F.col("h"))).select("roi_id", "tx", "ty")


def areas_without_rivers(tiles: DataFrame, rivers: DataFrame, min_flow: int) -> DataFrame:
    """ROIs of which no tile is touched by a river with enough flow."""
    return tiles.select("roi_id").distinct().join(lines_hit_grid(rivers, tiles, min_flow).select("roi_id").distinct(), "roi_id", "left_anti")


def overlay_weights(areas: DataFrame, cell: float, key: str) -> DataFrame:
    """(key, gx, gy) of the grid cells under each area, with the share of the area and the share of the cell."""
    spread = areas.withColumn("gx", F.explode(F.sequence(F.floor(F.col("xlo") / cell), F.ceil(F.col("xhi") / cell) - 1))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("ylo") / cell), F.ceil(F.col("yhi") / cell) - 1)))
    w = F.least(F.col("xhi"), (F.col("gx") + 1) * cell) - F.greatest(F.col("xlo"), F.col("gx") * cell)
    h = F.least(F.col("yhi"), (F.col("gy") + 1) * cell) - F.greatest(F.col("ylo"), F.col("gy") * cell)
    return spread.withColumn("area", w * h).where(F.col("area") > 0).withColumns({"area_share": F.col("area") / box_area(), "cell_share": F.col("area") / (cell * cell)})


RING = "array<struct<x:double,y:double>>"


def half_plane(a: Column, b: Column, c: Column) -> Column:
    """The side of a line on which a x + b y >= c."""
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))


def clipped(ring: Column, planes: Column) -> Column:
    """The part of a ring on the one side of all ``planes``, an array of ``half_plane``: corners inside, and where sides cross a line.

    Planes are taken in turn by a fold, so the ring is a variable in it and the expression stays small. The planes
    enclose something convex; the ring may be any simple one.
    """

    def cut(own: Column, p: Column) -> Column:
        above = lambda q: p["a"] * q["x"] + p["b"] * q["y"] - p["c"]

        def corner(q: Column, i: Column) -> Column:
            r = F.element_at(own, F.pmod(i + 1, F.size(own)) + 1)
            share = above(q) / (above(q) - above(r))
            at = F.struct((q["x"] + (r["x"] - q["x"]) * share).alias("x"), (q["y"] + (r["y"] - q["y"]) * share).alias("y"))
            come, stay = above(r) >= 0, above(q) >= 0
            return F.when(stay & come, F.array(r)).when(stay, F.array(at)).when(come, F.array(at, r)).otherwise(F.array().cast(RING))

        return F.flatten(F.transform(own, corner)).cast(RING)

    return F.aggregate(planes, ring.cast(RING), cut)


def ring_planes(ring: Column) -> Column:
    """The half planes of a convex ring's sides, counter-clockwise."""
    side = lambda q, r: half_plane(q["y"] - r["y"], r["x"] - q["x"], (q["y"] - r["y"]) * q["x"] + (r["x"] - q["x"]) * q["y"])
    return F.transform(ring, lambda q, i: side(q, F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)))


def overlap_area(ring: Column, convex: Column) -> Column:
    """The area that a ring shares with a convex one; both counter-clockwise."""
    return ring_area(clipped(ring, ring_planes(convex)))


def ring_overlay_weights(areas: DataFrame, cell: float) -> DataFrame:
    """Areas (with ``ring`` and its bounds) to the grid cells (gx, gy) under them, with the share of the area and the share of the cell.

    Less than a 10^12th of the smaller of the two is rounding, of a ring that only touches the cell, and is left out. Equal rings are cut once.
    """
    rings = areas.select("ring", *BOUNDS).distinct()
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.greatest(F.floor(F.col(lo) / cell), F.ceil(F.col(hi) / cell) - 1)))
    spread = rings.withColumn("gx", span("xlo", "xhi")).withColumn("gy", span("ylo", "yhi"))
    one, none = F.lit(1.0), F.lit(0.0)
    x, y = F.col("gx") * F.lit(cell), F.col("gy") * F.lit(cell)
    box = F.array(half_plane(one, none, x), half_plane(-one, none, -x - cell), half_plane(none, one, y), half_plane(none, -one, -y - cell))
    shares = spread.withColumn("area", F.abs(ring_area(clipped(F.col("ring"), box)))).withColumn("area_share", F.col("area") / F.abs(ring_area(F.col("ring"))))
    found = shares.where(F.col("area") > 1e-12 * F.least(F.abs(ring_area(F.col("ring"))), F.lit(cell * cell))).withColumn("cell_share", F.col("area") / (cell * cell))
    kept = [c for c in areas.columns if c != "ring"]
    return areas.join(by_sort(found), ["ring", *BOUNDS]).select(*kept, "gx", "gy", "area", "area_share", "cell_share")


def areas_to_grid(areas: DataFrame, cell: float, key: str, absolute: str, relative: str, klass: str) -> DataFrame:
    """Attributes of areas on a grid: absolute ones are split by area, relative ones weighted by cell share, classes by vote."""
    weights = overlay_weights(areas, cell, key)
    values = weights.groupBy("gx", "gy").agg(F.sum(F.col(absolute) * F.col("area_share")).alias(absolute), (F.sum(F.col(relative) * F.col("cell_share")) / F.sum("cell_share")).alias(relative))
    return values.join(class_vote(weights, klass, "cell_share"), ["gx", "gy"])


def class_vote(weights: DataFrame, klass: str, weight: str) -> DataFrame:
    """The class with the most weight in each cell, the lowest one on ties; weights are compared to nine digits."""
    sums = weights.groupBy("gx", "gy", klass).agg(F.round(F.sum(weight), 9).alias("w"))
    return sums.groupBy("gx", "gy").agg(F.max_by(klass, F.struct("w", -F.col(klass))).alias(klass))


def area_average(weights: DataFrame, values: DataFrame, state: list[str], key: str) -> DataFrame:
    """Gridded values over areas: the weighted mean of state variables, the weighted sum of others, by day and band."""
    # a cell has one value for all areas of a key, so their shares are summed before they meet days and bands
    of_cell = weights.groupBy(key, "gx", "gy").agg(F.sum("area_share").alias("area_share"))
    joined = of_cell.join(values, ["gx", "gy"]).where(F.col("value").isNotNull())
    total, weight = F.sum(F.col("value") * F.col("area_share")), F.sum("area_share")
    return joined.groupBy(key, "day", "band").agg(F.when(F.col("band").isin(*state), total / weight).otherwise(total).alias("value"))


def union_cover(boxes: DataFrame, cell: float, *by: str) -> DataFrame:
    """Area of the union of boxes as whole cells; exact for boxes on the grid."""
    spread = boxes.withColumn("gx", F.explode(F.sequence(F.floor(F.col("xlo") / cell), F.ceil(F.col("xhi") / cell) - 1))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("ylo") / cell), F.ceil(F.col("yhi") / cell) - 1)))
    return spread.select(*by, "gx", "gy").distinct().groupBy(*by).agg((F.count(F.lit(1)) * (cell * cell)).alias("area"))


def covered_share(areas: DataFrame, boxes: DataFrame, cell: float, key: str) -> DataFrame:
    """The share of each area (key, box) that the union of ``boxes`` covers, as whole cells; exact for boxes on the grid."""
    spread = lambda df: df.withColumn("gx", F.explode(F.sequence(F.floor(F.col("xlo") / cell), F.ceil(F.col("xhi") / cell) - 1))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("ylo") / cell), F.ceil(F.col("yhi") / cell) - 1)))
    covered = spread(boxes.select(*BOUNDS)).select("gx", "gy").distinct()
    # equal areas are one until they have their share
    own = spread(areas.select(*BOUNDS).distinct())
    found = own.join(by_sort(covered), ["gx", "gy"]).groupBy(*BOUNDS).agg(F.count(F.lit(1)).alias("n"))
    each = areas.groupBy(key, *BOUNDS).agg(F.count(F.lit(1)).alias("times"))
    return each.join(by_sort(found), list(BOUNDS)).select(key, (F.col("n") * F.col("times") * (cell * cell) / box_area()).alias("share"))


def hull(points: DataFrame, key: str) -> DataFrame:
    """Convex hull of each key's points (px, py) as a ring, counter-clockwise from the lowest left one (monotone chain).

    Of the points with one px only the lowest and highest can be on a hull, so the others go before the grouping.
    """
    import pandas as pd

    ends = points.groupBy(key, "px").agg(F.min("py").alias("lo"), F.max("py").alias("hi"))
    ring = "array<struct<x:double,y:double>>"

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        at = sorted({*zip(pdf["px"], pdf["lo"]), *zip(pdf["px"], pdf["hi"])})

        def half(rows: list) -> list:
            out: list = []
            for p in rows:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1] if len(out) > 1 else out

        low = half(at)
        whole = low + [p for p in half(at[::-1]) if len(at) > 1]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ring": [[{"x": float(x), "y": float(y)} for x, y in whole]]})

    return ends.groupBy(key).applyInPandas(chain, f"{key} {points.schema[key].dataType.simpleString()}, ring {ring}")


def ring_area(ring: Column) -> Column:
    """Signed area of a ring: positive if counter-clockwise."""

    def area(own: Column) -> Column:
        after = lambda i: F.element_at(own, F.pmod(i + 1, F.size(own)) + 1)
        return F.aggregate(F.transform(own, lambda a, i: a["x"] * after(i)["y"] - after(i)["x"] * a["y"]), F.lit(0.0), lambda a, b: a + b) / 2

    # in an array of its own the ring is a variable, worked out once
    return F.get(F.transform(F.array(ring), area), F.lit(0))


def hull_and_centroid(tiles: DataFrame) -> DataFrame:
    """Bounds and mean centre of each ROI's tiles, and the area of the hull of their corners."""
    boxes = tiles.groupBy("roi_id").agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"), F.avg((F.col("xlo") + F.col("xhi")) / 2).alias("cx"), F.avg((F.col("ylo") + F.col("yhi")) / 2).alias("cy"))
    corners = F.array(*[F.struct(F.col(x).alias("px"), F.col(y).alias("py")) for x in ("xlo", "xhi") for y in ("ylo", "yhi")])
    hulls = hull(tiles.select("roi_id", F.explode(corners).alias("p")).select("roi_id", "p.*"), "roi_id")
    return boxes.join(hulls.select("roi_id", ring_area(F.col("ring")).alias("hull_area")), "roi_id")


def neighbours(cover: DataFrame, *by: str, reach: int = 1) -> DataFrame:
    """Cells within ``reach`` of a cover's cells, with how many of its cells each has around it."""
    steps = [F.lit(i) for i in range(-reach, reach + 1)]
    near = cover.select(*by, F.explode(F.array(*steps)).alias("i"), "gx", "gy").select(*by, (F.col("gx") + F.col("i")).alias("gx"), F.explode(F.array(*steps)).alias("j"), "gy")
    return near.select(*by, "gx", (F.col("gy") + F.col("j")).alias("gy")).groupBy(*by, "gx", "gy").agg(F.count(F.lit(1)).alias("n"))


def coast_band(cover: DataFrame) -> DataFrame:
    """Cells of a cover's coast: the cover grown by a cell, without the cells that have cover all around."""
    return neighbours(cover.select("gx", "gy").distinct()).where(F.col("n") < 9).select("gx", "gy")


def coast_tiles(tiles: DataFrame, coast: DataFrame, cell: float) -> DataFrame:
    """Tiles with a flag whether they meet the coast."""
    spread = tiles.select("tile_id", F.explode(cells(F.col("xlo"), F.col("xhi"), cell)).alias("gx"), "ylo", "yhi").select("tile_id", "gx", F.explode(cells(F.col("ylo"), F.col("yhi"), cell)).alias("gy"))
    hit = spread.join(coast, ["gx", "gy"], "left_semi").select("tile_id").distinct().withColumn("hit", F.lit(True))
    return tiles.join(hit, "tile_id", "left").withColumn("coast", F.coalesce("hit", F.lit(False))).drop("hit")


def mask_to_cover(rows: DataFrame, above: float, *by: str) -> DataFrame:
    """Cells where a mask is set."""
    return rows.where(F.col("value") > above).select(*by, "gx", "gy").distinct()


def majority_basin(tiles: DataFrame, basins: DataFrame, margin: float = 0.04) -> DataFrame:
    """The basin that holds most tile centres of each ROI, and for each tile whether it is to be left out: in another basin, or beyond the margin."""
    centres = tiles.select("roi_id", "tile_id", ((F.col("xlo") + F.col("xhi")) / 2).alias("px"), ((F.col("ylo") + F.col("yhi")) / 2).alias("py"))
    held = points_in_areas(centres, basins.select("hybas_id", "xlo", "ylo", "xhi", "yhi"), "hybas_id")
    votes = held.groupBy("roi_id", "hybas_id").agg(F.count(F.lit(1)).alias("n")).groupBy("roi_id").agg(F.max_by("hybas_id", F.struct("n", -F.col("hybas_id"))).alias("major"))
    own = basins.select(F.col("hybas_id").alias("major"), *BOUNDS)
    rows = centres.join(votes.join(by_sort(own), "major"), "roi_id", "left")
    far = (F.col("px") < F.col("xlo") - margin) | (F.col("px") > F.col("xhi") + margin) | (F.col("py") < F.col("ylo") - margin) | (F.col("py") > F.col("yhi") + margin)
    return rows.select("roi_id", "tile_id", "major", F.coalesce(far, F.lit(True)).alias("excluded"))


def climate_zone_of(tiles: DataFrame, basins: DataFrame) -> DataFrame:
    """Climate zone at each tile's centre, null where there is none."""
    centres = tiles.select("tile_id", ((F.col("xlo") + F.col("xhi")) / 2).alias("px"), ((F.col("ylo") + F.col("yhi")) / 2).alias("py"))
    held = points_in_areas(centres, basins.select("hybas_id", "xlo", "ylo", "xhi", "yhi"), "hybas_id")
    found = held.join(by_sort(basins.select("hybas_id", "clz_cl_smj")), "hybas_id").select("tile_id", F.when(F.col("clz_cl_smj") >= 1, F.col("clz_cl_smj")).alias("clim_zone"))
    return tiles.select("tile_id").join(by_sort(found), "tile_id", "left")


def zone_counts(basins: DataFrame, shapes: DataFrame, key: str, threshold: float = 0.3) -> DataFrame:
    """Basins by climate zone of which a shape (key, box) covers more than ``threshold``."""
    # equal basins of a zone are covered alike
    alike = basins.groupBy("clz_cl_smj", *BOUNDS).agg(F.count(F.lit(1)).alias("n"))
    return overlap_join(alike, shapes.select(key, *BOUNDS), threshold).groupBy(key, "clz_cl_smj").agg(F.sum("n").alias("n"))


def met_boxes(areas: DataFrame, boxes: DataFrame, key: str, total: str) -> DataFrame:
    """(key, n, total) of the areas (key, box) that meet any of ``boxes`` (box, total), edges included: how many, and the sum of their ``total``.

    Equal areas are one and equal boxes are one until they have met.
    """
    alike = boxes.groupBy(*BOUNDS).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias(total))
    met = spatial_join(areas.select(*BOUNDS).distinct(), alike).groupBy(*BOUNDS).agg(F.sum("n").alias("n"), F.sum(total).alias(total))
    return areas.select(key, *BOUNDS).join(by_sort(met), list(BOUNDS)).groupBy(key).agg(F.sum("n").alias("n"), F.sum(total).alias(total))


# --- queries -------------------------------------------------------------------------------------------------

_MEET = "a.xlo <= b.xhi AND b.xlo <= a.xhi AND a.ylo <= b.yhi AND b.ylo <= a.yhi"
_SHARED = "greatest(least(a.xhi, b.xhi) - greatest(a.xlo, b.xlo), 0) * greatest(least(a.yhi, b.yhi) - greatest(a.ylo, b.ylo), 0)"
_AREA = "((a.xhi - a.xlo) * (a.yhi - a.ylo))"
_CENTRES = "p AS (SELECT roi_id, tile_id, (xlo + xhi) / 2 AS px, (ylo + yhi) / 2 AS py FROM g_tile)"
_HOLDS = "px >= a.xlo AND px < a.xhi AND py >= a.ylo AND py < a.yhi"


@query("spatial_join", f"SELECT hybas_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM g_basin a JOIN g_flood b ON {_MEET} GROUP BY hybas_id")
def _join(v):
    return met_boxes(v("g_basin"), v("g_flood").withColumnRenamed("id", "ids"), "hybas_id", "ids")


@query("overlap_join", f"SELECT hybas_id, id, round({_SHARED} / {_AREA}, 6) AS share FROM g_basin a JOIN g_flood b ON {_MEET} WHERE {_SHARED} / {_AREA} > 0.3")
def _overlap(v):
    # boxes are compared where they differ; each pair of them stands for all rows that have them
    basins, floods = v("g_basin").select("hybas_id", *BOUNDS), v("g_flood").select("id", *BOUNDS)
    met = overlap_join(basins.select(*BOUNDS).distinct(), floods.select(*BOUNDS).distinct())
    box = [f"b_{c}" for c in BOUNDS]
    shares = met.select(*BOUNDS, *box, F.round("share", 6).alias("share"))
    areas, boxes = alike_keys(basins, list(BOUNDS), "hybas_id", "first", "hybas_id"), alike_keys(floods, list(BOUNDS), "id", "first", "id").withColumnsRenamed(dict(zip(BOUNDS, box)))
    return of_alike(shares, areas.drop("first"), list(BOUNDS), boxes.drop("first"), box)


@query("points_in_areas", "SELECT gauge_id, min(hybas_id) AS hybas_id FROM g_gauge g JOIN g_basin a ON lon >= xlo AND lon < xhi AND lat >= ylo AND lat < yhi GROUP BY gauge_id")
def _points(v):
    return points_in_areas(_gauge_points(v), v("g_basin").select("hybas_id", "xlo", "ylo", "xhi", "yhi"), "hybas_id").select("gauge_id", "hybas_id")


def _gauge_points(v):
    return v("g_gauge").select("gauge_id", F.col("lon").alias("px"), F.col("lat").alias("py"))


def _notched(v):
    """Basins as boxes with a wedge cut out of the upper side, down to a third of the height."""
    at = lambda x, y: (F.col("xlo") + x, F.col("ylo") + y)
    return v("g_basin").withColumn("ring", ring_of(at(0.0, 0.0), at(3.0, 0.0), at(3.0, 3.0), at(1.5, 1.0), at(0.0, 3.0)))


@query("points_in_rings", "SELECT gauge_id, min(hybas_id) AS hybas_id FROM g_gauge g JOIN g_basin a ON lon >= xlo AND lon < xhi AND lat >= ylo AND 3 * (lat - ylo - 1) < 4 * abs(lon - xlo - 1.5E0) GROUP BY gauge_id")
def _points_in_rings(v):
    return points_in_areas(_gauge_points(v), _notched(v).select("hybas_id", "xlo", "ylo", "xhi", "yhi", "ring"), "hybas_id").select("gauge_id", "hybas_id")


# a tile is touched if the boxes meet and its corners are not all on one side of the river's line
_SIDE = "sign((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1))"
_CORNERS = [_SIDE.format(x=x, y=y) for x in ("tx", "tx + 1") for y in ("ty", "ty + 1")]
_HIT = f"""t AS (SELECT DISTINCT tx, ty FROM g_tile), n AS (SELECT tx, ty, count(DISTINCT river_id) AS n_rivers FROM t JOIN g_river ON tx <= greatest(x1, x2) AND tx + 1 >= least(x1, x2) AND ty <= greatest(y1, y2) AND ty + 1 >= least(y1, y2)
    WHERE riv_tc_usu > {{flow}} AND greatest({", ".join(_CORNERS)}) >= 0 AND least({", ".join(_CORNERS)}) <= 0 GROUP BY tx, ty)"""


@query("lines_hit_grid", f"WITH {_HIT.format(flow=500)} SELECT t.roi_id, t.tile_id, n_rivers FROM g_tile t JOIN n ON t.tx = n.tx AND t.ty = n.ty")
def _lines(v):
    return lines_hit_grid(v("g_river"), v("g_tile"), 500).select("roi_id", "tile_id", "n_rivers")


@query("capped_river_tiles", f"WITH {_HIT.format(flow=500)} SELECT roi_id, tile_id FROM (SELECT t.roi_id, t.tile_id, row_number() OVER (PARTITION BY t.roi_id ORDER BY t.tx, t.ty, t.tile_id) AS r FROM g_tile t JOIN n ON t.tx = n.tx AND t.ty = n.ty) WHERE r <= 20")
def _capped(v):
    return lines_hit_grid(v("g_river"), v("g_tile"), 500, 20).select("roi_id", "tile_id")


# an area is one column of a ROI's tiles
@query("areas_without_rivers", f"WITH {_HIT.format(flow=2995)} SELECT DISTINCT roi_id * 64 + tx AS roi_id FROM g_tile WHERE roi_id * 64 + tx NOT IN (SELECT t.roi_id * 64 + t.tx FROM g_tile t JOIN n ON t.tx = n.tx AND t.ty = n.ty)")
def _without(v):
    return areas_without_rivers(v("g_tile").withColumn("roi_id", F.col("roi_id") * 64 + F.col("tx")), v("g_river"), 2995)


_STARTS = f"""g_tile2 AS (SELECT roi_id, tile_id, tx, ty FROM g_tile), g_river2 AS (SELECT * FROM g_river),
    {_HIT.format(flow=0).replace("g_tile", "g_tile2").replace("g_river", "g_river2").replace("t AS (", "t0 AS (", 1).replace("FROM t JOIN", "FROM t0 JOIN", 1)}, {_HIT.format(flow=500).replace("g_tile", "g_tile2").replace("g_river", "g_river2").replace("t AS (", "t1 AS (", 1).replace("FROM t JOIN", "FROM t1 JOIN", 1).replace("n AS (", "n1 AS (", 1)},
    l AS (SELECT roi_id, tx, ty FROM (SELECT t.roi_id, t.tx, t.ty, row_number() OVER (PARTITION BY t.roi_id ORDER BY t.tx, t.ty, t.tile_id) AS r FROM g_tile2 t JOIN n1 ON t.tx = n1.tx AND t.ty = n1.ty) WHERE r <= 200),
    m AS (SELECT roi_id, tx, ty FROM (SELECT t.roi_id, t.tx, t.ty, row_number() OVER (PARTITION BY t.roi_id ORDER BY t.tx, t.ty, t.tile_id) AS r FROM g_tile2 t JOIN n ON t.tx = n.tx AND t.ty = n.ty WHERE t.roi_id NOT IN (SELECT roi_id FROM l)) WHERE r <= 500),
    b AS (SELECT roi_id, max(tx) + 1 AS w, max(ty) + 1 AS h FROM g_tile2 GROUP BY roi_id), o3 AS (SELECT unnest([-3, -2, -1, 0, 1, 2]) AS i), o2 AS (SELECT unnest([-2, -1, 0, 1]) AS i),
    c AS (SELECT roi_id, CAST(floor(w / 2.0) AS BIGINT) + p.i AS tx, CAST(floor(h / 2.0) AS BIGINT) + q.i AS ty FROM b, o3 p, o3 q WHERE roi_id NOT IN (SELECT roi_id FROM l UNION SELECT roi_id FROM m)),
    s AS (SELECT * FROM l UNION ALL SELECT * FROM m UNION ALL SELECT * FROM c WHERE tx >= 0 AND ty >= 0)"""


@query("initial_tiles", f"WITH {_STARTS} SELECT DISTINCT s.roi_id, s.tx + p.i AS tx, s.ty + q.i AS ty FROM s, o2 p, o2 q, b WHERE b.roi_id = s.roi_id AND s.tx + p.i BETWEEN 0 AND w - 1 AND s.ty + q.i BETWEEN 0 AND h - 1")
def _starts(v):
    return initial_tiles(v("g_river"), v("g_tile"))


_WEIGHTS = """s AS (SELECT *, unnest(generate_series(CAST(floor(xlo / {c}) AS BIGINT), CAST(ceil(xhi / {c}) - 1 AS BIGINT))) AS gx FROM g_basin),
    t AS (SELECT *, unnest(generate_series(CAST(floor(ylo / {c}) AS BIGINT), CAST(ceil(yhi / {c}) - 1 AS BIGINT))) AS gy FROM s),
    u AS (SELECT *, (least(xhi, (gx + 1) * {c}) - greatest(xlo, gx * {c})) * (least(yhi, (gy + 1) * {c}) - greatest(ylo, gy * {c})) AS area FROM t),
    w AS (SELECT *, area / ((xhi - xlo) * (yhi - ylo)) AS area_share, area / ({c} * {c}) AS cell_share FROM u WHERE area > 0)"""


@query("overlay_weights", f"WITH {_WEIGHTS.format(c='2.0E0')} SELECT hybas_id, gx, gy, round(area_share, 6) AS area_share, round(cell_share, 6) AS cell_share FROM w")
def _weights(v):
    return overlay_weights(v("g_basin"), 2.0, "hybas_id").select("hybas_id", "gx", "gy", F.round("area_share", 6).alias("area_share"), F.round("cell_share", 6).alias("cell_share"))


# the part of a lower left half box within a cell, by the area below the diagonal from each of the cell's corners
_BELOW = "power(greatest(xlo + ylo + 3 - ({x}) - ({y}), 0), 2) / 2"
_CORNER = {k: _BELOW.format(x=f"greatest(gx * 2.0E0, xlo)" if k[0] == "l" else "(gx + 1) * 2.0E0", y="greatest(gy * 2.0E0, ylo)" if k[1] == "l" else "(gy + 1) * 2.0E0") for k in ("ll", "hl", "lh", "hh")}


@query("ring_overlay_weights", f"""WITH {_WEIGHTS.format(c='2.0E0')}, a AS (SELECT hybas_id, gx, gy, {_CORNER['ll']} - {_CORNER['hl']} - {_CORNER['lh']} + {_CORNER['hh']} AS area FROM t)
    SELECT hybas_id, gx, gy, round(area / 4.5E0, 6) AS area_share, round(area / 4, 6) AS cell_share FROM a WHERE area > 1e-9""")  # fmt: skip
def _ring_weights(v):
    at = lambda x, y: (F.col("xlo") + x, F.col("ylo") + y)
    halves = v("g_basin").withColumn("ring", ring_of(at(0.0, 0.0), at(3.0, 0.0), at(0.0, 3.0)))
    return ring_overlay_weights(halves, 2.0).select("hybas_id", "gx", "gy", F.round("area_share", 6).alias("area_share"), F.round("cell_share", 6).alias("cell_share"))


_VOTE = "(SELECT gx, gy, clz_cl_smj, row_number() OVER (PARTITION BY gx, gy ORDER BY round(sum(cell_share), 9) DESC, clz_cl_smj) AS r FROM w GROUP BY gx, gy, clz_cl_smj)"


@query("areas_to_grid", f"WITH {_WEIGHTS.format(c='2.0E0')}, a AS (SELECT gx, gy, round(sum(pop_ct_usu * area_share), 4) AS pop_ct_usu, round(sum(tmp_dc_uyr * cell_share) / sum(cell_share), 6) AS tmp_dc_uyr FROM w GROUP BY gx, gy), v AS {_VOTE} SELECT a.gx, a.gy, pop_ct_usu, tmp_dc_uyr, clz_cl_smj FROM a JOIN v ON a.gx = v.gx AND a.gy = v.gy WHERE r = 1")
def _grid(v):
    return areas_to_grid(v("g_basin"), 2.0, "hybas_id", "pop_ct_usu", "tmp_dc_uyr", "clz_cl_smj").select("gx", "gy", F.round("pop_ct_usu", 4).alias("pop_ct_usu"), F.round("tmp_dc_uyr", 6).alias("tmp_dc_uyr"), "clz_cl_smj")


@query("class_vote", f"WITH {_WEIGHTS.format(c='5.0E0')}, v AS {_VOTE} SELECT gx, gy, clz_cl_smj FROM v WHERE r = 1")
def _vote(v):
    return class_vote(overlay_weights(v("g_basin"), 5.0, "hybas_id"), "clz_cl_smj", "cell_share")


_AVERAGE = f"""WITH {_WEIGHTS.format(c='15.0E0')}, g AS (SELECT CAST(gx - 12 AS BIGINT) AS gx, CAST(gy - 4 AS BIGINT) AS gy, day, band, avg(raw_i16) AS value FROM g_weather WHERE NOT is_nodata GROUP BY gx, gy, day, band),
    j AS (SELECT continent, g.day, g.band, value, area_share FROM w JOIN g ON w.gx = g.gx AND w.gy = g.gy)
    SELECT continent, day, band, round(CASE WHEN band IN ('temperature_2m', 'surface_pressure') THEN sum(value * area_share) / sum(area_share) ELSE sum(value * area_share) END, 3) AS value FROM j GROUP BY continent, day, band"""  # fmt: skip


def averages_of(v, weather):
    values = weather.where(~F.col("is_nodata")).groupBy((F.col("gx") - 12).cast("long").alias("gx"), (F.col("gy") - 4).cast("long").alias("gy"), "day", "band").agg(F.avg("raw_i16").alias("value"))
    found = area_average(overlay_weights(v("g_basin"), 15.0, "hybas_id"), values, ["temperature_2m", "surface_pressure"], "continent")
    return found.withColumn("value", F.round("value", 3))


@query("area_average", _AVERAGE)
def _average(v):
    return averages_of(v, v("g_weather"))


QUERIES["area_average_all_days"], ORACLES["area_average_all_days"] = QUERIES["area_average"], ORACLES["area_average"]  # its name while the other one took some days alone


@query("covered_share", f"""WITH c AS (SELECT DISTINCT xlo AS x, ylo AS y FROM g_tile) SELECT hybas_id, round(count(*) * 0.0625E0 / {_AREA.replace("a.", "")}, 6) AS share FROM g_basin JOIN c ON x >= xlo AND x < xhi AND y >= ylo AND y < yhi GROUP BY hybas_id, xlo, ylo, xhi, yhi""")
def _covered_share(v):
    return covered_share(v("g_basin"), v("g_tile"), 0.25, "hybas_id").withColumn("share", F.round("share", 6))


@query("union_cover", "WITH c AS (SELECT DISTINCT roi_id, CAST(floor(xlo * 4) AS BIGINT) AS gx, CAST(floor(ylo * 4) AS BIGINT) AS gy FROM g_tile) SELECT roi_id, count(*) * 0.0625E0 AS area FROM c GROUP BY roi_id")
def _cover(v):
    return union_cover(v("g_tile"), 0.25, "roi_id")


# a pair of corners is a side of the hull if no corner lies to its right, and those on its line lie between the two
_RIGHT = "(b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)"
_HULL = f"""c AS (SELECT roi_id, xlo AS x, ylo AS y0, yhi AS y1 FROM g_tile UNION ALL SELECT roi_id, xhi, ylo, yhi FROM g_tile), k AS (SELECT roi_id, x, min(y0) AS lo, max(y1) AS hi FROM c GROUP BY roi_id, x),
    p AS (SELECT roi_id, x, lo AS y FROM k UNION ALL SELECT roi_id, x, hi FROM k), s AS (SELECT a.roi_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON a.roi_id = b.roi_id AND (a.x <> b.x OR a.y <> b.y)
      JOIN p r ON r.roi_id = a.roi_id GROUP BY a.roi_id, a.x, a.y, b.x, b.y HAVING min({_RIGHT}) >= 0 AND max(CASE WHEN {_RIGHT} = 0 THEN (r.x - a.x) * (r.x - b.x) + (r.y - a.y) * (r.y - b.y) ELSE 0 END) <= 0),
    h AS (SELECT roi_id, sum(ax * b_y - bx * ay) / 2 AS hull_area FROM s GROUP BY roi_id)"""


@query("hull_and_centroid", f"WITH {_HULL} SELECT g_tile.roi_id, min(xlo) AS xlo, min(ylo) AS ylo, max(xhi) AS xhi, max(yhi) AS yhi, round(avg((xlo + xhi) / 2), 6) AS cx, round(avg((ylo + yhi) / 2), 6) AS cy, round(max(hull_area), 6) AS hull_area FROM g_tile JOIN h ON h.roi_id = g_tile.roi_id GROUP BY g_tile.roi_id")
def _hull(v):
    return hull_and_centroid(v("g_tile")).withColumns({c: F.round(c, 6) for c in ("cx", "cy", "hull_area")})


@query("tile_hulls", f"WITH {_HULL} SELECT roi_id, round(hull_area, 6) AS hull_area FROM h")
def _hulls(v):
    return hull_and_centroid(v("g_tile")).select("roi_id", F.round("hull_area", 6).alias("hull_area"))


_COVER = "o AS (SELECT DISTINCT CAST(floor(xlo / 3) AS BIGINT) AS gx, CAST(floor(ylo / 3) AS BIGINT) AS gy FROM g_basin)"
_BAND = f"{_COVER}, d AS (SELECT unnest([-1, 0, 1]) AS i), e AS (SELECT gx + x.i AS gx, gy + y.i AS gy FROM o, d x, d y), b AS (SELECT gx, gy FROM e GROUP BY gx, gy HAVING count(*) < 9)"


def _basin_cells(v):
    return v("g_basin").select(F.floor(F.col("xlo") / 3).alias("gx"), F.floor(F.col("ylo") / 3).alias("gy"))


@query("coast_band", f"WITH {_BAND} SELECT gx, gy FROM b")
def _band(v):
    return coast_band(_basin_cells(v))


@query("coast_tiles", f"""WITH {_BAND}, s AS (SELECT tile_id, gx, unnest(generate_series(CAST(floor((ylo - 1e-9) / 3) AS BIGINT), CAST(floor((yhi + 1e-9) / 3) AS BIGINT))) AS gy FROM
    (SELECT *, unnest(generate_series(CAST(floor((xlo - 1e-9) / 3) AS BIGINT), CAST(floor((xhi + 1e-9) / 3) AS BIGINT))) AS gx FROM g_tile) x)
    SELECT roi_id, tile_id, tile_id IN (SELECT tile_id FROM s JOIN b ON s.gx = b.gx AND s.gy = b.gy) AS coast FROM g_tile""")  # fmt: skip
def _coast(v):
    return coast_tiles(v("g_tile"), coast_band(_basin_cells(v)), 3.0).select("roi_id", "tile_id", "coast")


@query("mask_to_cover", "SELECT DISTINCT band, gx, gy FROM g_weather WHERE raw_i16 > 4500")
def _mask(v):
    return mask_to_cover(v("g_weather").withColumnRenamed("raw_i16", "value"), 4500, "band")


@query("majority_basin", f"""WITH {_CENTRES}, h AS (SELECT tile_id, min(hybas_id) AS hybas_id FROM p JOIN g_basin a ON {_HOLDS} GROUP BY tile_id),
    n AS (SELECT roi_id, hybas_id, count(*) AS n FROM p JOIN h ON p.tile_id = h.tile_id GROUP BY roi_id, hybas_id), m AS (SELECT roi_id, hybas_id AS major FROM (SELECT *, row_number() OVER (PARTITION BY roi_id ORDER BY n DESC, hybas_id) AS r FROM n) WHERE r = 1)
    SELECT p.roi_id, p.tile_id, m.major, coalesce(px < xlo - 0.04 OR px > xhi + 0.04 OR py < ylo - 0.04 OR py > yhi + 0.04, true) AS excluded FROM p LEFT JOIN m ON p.roi_id = m.roi_id LEFT JOIN g_basin b ON m.major = b.hybas_id""")  # fmt: skip
def _majority(v):
    return majority_basin(v("g_tile"), v("g_basin"))


@query("climate_zone_of", f"WITH {_CENTRES}, h AS (SELECT tile_id, min(hybas_id) AS hybas_id FROM p JOIN g_basin a ON {_HOLDS} GROUP BY tile_id) SELECT p.tile_id, b.clz_cl_smj AS clim_zone FROM p LEFT JOIN h ON p.tile_id = h.tile_id LEFT JOIN g_basin b ON h.hybas_id = b.hybas_id")
def _zone(v):
    return climate_zone_of(v("g_tile"), v("g_basin"))


@query("zone_counts", f"SELECT roi_id, clz_cl_smj, count(*) AS n FROM g_basin a JOIN (SELECT roi_id, min(xlo) AS xlo, min(ylo) AS ylo, max(xhi) AS xhi, max(yhi) AS yhi FROM g_tile GROUP BY roi_id) b ON {_MEET} WHERE {_SHARED} / {_AREA} > 0.05 GROUP BY roi_id, clz_cl_smj")
def _zones(v):
    shapes = v("g_tile").groupBy("roi_id").agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"))
    return zone_counts(v("g_basin"), shapes, "roi_id", 0.05)


@query("tiles_matching", f"SELECT a.roi_id, a.tile_id FROM g_tile a JOIN g_scene_event b ON {_MEET} WHERE {_SHARED} / {_AREA} > 0.01 GROUP BY a.roi_id, a.tile_id")
def _matching(v):
    sites = v("g_scene_event").select("basin_key", "xlo", "ylo", "xhi", "yhi")
    return overlap_join(v("g_tile").select("roi_id", "tile_id", "xlo", "ylo", "xhi", "yhi"), sites, 0.01).select("roi_id", "tile_id").distinct()
