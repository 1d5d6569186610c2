"""Jobs that go on until nothing changes: drainage, regions, growing extents, partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.operators.evaluation import paste_permanent_water
from hydrospark.operators.projections import coastal_outlets
from hydrospark.operators.rasters import majority_filter
from hydrospark.operators.spatial import lines_hit_grid, majority_basin, points_in_areas
from hydrospark.plans.components import components, drained
from hydrospark.plans.joins import by_sort
from hydrospark.plans.registry import query
from hydrospark.plans.scratch import written


def upstream_of(basins: DataFrame, targets: DataFrame) -> DataFrame:
    """All basins that drain into each target (hybas_id), with the number of steps; a target is level 0. The rounds grow with the logarithm of the longest way."""
    after = basins.select(F.col("hybas_id").alias("node"), F.when(F.col("next_down") != 0, F.col("next_down")).alias("next"))
    found = drained(after, targets.select(F.col("hybas_id").alias("node")), "upstream")
    return found.select("target", F.col("node").alias("hybas_id"), F.col("steps").cast("int").alias("level"))


def major_upstream(basins: DataFrame, targets: DataFrame, min_flow: int = 20_000) -> DataFrame:
    """Bounds of each target's upstream basins that have enough flow."""
    found = upstream_of(basins, targets).join(basins.select("hybas_id", "riv_tc_usu", "xlo", "ylo", "xhi", "yhi"), "hybas_id").where(F.col("riv_tc_usu") > min_flow)
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"))


BLOCK = 64  # cells on a side of a block, which one task labels
LOTS = 1024  # blocks are dealt into so many lots


def pieces(cells: DataFrame, steps: list[tuple[int, int]] | None = None) -> DataFrame:
    """``cells`` (k, gx, gy, value) with ``y`` and ``x``: the least of the cells that it is connected to within its block.

    Connected are cells of one value beside or above each other, or with ``steps`` (across, up) those that are a step apart.
    """
    x, y = F.col("gx").cast("long"), F.col("gy").cast("long")
    lot = F.pmod(F.xxhash64("k", F.floor(x / BLOCK), F.floor(y / BLOCK)), F.lit(LOTS)).cast("int")

    def label(table: pa.Table) -> pa.Table:
        number = lambda c: table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        k, v, gx, gy = number("k"), number("value"), *(table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        across, down = np.lexsort((gx, gy, v, k)), np.lexsort((gy, gx, v, k))
        # numbers in the order of across, in which the first of connected cells is the least
        place = np.empty(len(k), np.int64)
        place[across] = np.arange(len(k))

        def beside(order: np.ndarray, same: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = order[:-1], order[1:]
            # the same cell twice is one
            near = (k[a] == k[b]) & (v[a] == v[b]) & (v[a] >= 0) & (same[a] == same[b]) & (((on[a] + 1 == on[b]) & (on[a] // BLOCK == on[b] // BLOCK)) | (on[a] == on[b]))
            return place[a[near]], place[b[near]]

        def apart(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            # cells in the order of across, numbered by key, value, row and column
            row, column = gy[across] - gy.min(), gx[across] - gx.min()
            high, wide = row.max(initial=0) + 1 + 2 * abs(j), column.max(initial=0) + 1 + 2 * abs(i)
            at = (np.unique(k[across] * (v.max(initial=0) + 2) + v[across], return_inverse=True)[1] * high + row + abs(j)) * wide + column + abs(i)
            there = np.minimum(np.searchsorted(at, at + j * wide + i), len(at) - 1)
            near = (at[there] == at + j * wide + i) & (v[across] >= 0) & ((row + gy.min()) // BLOCK == (row + gy.min() + j) // BLOCK) & ((column + gx.min()) // BLOCK == (column + gx.min() + i) // BLOCK)
            return np.flatnonzero(near), there[near]

        linked = [beside(across, gy, gx), beside(down, gx, gy)] if steps is None else [beside(across, gy, gx), *(apart(i, j) for i, j in steps)]
        a, b = map(np.concatenate, zip(*linked))
        least = np.arange(len(k))
        while True:
            low, told = np.minimum(least[a], least[b]), least.copy()
            for at in (least[a], least[b]):
                np.minimum.at(told, at, low)
            while (told[told] != told).any():
                told = told[told]
            if (told == least).all():
                break
            least = told
        first = across[least[place]]
        return table.select(["k", "gx", "gy", "value"]).append_column("y", pa.array(gy[first])).append_column("x", pa.array(gx[first]))

    kind = lambda c: cells.schema[c].dataType.simpleString()
    dealt = cells.select("k", "gx", "gy", "value", x.alias("x"), y.alias("y"), lot.alias("lot"))
    return dealt.groupBy("lot").applyInArrow(label, ", ".join([*(f"{c} {kind(c)}" for c in ("k", "gx", "gy", "value")), "y long, x long"]))


def connected_regions(cells: DataFrame, key: str) -> DataFrame:
    """``cells`` (key, gx, gy, value) with ``region``: the least cell number of its connected cells of one class (four neighbours).

    Blocks are labelled on their own; then only what touches the border of a block meets its neighbours, and the rounds are over pieces of blocks.
    """
    parts = written(pieces(cells.select(F.col(key).alias("k"), "gx", "gy", "value")), "region-pieces")
    x, y, piece = F.col("gx").cast("long"), F.col("gy").cast("long"), F.struct("k", "y", "x")
    place = lambda i, j: F.struct("k", (y + j).alias("y"), (x + i).alias("x")).alias("cell")
    edge = lambda c, at: F.pmod(c, F.lit(BLOCK)) == at
    last = [parts.where(edge(c, BLOCK - 1)).select(place(*step), "value", piece.alias("a")) for c, step in ((x, (1, 0)), (y, (0, 1)))]
    first = parts.where(edge(x, 0) | edge(y, 0)).select(place(0, 0), "value", piece.alias("b"))
    edges = last[0].unionByName(last[1]).join(by_sort(first), ["cell", "value"]).select("a", "b").distinct()
    labels = components(edges, "regions")
    joined = parts.withColumn("piece", piece).join(by_sort(labels), F.col("piece") == F.col("node"), "left").withColumn("region", F.coalesce("label", "piece"))
    return joined.select(F.col("k").alias(key), "gx", "gy", "value", F.struct("region.y", "region.x").alias("region"))


def fill_small_holes(cells: DataFrame, key: str, most: int = 50, grow: int = 2) -> DataFrame:
    """Regions of class 1 or 2 with fewer than ``most`` cells that do not touch the image's edge take the majority of their box, grown by ``grow``."""
    regions = written(connected_regions(cells, key), "hole-regions")
    edge = regions.groupBy(key).agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"))
    box = regions.where(F.col("value").isin(1, 2)).groupBy(key, "region").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(n) for f, c, n in ((F.min, "gx", "bx0"), (F.max, "gx", "bx1"), (F.min, "gy", "by0"), (F.max, "gy", "by1"))])
    small = box.where(F.col("n") < most).join(edge, key).where((F.col("bx0") > F.col("x0")) & (F.col("bx1") < F.col("x1")) & (F.col("by0") > F.col("y0")) & (F.col("by1") < F.col("y1")))
    # a small region's box is small, so its cells may be listed
    reach = lambda lo, hi: F.explode(F.sequence(F.col(lo) - grow, F.col(hi) + grow))
    around = small.select(key, "region", reach("bx0", "bx1").alias("gx"), "by0", "by1").select(key, "region", "gx", reach("by0", "by1").alias("gy"))
    votes = around.join(by_sort(cells.select(key, "gx", "gy", "value")), [key, "gx", "gy"]).groupBy(key, "region", "value").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy(key, "region").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("new"))
    return regions.join(by_sort(top), [key, "region"], "left").select(key, "gx", "gy", F.coalesce("new", "value").alias("value"))


def postprocess_maps(cells: DataFrame, keep: DataFrame, ocean: DataFrame | None = None) -> DataFrame:
    """The clean-up of raw maps: majority filter, small holes, tiles outside of the basin out, permanent water pasted over tiles of the ocean.

    ``keep`` (roi_id, gx, gy) stay; ``ocean`` (roi_id, gx, gy, cover) are those in the ocean with the class of the land cover, null where it has none.
    """
    smooth = majority_filter(cells, "roi_id").select("roi_id", "gx", "gy", F.col("filtered").alias("value"))
    kept = fill_small_holes(smooth, "roi_id").join(by_sort(keep), ["roi_id", "gx", "gy"], "left_semi")
    if ocean is None:
        return kept
    place = F.struct(F.col("roi_id").cast("long").alias("roi_id"), F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"))
    sea = ocean.select(place.alias("tile_id"), "cover", F.lit(True).alias("sea"))
    rows = kept.withColumn("tile_id", place).join(by_sort(sea.select("tile_id", "sea")), "tile_id", "left").select("roi_id", "gx", "gy", "tile_id", F.col("value").alias("targ"), F.coalesce("sea", F.lit(False)).alias("coast"))
    return paste_permanent_water(rows, sea.select("tile_id", "cover")).select("roi_id", "gx", "gy", F.col("pasted").alias("value"))


def _extents(tiles: DataFrame, reach: int) -> DataFrame:
    """``tiles`` (roi_id, tx, ty) with ``y`` and ``x``: the least of those that they are connected to within their block, by steps of up to ``reach`` in both directions."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(reach + 1) if (j, i) > (0, 0)]
    found = pieces(tiles.select(F.col("roi_id").alias("k"), F.col("tx").alias("gx"), F.col("ty").alias("gy"), F.lit(1).alias("value")), steps)
    return found.select(F.col("k").alias("roi_id"), F.col("gx").alias("tx"), F.col("gy").alias("ty"), "y", "x")


def _around(reach: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])


def _grown(rows: DataFrame, reach: int) -> DataFrame:
    """The neighbours of tiles, themselves included, each once."""
    return rows.select("roi_id", F.explode(_around(reach)).alias("s"), "tx", "ty").select("roi_id", (F.col("tx") + F.col("s.i")).alias("tx"), (F.col("ty") + F.col("s.j")).alias("ty")).distinct()


def grow_flood_extent(tiles: DataFrame, starts: DataFrame, reach: int = 1, most: int | None = None) -> DataFrame:
    """Tiles (roi_id, tx, ty, flooded, open) that are visited from the starting ones.

    A visited tile that is flooded and not open water makes its neighbours the next ones. Without a limit that
    is the connected sets of such tiles that hold a starting one, and what lies around them: few rounds however
    far a flood reaches. With ``most`` tiles for each ROI it is a walk, ring by ring, that stops there.
    """
    spreading = F.col("flooded") & ~F.col("open")
    first = starts.select("roi_id", "tx", "ty").distinct().join(by_sort(tiles), ["roi_id", "tx", "ty"])
    if most is None:
        carriers = tiles.where(spreading).select("roi_id", "tx", "ty")
        parts = written(_extents(carriers, reach), "extent-pieces")
        x, y, piece = F.col("tx").cast("long"), F.col("ty").cast("long"), F.struct("roi_id", "y", "x")
        # only tiles that have neighbours beyond their block meet those
        edge = lambda c: (F.pmod(c, F.lit(BLOCK)) < reach) | (F.pmod(c, F.lit(BLOCK)) >= BLOCK - reach)
        rim = parts.where(edge(F.col("tx")) | edge(F.col("ty"))).select("roi_id", x.alias("tx"), y.alias("ty"), piece.alias("a"))
        block = lambda x, y: F.struct(F.floor(x / BLOCK), F.floor(y / BLOCK))
        near = rim.select("roi_id", "a", "tx", "ty", F.explode(_around(reach)).alias("s")).where(block(F.col("tx"), F.col("ty")) != block(F.col("tx") + F.col("s.i"), F.col("ty") + F.col("s.j")))
        near = near.select("roi_id", "a", (F.col("tx") + F.col("s.i")).alias("tx"), (F.col("ty") + F.col("s.j")).alias("ty"))
        edges = near.join(by_sort(rim.withColumnRenamed("a", "b")), ["roi_id", "tx", "ty"]).select("a", "b").distinct()
        labels = components(edges, "extent")
        named = parts.select("roi_id", "tx", "ty", piece.alias("piece"))
        begun = named.join(by_sort(first.where(spreading).select("roi_id", "tx", "ty")), ["roi_id", "tx", "ty"], "left_semi").select(F.col("piece").alias("node")).distinct()
        # a piece that a starting tile is in, and all that are connected to one
        hit = labels.join(by_sort(begun), "node", "left_semi").select("label").distinct()
        pieces = begun.union(labels.join(by_sort(hit), "label", "left_semi").select("node")).distinct()
        flood = named.join(by_sort(pieces), F.col("piece") == F.col("node"), "left_semi").select("roi_id", "tx", "ty")
        return first.select("roi_id", "tx", "ty").union(_grown(flood, reach)).distinct().join(by_sort(tiles), ["roi_id", "tx", "ty"])
    frontier = written(first, "grown")
    seen = frontier
    while frontier.limit(1).count():
        full = seen.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        fresh = _grown(frontier.where(spreading), reach).join(by_sort(seen), ["roi_id", "tx", "ty"], "left_anti").join(full, "roi_id", "left_anti")
        frontier = written(fresh.join(by_sort(tiles), ["roi_id", "tx", "ty"]), "grown")
        seen = written(seen.unionByName(frontier), "grown-all")
    return seen


def balanced_partitions(basins: DataFrame, trials: int = 20, parts: int = 5, points: DataFrame | None = None) -> DataFrame:
    """The best of several deals of basins into partitions: the one that spreads continents, zones and ``points`` most evenly.

    ``points`` (kind, id, hybas_id) are gauges and sites with their basins. Each of these things adds the mean over
    its groups of the deviation of their shares across the partitions.

    A trial is a column: basins are ordered by a hash of id and trial within each zone and dealt in turn.
    """
    deals = basins.select("hybas_id", "clz_cl_smj", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    order = Window.partitionBy("trial", "clz_cl_smj").orderBy(F.xxhash64("hybas_id", "trial"), "hybas_id")
    dealt = deals.withColumn("part", F.pmod(F.row_number().over(order) + F.pmod(F.xxhash64("clz_cl_smj", "trial"), F.lit(parts)).cast("int"), F.lit(parts)))
    things = basins.select("hybas_id", F.explode(F.array(*[F.struct(F.lit(c).alias("thing"), F.col(c).cast("int").alias("group")) for c in ("continent", "clz_cl_smj")])).alias("t")).select("hybas_id", "t.*")
    if points is not None:
        things = things.unionByName(points.select("hybas_id", F.col("kind").alias("thing"), F.lit(0).alias("group")))
    counts = things.groupBy("hybas_id", "thing", "group").agg(F.count(F.lit(1)).alias("n")).join(by_sort(dealt.select("hybas_id", "trial", "part")), "hybas_id")
    wide = counts.groupBy("trial", "thing", "group").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"p{k}") for k in range(parts)])
    shares = wide.select("trial", "thing", "group", F.explode(F.array(*[F.col(f"p{k}") / F.col("n") for k in range(parts)])).alias("share"))
    scores = shares.groupBy("trial", "thing", "group").agg(F.stddev_pop("share").alias("s")).groupBy("trial", "thing").agg(F.avg("s").alias("s")).groupBy("trial").agg(F.sum("s").alias("s"))
    best = scores.agg(F.min_by("trial", F.struct(F.round("s", 9), "trial")).alias("trial"))
    # one row
    return dealt.join(F.broadcast(best), "trial").select("hybas_id", "clz_cl_smj", "part")


# --- queries -------------------------------------------------------------------------------------------------

_UP = """RECURSIVE u(target, hybas_id, level) AS (SELECT hybas_id, hybas_id, 0 FROM g_basin WHERE riv_tc_usu > 100 AND next_down = 0 AND endo = 0 UNION ALL SELECT u.target, b.hybas_id, u.level + 1 FROM u JOIN g_basin b ON b.next_down = u.hybas_id)"""


@query("upstream_of", f"WITH {_UP} SELECT target, hybas_id, level FROM u")
def _upstream(v):
    return upstream_of(v("g_basin"), coastal_outlets(v("g_basin")))


@query("major_upstream", f"WITH {_UP} SELECT target, count(*) AS n, min(xlo) AS xlo, min(ylo) AS ylo, max(xhi) AS xhi, max(yhi) AS yhi FROM u JOIN g_basin b ON u.hybas_id = b.hybas_id WHERE riv_tc_usu > 20000 GROUP BY target")
def _major(v):
    return major_upstream(v("g_basin"), coastal_outlets(v("g_basin")))


def _cells(v) -> DataFrame:
    return v("g_tile").select("roi_id", F.col("tx").alias("gx"), F.col("ty").alias("gy"), F.when(F.col("n_flooded") > 8000, 2).when(F.col("n_permanent_water") > 10000, 1).otherwise(0).alias("value"))


@query("connected_regions")
def _regions(v):
    return connected_regions(_cells(v), "roi_id").groupBy("roi_id", "region", "value").agg(F.count(F.lit(1)).alias("n")).select("roi_id", F.col("region.y").alias("y"), F.col("region.x").alias("x"), "value", "n")


@query("fill_small_holes")
def _holes(v):
    return fill_small_holes(_cells(v), "roi_id", 4)


@query("postprocess_maps")
def _postprocess(v):
    return postprocess_maps(_cells(v), *_layers(v))


def _layers(v) -> tuple[DataFrame, DataFrame]:
    """Tiles inside of their ROI's basin, and every fourth one as ocean, of which a third is water in the land cover and a third is not in it."""
    inside = majority_basin(v("g_tile"), v("g_basin")).where("NOT excluded").select("tile_id")
    place = ["roi_id", F.col("tx").alias("gx"), F.col("ty").alias("gy")]
    keep = v("g_tile").join(by_sort(inside), "tile_id", "left_semi").select(*place)
    cover = F.when(F.col("tile_id") % 3 == 0, 80).when(F.col("tile_id") % 3 == 1, 10).alias("cover")
    return keep, v("g_tile").where("tile_id % 4 = 0").select(*place, cover)


@query("grow_flood_extent")
def _grow(v):
    tiles = v("g_tile").select("roi_id", "tx", "ty", (F.col("n_flooded") > 2508).alias("flooded"), (F.col("n_permanent_water") > 19000).alias("open"))
    return grow_flood_extent(tiles, lines_hit_grid(v("g_river"), v("g_tile"), 500))


def _partition_points(v) -> DataFrame:
    """Gauges, labelled sites and generated sites (kind, id, hybas_id), each in the basin that holds it or its centre."""
    centres = v("g_tile").groupBy("roi_id").agg(((F.min("xlo") + F.max("xhi")) / 2).alias("px"), ((F.min("ylo") + F.max("yhi")) / 2).alias("py"))
    kind = F.when(F.col("type") == "kurosiwo", "labelled").otherwise("generated")
    sites = v("g_roi").select("roi_id", kind.alias("kind")).join(centres, "roi_id").select("kind", F.col("roi_id").cast("long").alias("id"), "px", "py")
    gauges = v("g_gauge").select(F.lit("gauge").alias("kind"), F.col("gauge_id").cast("long").alias("id"), F.col("lon").alias("px"), F.col("lat").alias("py"))
    points = gauges.unionByName(sites).withColumn("point", F.struct("kind", "id"))
    return points_in_areas(points, v("g_basin").select("hybas_id", "xlo", "ylo", "xhi", "yhi"), "hybas_id").select("point.kind", "point.id", "hybas_id")


@query("balanced_partitions")
def _partitions(v):
    return balanced_partitions(v("g_basin"), points=_partition_points(v))


@query("partition_assignments")
def _assignments(v):
    points = _partition_points(v)
    return points.join(by_sort(balanced_partitions(v("g_basin"), points=points)), "hybas_id").select("kind", "id", "part")
