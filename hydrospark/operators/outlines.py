"""Outlines of regions of cells as rings, without a task that walks around one.

A region's outline is the sides of its cells that no other cell of it shares, each with the region to its left. A side goes on with
the one that starts where it ends, which the four cells around that corner tell. Blocks of corners are traced on their own: rings
within a block are done, and what leaves it is a piece of an outline. Pieces are few; the connected ones are an outline, and their order is
their distance to one of them, which doubled pointers give. So an outline of any length takes a logarithm of rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from hydrospark.operators.polygons import bound
from hydrospark.operators.spatial import ring_area
from hydrospark.plans.components import components, nearest_stops
from hydrospark.plans.joins import by_sort
from hydrospark.plans.registry import query
from hydrospark.plans.scratch import written

BLOCK = 128  # corners on a side of a block, which one task traces
LOTS = 1024  # blocks are dealt into so many lots
_STEPS = np.array([(1, 0), (0, 1), (-1, 0), (0, -1)])  # of sides by turn: 0 to the right, 1 up, 2 to the left, 3 down


def _followed(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the way back from each ends, or some place on it if it goes round, and its steps; ``before`` is -1 at an end."""
    to, steps = np.where(before < 0, np.arange(len(before)), before), (before >= 0).astype(np.int64)
    for _ in range(len(before).bit_length()):
        steps, to = steps + steps[to], to[to]
    return to, steps


def _chains(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, place, round) of chains: rings begin at their least."""
    to, _ = _followed(before)
    ring = before[to] >= 0
    least, on = np.arange(len(before)), np.where(ring, before, np.arange(len(before)))
    for _ in range(len(before).bit_length()):
        least, on = np.minimum(least, least[on]), on[on]
    before = np.where(ring & (least == np.arange(len(before))), -1, before)
    return *_followed(before), ring


def traced(cells: DataFrame, block: int) -> DataFrame:
    """``cells`` (k, region, gx, gy, and the image's fx0, fy0, fx1, fy1 if it has an edge) to what outlines are within blocks of corners:
    (k, region, closed, points, head, tail, prior, leaves).

    ``points`` are the corners (x, y, turn of the side that starts there) in order, the first side's start always. ``prior`` is the side of another block that goes on with the
    first side, the ``head``; with ``leaves`` the last one, the ``tail``, goes on in another block.
    """
    x, y = F.col("gx").cast("long"), F.col("gy").cast("long")
    edges = [c for c in ("fx0", "fy0", "fx1", "fy1") if c in cells.columns]
    plain = lambda c: F.to_json(c) if isinstance(cells.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(c)
    # a cell goes to all blocks that have one of its corners
    spread = cells.select("k", "region", plain("k").alias("kn"), plain("region").alias("rn"), x.alias("x"), y.alias("y"), *edges)
    for c in ("x", "y"):
        spread = spread.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.col(c) / block), F.floor((F.col(c) + 1) / block))))
    lot = F.pmod(F.xxhash64("k", "bx", "by"), F.lit(LOTS)).cast("int")

    def trace(table: pa.Table) -> pa.Table:
        number = lambda c: np.unique(table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
        whole = lambda c: table.column(c).to_numpy().astype(np.int64)
        group = np.zeros(table.num_rows, np.int64)
        for c in ("kn", "rn", "bx", "by"):
            n = number(c)
            group = np.unique(group * (n.max() + 1) + n, return_inverse=True)[1]
        _, some = np.unique(group, return_index=True)  # a row of each group
        bx, by = whole("bx") * block, whole("by") * block
        # a corner has the number of the cell to its lower left; a block has the cells around all of its corners
        wide = block + 2
        lx, ly = whole("x") - bx + 1, whole("y") - by + 1
        cell = np.unique((group * wide + ly) * wide + lx)
        has = lambda at: cell[np.minimum(np.searchsorted(cell, at), len(cell) - 1)] == at
        at = np.unique(np.concatenate([cell - i - j * wide for i in (0, 1) for j in (0, 1)]))
        g, vy, vx = at // (wide * wide), at // wide % wide, at % wide
        # numbers beside the block lie in its margin
        own = (vx < block) & (vy < block) & (at >= 0)
        at, g, vx, vy = at[own], g[own], vx[own], vy[own]
        px, py = bx[some][g] + vx, by[some][g] + vy
        sw, se, nw, ne = (has(at + i + j * wide) for j in (0, 1) for i in (0, 1))
        out = np.stack([ne & ~se, nw & ~ne, sw & ~nw, se & ~sw], 1)
        into = np.stack([nw & ~sw, sw & ~se, se & ~ne, ne & ~nw], 1)
        if edges:
            fx0, fy0, fx1, fy1 = (whole(c)[some][g] for c in edges)
            upright, flat = (px == fx0) | (px == fx1 + 1), (py == fy0) | (py == fy1 + 1)
            for sides in (out, into):
                sides[:, 1::2] &= ~upright[:, None]
                sides[:, ::2] &= ~flat[:, None]
        # sides are numbered in the order of (y, x, turn) of where they start
        corner, turn = np.nonzero(out)
        side = np.full(out.shape, -1)
        side[out] = np.arange(len(corner))
        # to the left first, which is the same cell, then straight on, then to the right
        then = np.full(out.shape, -1)
        for t in range(4):
            for other in ((t + 3) % 4, t, (t + 1) % 4):
                then[:, t] = np.where(into[:, t] & out[:, other], side[:, other], then[:, t])
        inside = lambda i, j: (i >= 0) & (i < block) & (j >= 0) & (j < block)
        dx, dy = _STEPS[turn].T
        stays = inside(vx[corner] + dx, vy[corner] + dy)
        end = np.searchsorted(at, at[corner] + dx + dy * wide)
        after = np.full(len(corner), -1)
        after[stays] = then[end[stays], turn[stays]]
        before = np.full(len(corner), -1)
        before[after[after >= 0]] = np.flatnonzero(after >= 0)
        prior = np.full((len(corner), 3), -1)
        known = np.zeros(len(corner), bool)
        for t, (i, j) in enumerate(_STEPS):
            come = (then[:, t] >= 0) & ~inside(vx - i, vy - j)
            known[then[come, t]] = True
            prior[then[come, t]] = np.stack([py[come] - j, px[come] - i, np.full(come.sum(), t)], 1)
        root, place, ring = _chains(before)
        order = np.lexsort((place, root))
        first = np.append(True, root[order][1:] != root[order][:-1])[: len(order)]
        bends = first | (np.roll(turn[order], 1) != turn[order])
        heads = order[first]
        tails = order[np.append(np.flatnonzero(first)[1:], len(order)) - 1] if len(order) else order
        listed = order[bends]
        starts = np.append(np.flatnonzero(first[bends]), len(listed))
        of = lambda s: pa.StructArray.from_arrays([pa.array(v) for v in (py[corner[s]], px[corner[s]], turn[s].astype(np.int32))], ["y", "x", "turn"])
        points = pa.StructArray.from_arrays([pa.array(v) for v in (px[corner[listed]], py[corner[listed]], turn[listed].astype(np.int32))], ["x", "y", "turn"])
        come = prior[heads]
        was = pa.StructArray.from_arrays([pa.array(come[:, 0]), pa.array(come[:, 1]), pa.array(come[:, 2].astype(np.int32))], ["y", "x", "turn"], mask=pa.array(~known[heads]))
        found = table.select(["k", "region"]).take(pa.array(some[g[corner[heads]]]))
        new = {"closed": pa.array(ring[heads]), "points": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), points), "head": of(heads), "tail": of(tails), "prior": was, "leaves": pa.array(~stays[tails])}
        for name, values in new.items():
            found = found.append_column(name, values)
        return found

    kind = lambda c: cells.schema[c].dataType.simpleString()
    place = "struct<y:bigint,x:bigint,turn:int>"
    schema = f"k {kind('k')}, region {kind('region')}, closed boolean, points array<struct<x:bigint,y:bigint,turn:int>>, head {place}, tail {place}, prior {place}, leaves boolean"
    return spread.withColumn("lot", lot).groupBy("lot").applyInArrow(trace, schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """(k, region, closed, all, tail): pieces of outlines put together, the least side of a closed one first."""
    side = lambda c: F.struct("k", "region", *[F.col(f"{c}.{f}").alias(f) for f in ("y", "x", "turn")])
    pieces = written(pieces.withColumn("node", side("head")), "outline-pieces")
    later = pieces.where("prior IS NOT NULL").select(side("prior").alias("from"), F.col("node").alias("next"))
    links = written(pieces.select("node", F.when(F.col("leaves"), side("tail")).alias("from")).join(by_sort(later), "from", "left").select("node", "next"), "outline-links")
    sets = written(pieces.select("node").join(by_sort(components(links.where("next IS NOT NULL").select(F.col("node").alias("a"), F.col("next").alias("b")), "outlines")), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "outline-sets")
    # an open outline is ranked by its last piece, a closed one by its least
    last = links.where("next IS NULL").select("node")
    open_sets = sets.join(by_sort(last), "node").select("label", F.lit(False).alias("closed")).distinct()
    stops = last.union(sets.select(F.col("label").alias("node")).distinct().join(by_sort(open_sets.select(F.col("label").alias("node"))), "node", "left_anti"))
    far = nearest_stops(links, stops, "outline-ranks")
    placed = far.join(by_sort(sets), "node").join(by_sort(open_sets), "label", "left").withColumn("closed", F.coalesce("closed", F.lit(True)))
    # the least piece of a closed one comes first, though it is the one that all others lead to
    place = F.when(F.col("closed") & (F.col("steps") == 0), F.lit(-(1 << 62)).cast("long")).otherwise(-F.col("steps"))
    parts = placed.join(by_sort(pieces.select("node", "points", "tail")), "node").groupBy("label", "closed").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "points", "tail"))).alias("parts"))
    listed = parts.select("label.k", "label.region", "closed", F.flatten("parts.points").alias("all"), F.element_at("parts", -1)["tail"].alias("tail"))

    def turned(all_: Column) -> Column:
        key = lambda p: F.struct(p["y"], p["x"], p["turn"])
        return bound(F.array_position(F.transform(all_, key), F.array_min(F.transform(all_, key))).cast("int"), lambda n: F.concat(F.slice(all_, n, F.size(all_)), F.slice(all_, 1, n - 1)))

    return listed.withColumn("all", F.when(F.col("closed"), bound(F.col("all"), turned)).otherwise(F.col("all")))


def outlines(cells: DataFrame, key: str, frame: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Rings around regions of ``cells`` (key, region, gx, gy, each once): (key, region, closed, ring), corners alone. Outer ones are counter-clockwise, those of holes clockwise.

    Where two cells of a region touch at a corner alone, outlines keep to their own cell. With ``frame`` (key, x0, y0, x1, y1: the cells that an image
    goes from and to) sides on the edge of the image are no outline; what is left of one that meets the edge is open, from its first corner to its last.
    """
    rows = cells.select(F.col(key).alias("k"), "region", "gx", "gy")
    if frame is not None:
        f = frame.select(F.col(key).alias("k"), *[F.col(c).cast("long").alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")])
        rows = rows.join(f, "k")
    parts = written(traced(rows, block), "outline-parts")
    found = parts.where("prior IS NULL AND NOT leaves").select("k", "region", "closed", F.col("points").alias("all"), "tail")
    pieces = parts.where("prior IS NOT NULL OR leaves")
    if pieces.limit(1).count():
        found = found.unionByName(_joined(pieces))
    turns = lambda p, i, all_: (i == 0) & ~F.col("closed") | (p["turn"] != F.element_at(all_, F.pmod(i - 1, F.size(all_)) + 1)["turn"])
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    corners = bound(F.col("all"), lambda all_: F.transform(F.filter(all_, lambda p, i: turns(p, i, all_)), lambda p: at(p["x"], p["y"])))
    end = bound(F.col("tail"), lambda p: at(p["x"] + F.when(p["turn"] == 0, 1).when(p["turn"] == 2, -1).otherwise(0), p["y"] + F.when(p["turn"] == 1, 1).when(p["turn"] == 3, -1).otherwise(0)))
    return found.select(F.col("k").alias(key), "region", "closed", F.when(F.col("closed"), corners).otherwise(F.concat(corners, F.array(end))).alias("ring"))


# --- queries ---------------------------------------------------------------------------------------------------

_CLASSES = "c AS (SELECT roi_id, tx, ty, CASE WHEN n_flooded > 8000 THEN 2 WHEN n_permanent_water > 10000 THEN 1 ELSE 0 END AS region FROM g_tile)"


@query("outlines", f"""WITH {_CLASSES}, n AS (SELECT c.*, (SELECT count(*) FROM c d WHERE d.roi_id = c.roi_id AND d.region = c.region AND abs(d.tx - c.tx) + abs(d.ty - c.ty) = 1) AS around FROM c)
    SELECT roi_id, region, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - around) AS DOUBLE) AS length FROM n GROUP BY roi_id, region""")  # fmt: skip
def _outlines(v):
    """Outlines of each class of each ROI: the areas of the rings, holes taken off, and their length."""
    cells = v("g_tile").select("roi_id", F.when(F.col("n_flooded") > 8000, 2).when(F.col("n_permanent_water") > 10000, 1).otherwise(0).alias("region"), F.col("tx").alias("gx"), F.col("ty").alias("gy"))
    rings = outlines(cells, "roi_id")
    length = bound(F.col("ring"), lambda r: F.aggregate(F.transform(r, lambda p, i: F.abs(p["x"] - F.element_at(r, F.pmod(i + 1, F.size(r)) + 1)["x"]) + F.abs(p["y"] - F.element_at(r, F.pmod(i + 1, F.size(r)) + 1)["y"])), F.lit(0.0), lambda a, b: a + b))
    return rings.groupBy("roi_id", "region").agg(F.sum(ring_area(F.col("ring"))).alias("area"), F.sum(length).alias("length"))
