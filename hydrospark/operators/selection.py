"""Greedy selection of sites in parallel rounds.

The walk that is meant is sequential: by falling impact, a candidate becomes a site unless it is too near a site, its zones have enough
basins already, or its continent is done. Here all candidates look at once at what is certain about those of better rank:
which of them are sites, and which may still become one. A candidate is taken when no open one of better rank is in its way and
its zones have room even if all of these are taken; it is dropped when a site is in its way or its zones are full without them.
All others wait for the next round. The best open candidate of a continent is always certain, so rounds end, and the sites are
those of the sequential walk.

Nothing is paired but candidates and sites near them, of which there are few: what is in the way of a candidate is the least open rank around its
box, by place and time. Counts before a rank are prefix sums in chunks of ranks, so no task holds a continent or a zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.operators.events import distribution_report
from hydrospark.operators.polygons import BOUNDS, box_corners, hull_ring, union_area
from hydrospark.operators.projections import coastal_outlets, flood_impact
from hydrospark.operators.scenes import scene_eligibility
from hydrospark.operators.spatial import _HULL, alike_overlap_join, ring_area, spatial_join, zone_counts
from hydrospark.plans.joins import by_sort
from hydrospark.plans.registry import query
from hydrospark.plans.scratch import drop_written, written

CHUNK = 50_000  # ranks that one task sums up in order


def ranked(rows: DataFrame, order: list[Column], into: str = "rank", table: str = "ranked") -> DataFrame:
    """``rows`` with their place in an order that leaves no ties, from 0, gapless. Ranges are sorted apart; what comes before each is a sum over ranges."""
    parts = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), table)
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    before = sizes.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return parts.withColumn(into, within).join(F.broadcast(before), "part").withColumn(into, F.col(into) + F.col("before")).drop("part", "before")


def sums_before(rows: DataFrame, keys: list[str], rank: str, values: list[str], chunk: int = CHUNK) -> DataFrame:
    """``rows`` with, for each of ``values``, the sum ``before_<value>`` over the rows of its keys with a lower rank."""
    parts = rows.withColumn("chunk", F.floor(F.col(rank) / chunk))
    totals = parts.groupBy(*keys, "chunk").agg(*[F.sum(v).alias(f"all_{v}") for v in values])
    past = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "chunk", *[F.coalesce(F.sum(f"all_{v}").over(past), F.lit(0)).alias(f"past_{v}") for v in values])
    own = Window.partitionBy(*keys, "chunk").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumns({f"own_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(totals, [*keys, "chunk"])
    return found.withColumns({f"before_{v}": F.col(f"own_{v}") + F.col(f"past_{v}") for v in values}).drop("chunk", *[f"own_{v}" for v in values], *[f"past_{v}" for v in values])


def gap(prefix: str = "b_") -> Column:
    """The distance of the two boxes of a pair, 0 if they meet."""
    apart = lambda lo, hi: F.greatest(F.col(f"{prefix}{lo}") - F.col(hi), F.col(lo) - F.col(f"{prefix}{hi}"), F.lit(0.0))
    return F.hypot(apart("xlo", "xhi"), apart("ylo", "yhi"))


def shares(prefix: str = "b_") -> Column:
    """Whether the two boxes of a pair share area."""
    return (F.greatest("xlo", f"{prefix}xlo") < F.least("xhi", f"{prefix}xhi")) & (F.greatest("ylo", f"{prefix}ylo") < F.least("yhi", f"{prefix}yhi"))


def grown(boxes: DataFrame, by: float) -> DataFrame:
    return boxes.withColumns({"xlo": F.col("xlo") - by, "ylo": F.col("ylo") - by, "xhi": F.col("xhi") + by, "yhi": F.col("yhi") + by})


def too_near(candidates: DataFrame, sites: DataFrame, on: list[str], degrees: float, days: int) -> DataFrame:
    """(rank) of candidates (rank, day, box) that share area with a site (day, box), or are less than ``degrees`` and ``days`` away from one."""
    around = grown(sites.select(*on, F.col("day").alias("site_day"), *BOUNDS, *[F.col(c).alias(f"own_{c}") for c in BOUNDS]), degrees)
    other = around.withColumnsRenamed({c: f"site_{c}" for c in on})
    pairs = spatial_join(candidates.select("rank", "day", *on, *BOUNDS), other)
    near = (gap("own_") < degrees) & (F.abs(F.date_diff("day", "site_day")) < days)
    same = [F.col(c) == F.col(f"site_{c}") for c in on]
    hit = shares("own_") | near
    for c in same:
        hit = hit & c
    return pairs.where(hit).select("rank").distinct()


def select_sites(candidates: DataFrame, zones: DataFrame, expected: DataFrame, seeds: DataFrame | None = None, seed_counts: DataFrame | None = None, degrees: float = 3.5, days: int = 20, slack: int = 3, chunk: int = CHUNK) -> DataFrame:
    """The candidates that become sites, each continent on its own, with their rank.

    ``candidates`` (continent, id, hybas_id, impact, pop, day, box, flooding, has_scenes): by impact, then population, both falling, then ids.
    ``zones`` (id, hybas_id, zone, n): the basins of each climate zone that a candidate covers. ``expected`` (continent, zone, basins).
    ``seeds`` (day, box) are sites there already, of any continent, ``seed_counts`` (continent, zone, n) their basins.

    A candidate is passed over without scenes; if it shares area with a site or is less than ``degrees`` and ``days`` away from one; and if not over
    half of its zones still want it: those in which the basins of flooded sites and its own are below what is expected and ``slack``. Sites without
    floods count apart, by half, and only for the end: once all zones of a continent have what is expected, nothing more is taken there.
    """
    spark = candidates.sparkSession
    rows = ranked(candidates, [F.desc("impact"), F.desc("pop"), F.col("id"), F.col("hybas_id")], table="site-candidates")
    counts = seed_counts if seed_counts is not None else spark.createDataFrame([], "continent int, zone int, n long")
    wanted = expected.select("continent", "zone", "basins").join(counts.groupBy("continent", "zone").agg(F.sum("n").alias("seeded")), ["continent", "zone"], "left").fillna(0, ["seeded"])
    wanted = written(wanted, "site-zones")
    open_ = rows.where("has_scenes")
    if seeds is not None:
        open_ = open_.join(by_sort(too_near(open_, seeds, [], degrees, days)), "rank", "left_anti")
    # half counts of sites without floods, doubled: everything below is in halves where it is about the end
    open_ = written(open_.select("rank", "continent", "id", "hybas_id", "impact", "day", "flooding", *BOUNDS, F.floor(F.date_diff("day", F.lit("2000-01-01").cast("date")) / days).alias("bucket")), "site-open")
    zoned = zones.join(by_sort(open_.select("rank", "continent", "id", "hybas_id", "flooding")), ["id", "hybas_id"]).join(wanted, ["continent", "zone"], "left").fillna(0, ["basins", "seeded"])
    zoned = written(zoned.select("rank", "continent", "zone", "n", "flooding", "basins", "seeded"), "site-zoned")
    boxes = written(open_.select("continent", *BOUNDS).distinct(), "site-boxes")
    # which boxes are in each other's way always (they share area), or at about the same time; by their corners, each box with itself too
    corner = F.struct(*BOUNDS)
    left = boxes.select("continent", corner.alias("box"), *BOUNDS, *[F.col(c).alias(f"own_{c}") for c in BOUNDS])
    pairs = spatial_join(grown(left, degrees), boxes.withColumnRenamed("continent", "b_continent")).where("continent = b_continent")
    pairs = pairs.drop(*BOUNDS).withColumnsRenamed({f"own_{c}": c for c in BOUNDS}).where(shares() | (gap() < degrees))
    near = written(pairs.select("continent", "box", F.struct(*[F.col(f"b_{c}").alias(c) for c in BOUNDS]).alias("other"), shares().alias("always")), "site-near")
    taken = None
    while open_.limit(1).count():
        done, state = _round(open_, zoned, near, wanted, taken, slack, chunk)
        fresh = written(done.where("take").drop("take"), "site-taken")
        taken = fresh if taken is None else taken.unionByName(fresh)
        left_over = state.join(by_sort(too_near(state, fresh, ["continent"], degrees, days)), "rank", "left_anti")
        before, open_ = open_, written(left_over, "site-open")
        drop_written(before)
    return taken if taken is not None else open_


def _round(open_: DataFrame, zoned: DataFrame, near: DataFrame, wanted: DataFrame, taken: DataFrame | None, slack: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """What is certain of the open candidates: (those to take, flagged; those that stay open)."""
    place = F.struct(*BOUNDS).alias("box")
    # the least open rank of a box, at any time and by time
    by_time = open_.groupBy("continent", place, "bucket").agg(F.min("rank").alias("least"))
    ever = by_time.groupBy("continent", "box").agg(F.min("least").alias("least"))
    other = near.join(by_sort(ever.withColumnRenamed("box", "other")), ["continent", "other"])
    always = other.where("always").groupBy("continent", "box").agg(F.min("least").alias("before"))
    then = near.where("NOT always").join(by_sort(by_time.withColumnRenamed("box", "other")), ["continent", "other"])
    then = then.select("continent", "box", F.explode(F.expr("sequence(bucket - 1, bucket + 1)")).alias("bucket"), "least").groupBy("continent", "box", "bucket").agg(F.min("least").alias("before_then"))
    # counts of certain and of possible basins before each candidate, in its zones
    state = open_.select("rank", F.lit(True).alias("open"))
    if taken is not None:
        state = state.unionByName(taken.select("rank", F.lit(False).alias("open")))
    z = zoned.join(by_sort(state), "rank")
    part = lambda of, open_too: F.when(of & (F.lit(True) if open_too else ~F.col("open")), F.col("n")).otherwise(F.lit(0))
    flooded, all_ = F.col("flooding"), F.lit(True)
    halves = lambda open_too: part(flooded, open_too) * 2 + part(~flooded, open_too)
    z = z.withColumns({"sure": part(flooded, False), "most": part(flooded, True), "end_sure": halves(False), "end_most": halves(True)})
    z = sums_before(z, ["continent", "zone"], "rank", ["sure", "most", "end_sure", "end_most"], chunk)
    room = F.col("basins") + slack - F.col("seeded") - F.col("n")
    fits = z.where("open").groupBy("rank").agg(F.count(F.lit(1)).alias("n_zones"), F.count_if(F.col("before_most") < room).alias("n_fit"), F.count_if(F.col("before_sure") < room).alias("n_may"))
    # the rank after which a zone has what is expected: for certain, and at the earliest
    need = (F.col("basins") - F.col("seeded")) * 2
    met = z.groupBy("continent", "zone").agg(F.min(F.when(F.col("before_end_sure") + F.col("end_sure") >= need, F.col("rank"))).alias("sure_at"), F.min(F.when(F.col("before_end_most") + F.col("end_most") >= need, F.col("rank"))).alias("may_at"))
    never = F.lit((1 << 62)).cast("long")
    ends = wanted.join(met, ["continent", "zone"], "left")
    at = lambda c: F.max(F.when(F.col("basins") <= F.col("seeded"), F.lit(-1).cast("long")).otherwise(F.coalesce(c, never))).alias(f"{c}_end")
    ends = ends.groupBy("continent").agg(at("sure_at"), at("may_at"))
    rows = open_.withColumn("box", place).join(by_sort(always), ["continent", "box"], "left").join(by_sort(then), ["continent", "box", "bucket"], "left").join(by_sort(fits), "rank", "left").join(ends, "continent", "left").fillna(0, ["n_zones", "n_fit", "n_may"])
    rank = F.col("rank")
    free = (F.coalesce("before", rank) >= rank) & (F.coalesce("before_then", rank) >= rank)
    # a continent of which nothing is expected is done at once, like one whose zones are all met
    rows = rows.withColumns({"sure_at_end": F.coalesce("sure_at_end", F.lit(-1)), "may_at_end": F.coalesce("may_at_end", F.lit(-1))})
    take = free & (F.col("n_fit") * 2 > F.col("n_zones")) & (rank <= F.col("may_at_end"))
    drop = (F.col("n_may") * 2 <= F.col("n_zones")) | (rank > F.col("sure_at_end"))
    judged = written(rows.select(*open_.columns, (take & ~drop).alias("take"), drop.alias("drop")), "site-judged")
    return judged.drop("drop").where("take"), judged.where("NOT take AND NOT `drop`").drop("take", "drop")


# --- queries ---------------------------------------------------------------------------------------------------


def candidates_of(v) -> DataFrame:
    """Floods over coastal basins, each with the basin's box and half of the next one's; two of three are taken to be flooded, and basins have the scenes of a search key."""
    basins = coastal_outlets(v("g_basin"), 0).select("hybas_id", "continent", "pop_ct_usu", *BOUNDS)
    floods = v("g_flood").select("id", "dead", "displaced", F.col("began").alias("day"), *BOUNDS)
    found = scene_eligibility(v("g_scene"), v("g_scene_event")).select("basin_key", F.lit(True).alias("found"))
    pairs = alike_overlap_join(basins, floods, 0.1).withColumn("basin_key", F.col("hybas_id") % 40).join(found, "basin_key", "left")
    impact = flood_impact(F.col("dead"), F.col("displaced")).alias("impact")
    return pairs.select("continent", "id", "hybas_id", impact, F.col("pop_ct_usu").alias("pop"), "day", "xlo", "ylo", (F.col("xhi") + 1.5).alias("xhi"), "yhi", (F.col("id") % 3 != 0).alias("flooding"), F.coalesce("found", F.lit(False)).alias("has_scenes"))


@query("select_sites")
def _select(v):
    candidates = written(candidates_of(v), "site-all")
    basins = v("g_basin").select("hybas_id", "clz_cl_smj", *BOUNDS)
    # a place has the same basins whatever the flood
    places = candidates.select("continent", "hybas_id", *BOUNDS).distinct()
    zones = zone_counts(basins, places.select("hybas_id", *BOUNDS).withColumnRenamed("hybas_id", "place"), "place").withColumnsRenamed({"place": "hybas_id", "clz_cl_smj": "zone"})
    zones = candidates.select("id", "hybas_id").join(by_sort(zones), "hybas_id").select("id", "hybas_id", "zone", "n")
    expected = v("g_basin").groupBy("continent", F.col("clz_cl_smj").alias("zone")).agg(F.floor(F.count(F.lit(1)) / 4).cast("long").alias("basins"))
    sites = v("g_roi").where("type = 'kurosiwo'").join(v("g_tile").groupBy("roi_id").agg(*[(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in BOUNDS]), "roi_id")
    counts = zone_counts(basins, sites.select("roi_id", *BOUNDS), "roi_id").join(sites.select("roi_id", "continent"), "roi_id").select("continent", F.col("clz_cl_smj").alias("zone"), "n")
    found = select_sites(candidates, zones, expected, sites.select(F.col("post_date").alias("day"), *BOUNDS), counts)
    return found.select("continent", "id", "hybas_id", "impact", "day", *BOUNDS)


# --- labelled sites ----------------------------------------------------------------------------------------------


def zones_of_tiles(basins: DataFrame, tiles: DataFrame, key: str, threshold: float = 0.3) -> DataFrame:
    """(key, zone, n): basins by climate zone of which the union of a key's tiles covers more than ``threshold``; exact for tiles that overlap or lie off any grid."""
    # basins of one place are covered alike
    place = F.struct(*BOUNDS).alias("place")
    alike = basins.groupBy(place, F.col("clz_cl_smj").alias("zone")).agg(F.count_distinct("hybas_id").alias("n"))
    pairs = spatial_join(tiles.select(key, *BOUNDS).distinct(), basins.select(place, *BOUNDS).distinct())
    own = (F.col("b_xhi") - F.col("b_xlo")) * (F.col("b_yhi") - F.col("b_ylo"))
    part = pairs.select(key, "place", own.alias("own"), *[F.greatest(c, f"b_{c}").alias(c) for c in ("xlo", "ylo")], *[F.least(c, f"b_{c}").alias(c) for c in ("xhi", "yhi")])
    covered = union_area(part, [key, "place", "own"]).where(F.round(F.col("area") / F.col("own"), 9) > threshold)
    return covered.join(by_sort(alike), "place").groupBy(key, "zone").agg(F.sum("n").alias("n"))


def seed_from_labels(rois: DataFrame, tiles: DataFrame, basins: DataFrame) -> DataFrame:
    """(continent, zone, n, n_tiles): the basins that labelled sites cover, and the tiles of the sites that do."""
    labelled = rois.where(F.col("type") == "kurosiwo").select("roi_id", "continent")
    own = tiles.join(labelled, "roi_id")  # one row a site
    zones = zones_of_tiles(basins, own, "roi_id").join(own.groupBy("roi_id", "continent").agg(F.count(F.lit(1)).alias("n_tiles")), "roi_id")
    return zones.groupBy("continent", "zone").agg(F.sum("n").alias("n"), F.sum("n_tiles").alias("n_tiles"))


def label_footprints(rois: DataFrame, tiles: DataFrame) -> DataFrame:
    """(roi_id, day, ring): when and where labelled sites are, as the convex hull of their tiles."""
    labelled = rois.where(F.col("type") == "kurosiwo").select("roi_id", F.col("post_date").alias("day"))
    # of the tiles in one column only the lowest and the highest can be on the hull
    ends = tiles.join(labelled, "roi_id").groupBy("roi_id", "day", "xlo", "xhi").agg(F.min("ylo").alias("ylo"), F.max("yhi").alias("yhi"))
    corners = F.flatten(F.collect_list(box_corners(*[F.col(c) for c in BOUNDS])))
    return ends.groupBy("roi_id", "day").agg(corners.alias("corners")).select("roi_id", "day", hull_ring(F.col("corners")).alias("ring"))


_ZONES = """u AS (SELECT roi_id, hybas_id, clz_cl_smj AS zone, count(DISTINCT t.xlo * 100000 + t.ylo) * 0.0625E0 / 9 AS share FROM g_tile t JOIN g_basin b ON t.xlo >= b.xlo AND t.xlo < b.xhi AND t.ylo >= b.ylo AND t.ylo < b.yhi GROUP BY roi_id, hybas_id, clz_cl_smj),
    z AS (SELECT roi_id, zone, count(*) AS n FROM u WHERE share > {share} GROUP BY roi_id, zone)"""


@query("seed_from_labels", f"""WITH {_ZONES.format(share=0.3)}, t AS (SELECT roi_id, count(*) AS n_tiles FROM g_tile GROUP BY roi_id)
    SELECT continent, zone, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_tiles) AS BIGINT) AS n_tiles FROM z JOIN g_roi r ON z.roi_id = r.roi_id JOIN t ON z.roi_id = t.roi_id WHERE type = 'kurosiwo' GROUP BY continent, zone""")  # fmt: skip
def _seeds(v):
    return seed_from_labels(v("g_roi"), v("g_tile"), v("g_basin"))


@query("label_footprints", f"WITH {_HULL} SELECT h.roi_id, post_date AS day, round(hull_area, 6) AS hull_area FROM h JOIN g_roi r ON h.roi_id = r.roi_id WHERE type = 'kurosiwo'")
def _footprints(v):
    return label_footprints(v("g_roi"), v("g_tile")).select("roi_id", "day", F.round(ring_area(F.col("ring")), 6).alias("hull_area"))


@query("distribution_report", f"""WITH {_ZONES.format(share=0.05)}, e AS (SELECT continent, clz_cl_smj AS zone, CAST(floor(count(*) / 40) AS BIGINT) AS expected FROM g_basin GROUP BY continent, clz_cl_smj),
    r AS (SELECT continent, zone, expected, 0 AS created, 0 AS dry FROM e UNION ALL SELECT continent, zone, 0, CASE WHEN flooding THEN n ELSE 0 END, CASE WHEN flooding THEN 0 ELSE n END FROM z JOIN g_roi r ON z.roi_id = r.roi_id),
    b AS (SELECT 'continent' AS "by", continent AS value, expected, created, dry FROM r UNION ALL SELECT 'zone', zone, expected, created, dry FROM r)
    SELECT "by", CAST(value AS INT) AS value, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(created) AS BIGINT) AS created, sum(dry) * 0.5E0 AS negative FROM b GROUP BY "by", value""")  # fmt: skip
def _report(v):
    expected = v("g_basin").groupBy("continent", F.col("clz_cl_smj").alias("zone")).agg(F.floor(F.count(F.lit(1)) / 40).cast("long").alias("basins"))
    covered = zones_of_tiles(v("g_basin"), v("g_tile"), "roi_id", 0.05).join(v("g_roi").select("roi_id", "continent", "flooding"), "roi_id")
    return distribution_report(expected, covered)
