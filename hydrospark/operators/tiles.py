"""Statistics of tiles and sites, and differences between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.operators.projections import LEAD_BINS, lead_days
from hydrospark.operators.projections import flood_of_key
from hydrospark.plans.registry import query

PIXEL_COUNTS = ("n_background", "n_permanent_water", "n_flooded")


def class_counts(pixels: DataFrame) -> DataFrame:
    """Background, permanent water and flood pixels of each tile."""
    return pixels.groupBy("tile_id").agg(*[F.count_if(F.col("targ") == i).alias(name) for i, name in enumerate(PIXEL_COUNTS)])


def tile_distribution(tiles: DataFrame, *by: str) -> DataFrame:
    """Tiles and pixels by class, and the shares of the classes."""
    sums = tiles.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tiles"), *[F.sum(c).alias(c) for c in PIXEL_COUNTS])
    total = sum((F.col(c) for c in PIXEL_COUNTS[1:]), F.col(PIXEL_COUNTS[0]))
    return sums.withColumns({f"{c[2:]}_share": F.round(F.try_divide(F.col(c).cast("double"), total), 6) for c in PIXEL_COUNTS})


def roi_counts(rois: DataFrame, tiles: DataFrame, types: tuple[str, ...] = ("generated", "kurosiwo")) -> DataFrame:
    """ROIs and tiles of each fold, a pair of columns for each source."""
    per = tiles.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n"))
    j = rois.join(per, "roi_id", "left")
    wide = j.groupBy("fold").pivot("type", list(types)).agg(F.count("roi_id").alias("rois"), F.coalesce(F.sum("n"), F.lit(0)).alias("tiles"))
    return wide.select("fold", *[F.coalesce(f"{t}_{c}", F.lit(0)).alias(f"{t}_{c}") for t in types for c in ("rois", "tiles")])


def site_summary(rois: DataFrame, tiles: DataFrame, flooded: Column, least: int = 50, floods: DataFrame | None = None) -> DataFrame:
    """Centre, counts and whether more than ``least`` tiles are flooded, for each ROI. With ``floods`` (id, maincause), generated ROIs get the cause of the flood that their ``key`` names."""
    per = tiles.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n_tiles"), F.count_if(flooded).alias("n_flooded_tiles"), F.sum("n_flooded").alias("flood_pixels"), F.round(F.avg((F.col("xlo") + F.col("xhi")) / 2), 6).alias("lon"), F.round(F.avg((F.col("ylo") + F.col("yhi")) / 2), 6).alias("lat"))
    found = rois.join(per, "roi_id").withColumn("is_flooded", F.col("n_flooded_tiles") > least)
    if floods is None:
        return found.select("roi_id", "type", "fold", *per.columns[1:], "is_flooded")
    flood = F.when(F.col("type") == "generated", flood_of_key(F.col("key")))
    causes = floods.select(F.col("id").alias("flood_id"), F.col("maincause").alias("cause"))
    return found.withColumn("flood_id", flood).join(causes, "flood_id", "left").select("roi_id", "type", "fold", "cause", *per.columns[1:], "is_flooded")


def group_label_tiles(tiles: DataFrame, keys: list[Column], flooded: Column) -> DataFrame:
    """One row for each group of label tiles: bounds, counts of pixels, and flooded tiles."""
    return tiles.groupBy(*keys).agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"), F.count(F.lit(1)).alias("n_tiles"), F.count_if(flooded).alias("n_flooded_tiles"), *[F.sum(c).alias(c) for c in PIXEL_COUNTS])


def lead_time_histogram(rois: DataFrame) -> DataFrame:
    """One-day bins; all above the last one are in it, empty bins are kept."""
    counts = rois.groupBy(lead_days(F.col("pre1_date"), F.col("post_date"), LEAD_BINS - 1).alias("days")).agg(F.count(F.lit(1)).alias("n"))
    bins = rois.sparkSession.range(LEAD_BINS).select(F.col("id").cast("int").alias("days"))
    return bins.join(counts, "days", "left").select("days", F.coalesce("n", F.lit(0)).alias("n"))


def best_balanced_tile(tiles: DataFrame) -> DataFrame:
    """The tile of each ROI whose share of water is nearest to one half, the least id on ties."""
    share = (F.col("n_permanent_water") + F.col("n_flooded")) / (F.col("n_background") + F.col("n_permanent_water") + F.col("n_flooded"))
    return tiles.groupBy("roi_id").agg(F.min_by("tile_id", F.struct(F.round(F.abs(share - 0.5), 9), "tile_id")).alias("tile_id"))


def balance_score(rows: DataFrame, key: str, parts: int = 5) -> DataFrame:
    """Mean over the values of ``key`` of the deviation of its share across partitions 0 to parts - 1; 0 is balanced."""
    # one column for each partition, so that missing ones count as 0
    wide = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("part") == k).alias(f"p{k}") for k in range(parts)])
    shares = wide.select(key, F.explode(F.array(*[F.col(f"p{k}") / F.col("n") for k in range(parts)])).alias("share"))
    return shares.groupBy(key).agg(F.stddev_pop("share").alias("s")).agg(F.round(F.avg("s"), 6).alias("score"))


def stop_at_first_flooded(tuplets: DataFrame, order: list[Column], least: int) -> DataFrame:
    """Of each ROI the tuplets in order, up to and with the first that has ``least`` flooded ones."""
    before = Window.partitionBy("roi_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    flag = (F.col("n_flooded") >= least).cast("int")
    return tuplets.withColumn("done", F.coalesce(F.sum(flag).over(before), F.lit(0))).where("done = 0").withColumn("flooding", F.col("n_flooded") >= least).drop("done")


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that only one of two runs has, and those of both."""
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.exceptAll(b), "only_a").unionByName(side(b.exceptAll(a), "only_b")).unionByName(side(a.intersect(b), "both"))


def tile_set_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiles (roi_id, tile_id) of both runs and of either, for each ROI."""
    sides = a.distinct().withColumn("a", F.lit(1)).join(b.distinct().withColumn("b", F.lit(1)), ["roi_id", "tile_id"], "full_outer")
    return sides.groupBy("roi_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("n_either")).withColumn("iou", F.round(F.col("n_both") / F.col("n_either"), 6))


# --- queries -------------------------------------------------------------------------------------------------

_FLOODED = "n_flooded / CAST(n_background + n_permanent_water + n_flooded AS DOUBLE) > 0.05"


def _flooded() -> Column:
    return F.col("n_flooded") / (F.col("n_background") + F.col("n_permanent_water") + F.col("n_flooded")) > 0.05


@query("class_counts", "SELECT tile_id, CAST(count_if(targ = 0) AS BIGINT) AS n_background, CAST(count_if(targ = 1) AS BIGINT) AS n_permanent_water, CAST(count_if(targ = 2) AS BIGINT) AS n_flooded FROM g_pixel GROUP BY tile_id")
def _class_counts(v):
    return class_counts(v("g_pixel"))


_SUMS = "CAST(sum(n_background) AS BIGINT) AS n_background, CAST(sum(n_permanent_water) AS BIGINT) AS n_permanent_water, CAST(sum(n_flooded) AS BIGINT) AS n_flooded"


@query("tile_distribution", f"WITH s AS (SELECT type, count(*) AS n_tiles, {_SUMS} FROM g_tile t JOIN g_roi r ON t.roi_id = r.roi_id GROUP BY type) SELECT *, round(CAST(n_background AS DOUBLE) / (n_background + n_permanent_water + n_flooded), 6) AS background_share, round(CAST(n_permanent_water AS DOUBLE) / (n_background + n_permanent_water + n_flooded), 6) AS permanent_water_share, round(CAST(n_flooded AS DOUBLE) / (n_background + n_permanent_water + n_flooded), 6) AS flooded_share FROM s")
def _distribution(v):
    return tile_distribution(v("g_tile").join(v("g_roi").select("roi_id", "type"), "roi_id"), "type")


@query("roi_counts", """WITH j AS (SELECT r.*, n FROM g_roi r LEFT JOIN (SELECT roi_id, count(*) AS n FROM g_tile GROUP BY roi_id) t ON r.roi_id = t.roi_id)
    SELECT fold, CAST(count_if(type = 'generated') AS BIGINT) AS generated_rois, CAST(coalesce(sum(CASE WHEN type = 'generated' THEN n END), 0) AS BIGINT) AS generated_tiles,
      CAST(count_if(type = 'kurosiwo') AS BIGINT) AS kurosiwo_rois, CAST(coalesce(sum(CASE WHEN type = 'kurosiwo' THEN n END), 0) AS BIGINT) AS kurosiwo_tiles FROM j GROUP BY fold""")  # fmt: skip
def _roi_counts(v):
    return roi_counts(v("g_roi"), v("g_tile"))


@query("site_summary", f"""WITH p AS (SELECT roi_id, count(*) AS n_tiles, CAST(count_if({_FLOODED}) AS BIGINT) AS n_flooded_tiles, CAST(sum(n_flooded) AS BIGINT) AS flood_pixels, round(avg((xlo + xhi) / 2), 6) AS lon, round(avg((ylo + yhi) / 2), 6) AS lat FROM g_tile GROUP BY roi_id)
    SELECT p.*, type, fold, CASE WHEN type = 'generated' THEN maincause END AS cause, n_flooded_tiles > 85 AS is_flooded FROM p JOIN g_roi r ON p.roi_id = r.roi_id LEFT JOIN g_flood f ON f.id = r.roi_id""")  # fmt: skip
def _summary(v):
    rois = v("g_roi").withColumn("key", F.concat_ws("-", F.col("roi_id").cast("string"), F.lit("1080000010")))
    return site_summary(rois, v("g_tile"), _flooded(), 85, v("g_flood").select("id", "maincause"))


@query("group_label_tiles", f"SELECT roi_id, CAST(tx % 4 AS INT) AS actid, CAST(ty % 3 AS INT) AS aoiid, min(xlo) AS xlo, min(ylo) AS ylo, max(xhi) AS xhi, max(yhi) AS yhi, count(*) AS n_tiles, CAST(count_if({_FLOODED}) AS BIGINT) AS n_flooded_tiles, {_SUMS} FROM g_tile GROUP BY roi_id, CAST(tx % 4 AS INT), CAST(ty % 3 AS INT)")
def _group(v):
    return group_label_tiles(v("g_tile"), [F.col("roi_id"), (F.col("tx") % 4).cast("int").alias("actid"), (F.col("ty") % 3).cast("int").alias("aoiid")], _flooded())


@query("lead_time_histogram", "SELECT CAST(d.days AS INT) AS days, count(roi_id) AS n FROM (SELECT unnest(generate_series(0, 59)) AS days) d LEFT JOIN g_roi r ON least(post_date - pre1_date, 59) = d.days GROUP BY d.days")
def _histogram(v):
    return lead_time_histogram(v("g_roi"))


@query("best_balanced_tile", "SELECT roi_id, tile_id FROM (SELECT roi_id, tile_id, row_number() OVER (PARTITION BY roi_id ORDER BY round(abs(CAST(n_permanent_water + n_flooded AS DOUBLE) / (n_background + n_permanent_water + n_flooded) - 0.5), 9), tile_id) AS r FROM g_tile) WHERE r = 1")
def _balanced(v):
    return best_balanced_tile(v("g_tile"))


@query("balance_score", """WITH r AS (SELECT clz_cl_smj AS z, CAST((pop_ct_usu + riv_tc_usu) % 5 AS INT) AS part FROM g_basin), c AS (SELECT z, part, count(*) AS n FROM r GROUP BY z, part),
    f AS (SELECT a.z, b.part, coalesce(n, 0) AS n FROM (SELECT DISTINCT z FROM r) a CROSS JOIN (SELECT DISTINCT part FROM r) b LEFT JOIN c ON a.z = c.z AND b.part = c.part), s AS (SELECT z, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY z) AS share FROM f)
    SELECT round(avg(d), 6) AS score FROM (SELECT z, stddev_pop(share) AS d FROM s GROUP BY z)""")  # fmt: skip
def _score(v):
    return balance_score(v("g_basin").select(F.col("clz_cl_smj").alias("z"), ((F.col("pop_ct_usu") + F.col("riv_tc_usu")) % 5).alias("part")), "z")


@query("stop_at_first_flooded", """WITH o AS (SELECT roi_id, tile_id, n_flooded, sum(CASE WHEN n_flooded >= 15000 THEN 1 ELSE 0 END) OVER (PARTITION BY roi_id ORDER BY ty, tx, tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM g_tile)
    SELECT roi_id, tile_id, n_flooded, n_flooded >= 15000 AS flooding FROM o WHERE coalesce(done, 0) = 0""")  # fmt: skip
def _stop(v):
    return stop_at_first_flooded(v("g_tile"), [F.col("ty"), F.col("tx"), F.col("tile_id")], 15000).select("roi_id", "tile_id", "n_flooded", "flooding")


@query("run_diff", "SELECT roi_id, 'only_a' AS side FROM g_roi WHERE roi_id % 3 = 0 AND roi_id % 4 <> 0 UNION ALL SELECT roi_id, 'only_b' FROM g_roi WHERE roi_id % 4 = 0 AND roi_id % 3 <> 0 UNION ALL SELECT roi_id, 'both' FROM g_roi WHERE roi_id % 12 = 0")
def _diff(v):
    return run_diff(v("g_roi").where("roi_id % 3 = 0").select("roi_id"), v("g_roi").where("roi_id % 4 = 0").select("roi_id"))


@query("tile_set_iou", "WITH s AS (SELECT roi_id, n_flooded > 4000 AS a, n_permanent_water > 9000 AS b FROM g_tile) SELECT roi_id, CAST(count_if(a AND b) AS BIGINT) AS n_both, CAST(count_if(a OR b) AS BIGINT) AS n_either, round(CAST(count_if(a AND b) AS DOUBLE) / count_if(a OR b), 6) AS iou FROM s WHERE a OR b GROUP BY roi_id")
def _iou(v):
    return tile_set_iou(v("g_tile").where("n_flooded > 4000").select("roi_id", "tile_id"), v("g_tile").where("n_permanent_water > 9000").select("roi_id", "tile_id"))
