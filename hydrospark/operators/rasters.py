"""Rasters as long tables (key, gx, gy, value): series, resampling, focal and block operators, band statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.operators.projections import decoded
from hydrospark.plans.joins import by_sort
from hydrospark.plans.registry import query

# Offsets of a disk of radius 2.
DISK = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]


def weather_series(rows: DataFrame, window: int = 20) -> DataFrame:
    """For each cell, band and day the values of the last ``window`` days in order, null where a day is missing; a series begins with its band's first day.

    A window over the number of the day reaches back over gaps, so there are no rows for days without a value.
    """
    keys = ["gx", "gy", "band"]
    at = F.datediff("day", F.lit("1970-01-01"))
    daily = rows.groupBy(*keys, "day").agg(F.avg("value").alias("value")).withColumn("at", at)
    last = Window.partitionBy(*keys).orderBy("at").rangeBetween(1 - window, 0)
    held = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value"))).over(last)
    found = daily.select(*keys, "day", "at", "value", F.min("at").over(Window.partitionBy(*keys)).alias("first"), held.alias("held")).where(F.col("value").isNotNull())
    days = F.sequence(F.greatest(F.col("first"), F.col("at") - (window - 1)), "at")
    return found.select(*keys, "day", F.transform(days, lambda d: F.get(F.filter("held", lambda h: h["at"] == d), F.lit(0))["value"]).alias("series"))


def resample_linear(grid: DataFrame, points: DataFrame) -> DataFrame:
    """Bilinear values at points (px, py in cell units; cell centres are whole numbers); edges are extended.

    A point joins its four cells by one equi-join; missing cells leave their weight to the others.
    """
    x0, y0 = F.floor("px").cast("int"), F.floor("py").cast("int")
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    corner = lambda i, j, w: F.struct((x0 + i).alias("gx"), (y0 + j).alias("gy"), w.alias("w"))
    near = points.select("*", F.explode(F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))).alias("c")).select(*points.columns, "c.*")
    joined = near.where("w > 0").join(grid, ["gx", "gy"])
    return joined.groupBy(*points.columns).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def resample_nearest(grid: DataFrame, points: DataFrame) -> DataFrame:
    near = points.withColumns({"gx": F.floor(F.col("px") + 0.5).cast("int"), "gy": F.floor(F.col("py") + 0.5).cast("int")})
    return near.join(grid, ["gx", "gy"]).select(*points.columns, "value")


def focal(rows: DataFrame, offsets: list[tuple[int, int]], *by: str) -> DataFrame:
    """Each row once for each cell that it is a neighbour of."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    spread = rows.select(*by, "gx", "gy", "value", F.explode(steps).alias("o"))
    return spread.select(*by, (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"), "value")


def majority_filter(rows: DataFrame, *by: str) -> DataFrame:
    """The most common class within a disk of radius 2 around each cell that has one, the lowest class on ties."""
    counts = focal(rows, DISK, *by).groupBy(*by, "gx", "gy", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*by, "gx", "gy").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("filtered"))
    return rows.join(by_sort(top), [*by, "gx", "gy"])


def block_max(rows: DataFrame, side: int, *by: str) -> DataFrame:
    """Maximum of each block of ``side`` by ``side`` cells."""
    block = lambda c: F.floor(F.col(c) / side).cast("long").alias(c)
    return rows.groupBy(*by, block("gx"), block("gy")).agg(F.max("value").alias("value"))


def mosaic(rows: DataFrame, order: Column, last: bool, *by: str) -> DataFrame:
    """One value for each cell of overlapping captures: the last one that is not zero, or the first valid one."""
    valid = rows.where(F.col("value").isNotNull() & (F.col("value") != 0)) if last else rows.where(F.col("value").isNotNull())
    pick = F.max_by if last else F.min_by
    return valid.groupBy(*by, "gx", "gy").agg(pick("value", order).alias("value"))


def band_stats(rows: DataFrame, flags: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of each band, merged from centred moments; nulls are left out, bands of classes keep 0 and 1."""
    x = F.col("value")
    s = rows.where(x.isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    plain = F.col("band").isin(*flags) if flags else F.lit(False)
    return s.select("band", "n", F.when(plain, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(plain, 1.0).otherwise(F.col("std")).alias("std"))


def fold_stats(rows: DataFrame) -> DataFrame:
    """For each fold and band the mean and deviation over all rows that are not in the fold.

    One pass gives each fold's count, mean and variance; those of the others are merged around the band's own
    mean, so that nothing large is subtracted.
    """
    x = F.col("value")
    s = rows.where(x.isNotNull()).groupBy("fold", "band").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))
    # one row for each fold and band from here on
    whole = Window.partitionBy("band")
    s = s.withColumn("d", F.col("mean") - F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole))
    sums = {"on": F.col("n"), "od": F.col("n") * F.col("d"), "oq": F.col("n") * (F.col("var") + F.col("d") * F.col("d"))}
    others = s.select("*", *[(F.sum(c).over(whole) - c).alias(name) for name, c in sums.items()]).where("on > 0")
    shift = F.col("od") / F.col("on")
    var = F.col("oq") / F.col("on") - shift * shift
    return others.select("fold", "band", F.col("on").alias("n"), (F.col("mean") - F.col("d") + shift).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def nan_reductions(rows: DataFrame, *by: str) -> DataFrame:
    """Maximum, minimum, variance and deviation without NaN."""
    x = F.when(~F.isnan("value"), F.col("value"))
    return rows.groupBy(*by).agg(F.max(x).alias("most"), F.min(x).alias("least"), F.var_pop(x).alias("var"), F.stddev_pop(x).alias("std"))


def grow_window(tiles: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """Tiles and their neighbours from -k up to but without +k, inside the grid; each once."""
    reach = F.array(*[F.lit(i) for i in range(-k, k)])
    spread = tiles.select("roi_id", F.explode(reach).alias("i"), "tx", "ty").select("roi_id", (F.col("tx") + F.col("i")).alias("tx"), F.explode(reach).alias("j"), "ty")
    return spread.select("roi_id", "tx", (F.col("ty") + F.col("j")).alias("ty")).where(F.col("tx").between(0, width - 1) & F.col("ty").between(0, height - 1)).distinct()


def grid_of(rois: DataFrame, width: int, height: int, tile: float, inset: float) -> DataFrame:
    """Boxes of a grid over each ROI's corner (x0, y0), at four half-tile offsets, each pulled in by ``inset``."""
    out = rois.select("roi_id", "x0", "y0", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("tx"))
    out = out.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("ox", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("oy", F.explode(F.array(F.lit(0), F.lit(1))))
    x, y = F.col("x0") + (F.col("tx") + F.col("ox") * 0.5) * tile, F.col("y0") + (F.col("ty") + F.col("oy") * 0.5) * tile
    return out.select("roi_id", "tx", "ty", "ox", "oy", (x + inset).alias("xlo"), (y + inset).alias("ylo"), (x + tile - inset).alias("xhi"), (y + tile - inset).alias("yhi"))


def assemble_examples(tiles: DataFrame, statics: DataFrame, series: DataFrame) -> DataFrame:
    """One row for each tile: its counts, its cell's attributes, and the cell's series of each band on the tile's day."""
    maps = series.groupBy("gx", "gy", "day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("band", "series")))).alias("weather"))
    return tiles.join(statics, ["gx", "gy"], "left").join(maps, ["gx", "gy", "day"], "left")


def sorted_series(*parts: DataFrame) -> DataFrame:
    """Pieces of a series one after another, in the order of time."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.orderBy("day")


# --- queries -------------------------------------------------------------------------------------------------

_D = "SELECT day, gx, gy, band, CASE WHEN NOT is_nodata THEN raw_i16 * 0.5E0 + 10 END AS value FROM g_weather"


@query("weather_series", f"""WITH d AS (SELECT gx, gy, band, day, avg(value) AS value FROM ({_D}) GROUP BY gx, gy, band, day),
    s AS (SELECT a.gx, a.gy, a.band, a.day, CAST(count(b.value) AS BIGINT) AS n_known, round(sum(b.value), 4) AS total, least(19, a.day - min(a.day) OVER (PARTITION BY a.gx, a.gy, a.band)) AS back
      FROM d a JOIN d b ON a.gx = b.gx AND a.gy = b.gy AND a.band = b.band AND b.day BETWEEN a.day - 19 AND a.day WHERE a.value IS NOT NULL GROUP BY a.gx, a.gy, a.band, a.day)
    SELECT gx, gy, band, day, n_known, total FROM s""")  # fmt: skip
def _series(v):
    found = weather_series(decoded(v))
    return found.select("gx", "gy", "band", "day", F.size(F.filter("series", lambda x: x.isNotNull())).cast("long").alias("n_known"), F.round(F.aggregate("series", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 4).alias("total"))


_G = "g AS (SELECT gx, gy, avg(raw_i16) AS value FROM g_weather WHERE band = 'temperature_2m' GROUP BY gx, gy)"


def _grid(v):
    return v("g_weather").where("band = 'temperature_2m'").groupBy("gx", "gy").agg(F.avg("raw_i16").alias("value"))


def _targets(v):
    return v("g_gauge").select("gauge_id", (F.pmod(F.col("lon"), F.lit(22.0))).alias("px"), (F.pmod(F.col("lat"), F.lit(10.0))).alias("py"))


_P = "p AS (SELECT gauge_id, ((lon % 22) + 22) % 22 AS px, ((lat % 10) + 10) % 10 AS py FROM g_gauge)"


@query("resample_linear", f"""WITH {_G}, {_P}, o AS (SELECT unnest([0, 1]) AS i), q AS (SELECT gauge_id, floor(px) + a.i AS gx, floor(py) + b.i AS gy, CASE WHEN a.i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END * CASE WHEN b.i = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END AS w FROM p, o a, o b)
    SELECT gauge_id, round(sum(w * value) / sum(w), 4) AS value FROM q JOIN g ON q.gx = g.gx AND q.gy = g.gy WHERE w > 0 GROUP BY gauge_id""")  # fmt: skip
def _linear(v):
    return resample_linear(_grid(v), _targets(v)).select("gauge_id", F.round("value", 4).alias("value"))


@query("resample_nearest", f"WITH {_G}, {_P} SELECT gauge_id, round(value, 6) AS value FROM p JOIN g ON floor(px + 0.5) = g.gx AND floor(py + 0.5) = g.gy")
def _nearest(v):
    return resample_nearest(_grid(v), _targets(v)).select("gauge_id", F.round("value", 6).alias("value"))


_DISK_SQL = ", ".join(f"({i}, {j})" for i, j in DISK)
_TILES = "t AS (SELECT roi_id, tx AS gx, ty AS gy, CASE WHEN n_flooded > 8000 THEN 2 WHEN n_permanent_water > 10000 THEN 1 ELSE 0 END AS value FROM g_tile)"


def _classes(v):
    return v("g_tile").select("roi_id", F.col("tx").alias("gx"), F.col("ty").alias("gy"), F.when(F.col("n_flooded") > 8000, 2).when(F.col("n_permanent_water") > 10000, 1).otherwise(0).alias("value"))


@query("majority_filter", f"""WITH {_TILES}, n AS (SELECT t.roi_id, t.gx + o.i AS gx, t.gy + o.j AS gy, value, count(*) AS n FROM t, (VALUES {_DISK_SQL}) o(i, j) GROUP BY t.roi_id, t.gx + o.i, t.gy + o.j, value),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY roi_id, gx, gy ORDER BY n DESC, value) AS r FROM n) WHERE r = 1) SELECT t.roi_id, t.gx, t.gy, t.value, m.value AS filtered FROM t JOIN m ON t.roi_id = m.roi_id AND t.gx = m.gx AND t.gy = m.gy""")  # fmt: skip
def _majority(v):
    return majority_filter(_classes(v), "roi_id")


@query("block_max", "SELECT band, day, CAST(floor(gx / 2.0) AS BIGINT) AS gx, CAST(floor(gy / 2.0) AS BIGINT) AS gy, max(raw_i16) AS value FROM g_weather GROUP BY band, day, CAST(floor(gx / 2.0) AS BIGINT), CAST(floor(gy / 2.0) AS BIGINT)")
def _block(v):
    return block_max(v("g_weather").withColumnRenamed("raw_i16", "value"), 2, "band", "day")


@query("mosaic", f"WITH d AS ({_D}), f AS (SELECT *, row_number() OVER (PARTITION BY gx, gy, band ORDER BY day DESC, value DESC) AS a, row_number() OVER (PARTITION BY gx, gy, band ORDER BY day, value) AS b FROM d WHERE value IS NOT NULL) SELECT gx, gy, band, max(CASE WHEN a = 1 THEN value END) AS last_value, max(CASE WHEN b = 1 THEN value END) AS first_value FROM f GROUP BY gx, gy, band")
def _mosaic(v):
    order = F.struct("day", "value")
    last, first = mosaic(decoded(v), order, True, "band"), mosaic(decoded(v), order, False, "band")
    return last.withColumnRenamed("value", "last_value").join(first.withColumnRenamed("value", "first_value"), ["band", "gx", "gy"])


@query("band_stats", f"SELECT band, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ({_D}) GROUP BY band")
def _stats(v):
    return band_stats(decoded(v)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("fold_stats", f"WITH d AS (SELECT *, CAST(gx % 5 AS INT) AS fold FROM ({_D})), k AS (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS fold) SELECT k.fold, band, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM k JOIN d ON d.fold <> k.fold GROUP BY k.fold, band")
def _fold_stats(v):
    return fold_stats(decoded(v).withColumn("fold", F.col("gx") % 5)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("nan_reductions", f"WITH d AS (SELECT gx, gy, value FROM ({_D}) WHERE value IS NOT NULL) SELECT gx, gy, max(value) AS most, min(value) AS least, round(var_pop(value), 4) AS var, round(stddev_pop(value), 4) AS std FROM d GROUP BY gx, gy")
def _nan(v):
    rows = decoded(v).withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    return nan_reductions(rows, "gx", "gy").withColumns({"var": F.round("var", 4), "std": F.round("std", 4)})


@query("grow_window", "WITH k AS (SELECT unnest([-2, -1, 0, 1]) AS i) SELECT DISTINCT roi_id, tx + a.i AS tx, ty + b.i AS ty FROM g_tile, k a, k b WHERE n_flooded > 17000 AND tx + a.i BETWEEN 0 AND 63 AND ty + b.i BETWEEN 0 AND 63")
def _window(v):
    return grow_window(v("g_tile").where("n_flooded > 17000"), 2, 64, 64)


@query("grid_of", """WITH a AS (SELECT unnest(generate_series(0, 7)) AS tx), b AS (SELECT unnest(generate_series(0, 5)) AS ty), o AS (SELECT unnest([0, 1]) AS k)
    SELECT roi_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, x.k AS ox, y.k AS oy, roi_id + (tx + x.k * 0.5E0) * 0.25E0 + 0.0078125E0 AS xlo, (ty + y.k * 0.5E0) * 0.25E0 + 0.0078125E0 AS ylo,
      roi_id + (tx + x.k * 0.5E0) * 0.25E0 + 0.25E0 - 0.0078125E0 AS xhi, (ty + y.k * 0.5E0) * 0.25E0 + 0.25E0 - 0.0078125E0 AS yhi FROM g_roi, a, b, o x, o y""")  # fmt: skip
def _grid_of(v):
    return grid_of(v("g_roi").select("roi_id", F.col("roi_id").cast("double").alias("x0"), F.lit(0.0).alias("y0")), 8, 6, 0.25, 0.0078125)


@query("assemble_examples", f"""WITH d AS (SELECT gx, gy, day, band, avg(value) AS value FROM ({_D}) GROUP BY gx, gy, day, band), n AS (SELECT gx, gy, day, count(DISTINCT band) AS n_bands FROM d WHERE value IS NOT NULL GROUP BY gx, gy, day),
    s AS (SELECT CAST(clz_cl_smj AS INT) AS gx, continent AS gy, max(pop_ct_usu) AS pop FROM g_basin GROUP BY clz_cl_smj, continent), t AS (SELECT tile_id, CAST(roi_id % 24 AS INT) AS gx, CAST(tile_id % 12 AS INT) AS gy, DATE '1996-01-01' + CAST(tile_id % 365 AS INT) AS day FROM g_tile)
    SELECT tile_id, pop, coalesce(n_bands, 0) AS n_bands FROM t LEFT JOIN s ON t.gx = s.gx AND t.gy = s.gy LEFT JOIN n ON t.gx = n.gx AND t.gy = n.gy AND t.day = n.day""")  # fmt: skip
def _assemble(v):
    tiles = v("g_tile").select("tile_id", (F.col("roi_id") % 24).cast("int").alias("gx"), (F.col("tile_id") % 12).cast("int").alias("gy"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("tile_id") % 365).cast("int")).alias("day"))
    statics = v("g_basin").groupBy(F.col("clz_cl_smj").alias("gx"), F.col("continent").alias("gy")).agg(F.max("pop_ct_usu").alias("pop"))
    found = assemble_examples(tiles, statics, weather_series(decoded(v)))
    return found.select("tile_id", "pop", F.coalesce(F.when(F.col("weather").isNotNull(), F.size("weather")), F.lit(0)).cast("long").alias("n_bands"))


@query("sorted_series", "SELECT day, band, count(*) AS n FROM g_weather GROUP BY day, band")
def _sorted(v):
    daily = v("g_weather").groupBy("day", "band").agg(F.count(F.lit(1)).alias("n"))
    return sorted_series(daily.where("day >= DATE '1997-01-01'"), daily.where("day < DATE '1997-01-01'"))
