"""Columns and filters: codes, dates, bounds, transforms, band values, tile tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.functions.names import CLIMATE_ZONES, CONTINENTS, label_of, values_sql
from hydrospark.plans.registry import query

EARTH_RADIUS = 6378137.0
LEAD_BINS = 60


def continent_of(basin_id: Column) -> Column:
    """The first digit of a basin's id."""
    return F.substring(basin_id.cast("string"), 1, 1).cast("int")


def coastal_outlets(basins: DataFrame, min_flow: int = 100) -> DataFrame:
    """Basins with enough flow that drain into an ocean."""
    return basins.where((F.col("riv_tc_usu") > min_flow) & (F.col("next_down") == 0) & (F.col("endo") == 0))


def static_basin_filter(basins: DataFrame, min_flow: int, min_population: int) -> DataFrame:
    return coastal_outlets(basins, min_flow).where(F.col("pop_ct_usu") > min_population)


def impactful_floods(floods: DataFrame, min_dead: int, min_displaced: int) -> DataFrame:
    return floods.where((F.col("dead") > min_dead) | (F.col("displaced") > min_displaced))


def flood_impact(dead: Column, displaced: Column) -> Column:
    return dead * 20_000 + displaced


def is_labelled_name(name: Column) -> Column:
    return name.rlike(r"^\d{3}-\d{1,2}-")


def name_date(name: Column) -> Column:
    """The date that the last three '-' parts of a name spell."""
    return F.to_date(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})$", 1))


def lead_days(before: Column, target: Column, most: int | None = None) -> Column:
    """Whole days from the earlier scene to the target, at most ``most``."""
    days = F.datediff(target, before)
    return days if most is None else F.least(days, F.lit(most))


def valid_date_range(days: DataFrame, window: int) -> DataFrame:
    """The days that all sources cover, the first one late enough for a window before it."""
    each = days.groupBy("band").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return each.agg(F.date_add(F.max("first"), window - 1).alias("first_day"), F.min("last").alias("last_day"))


def in_date_range(rois: DataFrame, first: str, last: str, window: int) -> DataFrame:
    """ROIs whose whole window lies between two days."""
    return rois.where((F.date_sub("post_date", window - 1) >= F.lit(first).cast("date")) & (F.col("post_date") <= F.lit(last).cast("date")))


def weather_window_bounds(target: Column, window: int) -> tuple[Column, Column]:
    """First and last day of the window that ends at a time; a start within a day takes the day before too."""
    start = target - F.make_dt_interval(F.lit(window - 1))
    day = F.to_date(start)
    return F.when(start > day.cast("timestamp_ntz"), F.date_sub(day, 1)).otherwise(day), F.to_date(target)


def decode_band(raw: Column, nodata: Column, scale: float, offset: float) -> Column:
    """Nodata to null first, then scaled."""
    return F.when(~nodata, raw * scale + offset)


def encode_band(rows: DataFrame, steps: int = 1 << 14) -> DataFrame:
    """Values to whole steps of their band's range: offset = least value, scale = (most - least) / steps."""
    # a handful of bands: their range is a table of a few rows
    span = rows.groupBy("band").agg(F.min("value").alias("offset"), ((F.max("value") - F.min("value")) / steps).alias("scale"))
    joined = rows.join(F.broadcast(span), "band")
    return joined.withColumn("code", F.when(F.col("scale") > 0, F.round((F.col("value") - F.col("offset")) / F.col("scale"))).otherwise(0).cast("long"))


def tile_flooded(share: float = 0.05) -> Column:
    pixels = F.col("n_background") + F.col("n_permanent_water") + F.col("n_flooded")
    return F.try_divide(F.col("n_flooded").cast("double"), pixels) > share


def tile_valid(values: Column, near: float = 1e-5, most: float = 0.05) -> Column:
    """No NaN, and fewer than ``most`` of the values near zero: else the tile lies at the image's edge."""
    return ~F.exists(values, F.isnan) & (F.size(F.filter(values, lambda x: F.abs(x) < near)) < most * F.size(values))


def drop_empty_tiles(pixels: DataFrame, nodata: int = 255) -> DataFrame:
    """Tiles without a nodata pixel."""
    return pixels.groupBy("tile_id").agg(F.max("targ").alias("most"), F.count(F.lit(1)).alias("n")).where(F.col("most") < nodata).select("tile_id", "n")


def large_water_tile(tiles: DataFrame, water: float = 0.5, background: float = 0.1) -> DataFrame:
    """Tiles with more than ``water`` permanent water, or with less than ``background`` background."""
    pixels = (F.col("n_background") + F.col("n_permanent_water") + F.col("n_flooded")).cast("double")
    return tiles.where((F.col("n_permanent_water") / pixels > water) | (F.col("n_background") / pixels < background))


def rounded_bounds(box: DataFrame, outward: bool = True) -> DataFrame:
    low, high = (F.floor, F.ceil) if outward else (F.ceil, F.floor)
    return box.withColumns({k: f(k).cast("long") for k, f in (("xlo", low), ("ylo", low), ("xhi", high), ("yhi", high))})


def apply_affine(x: Column, y: Column, t: tuple[float, ...]) -> tuple[Column, Column]:
    """Pixel to map coordinates by (a, b, c, d, e, f)."""
    a, b, c, d, e, f = t
    return x * a + y * b + c, x * d + y * e + f


def invert_affine(t: tuple[float, ...]) -> tuple[float, ...]:
    a, b, c, d, e, f = t
    det = a * e - b * d
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def pixel_window(box: DataFrame, t: tuple[float, ...]) -> DataFrame:
    """Map bounds to a window of whole pixels; axes that run down are flipped."""
    back = invert_affine(t)
    (x1, y1), (x2, y2) = apply_affine(F.col("xlo"), F.col("ylo"), back), apply_affine(F.col("xhi"), F.col("yhi"), back)
    whole = lambda c: F.floor(c + 0.5).cast("long")
    return box.withColumns({"col_off": whole(F.least(x1, x2)), "row_off": whole(F.least(y1, y2)), "n_cols": whole(F.greatest(x1, x2)) - whole(F.least(x1, x2)), "n_rows": whole(F.greatest(y1, y2)) - whole(F.least(y1, y2))})


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * EARTH_RADIUS, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH_RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_RADIUS), F.degrees(F.atan(F.exp(y / EARTH_RADIUS)) * 2 - F.lit(1.5707963267948966))


def read_tile_window(pixels: DataFrame, tiles: DataFrame, first: int, last: int) -> DataFrame:
    """Pixels of the wanted tiles within a range of pixel numbers."""
    return pixels.where(F.col("px").between(first, last)).join(tiles, "tile_id", "left_semi")


def grid_checks(tiles: DataFrame) -> DataFrame:
    """For each ROI whether its tiles share one size, and how many have no counts."""
    width = F.round(F.col("xhi") - F.col("xlo"), 6)
    return tiles.groupBy("roi_id").agg((F.count_distinct(width) == 1).alias("one_size"), F.count_if(F.col("n_background").isNull()).alias("n_missing"))


def image_footprint(width: Column, height: Column, t: tuple[float, ...]) -> list[Column]:
    """Box of an image from its size and transform."""
    (x1, y1), (x2, y2) = apply_affine(F.lit(0.0), F.lit(0.0), t), apply_affine(width, height, t)
    return [F.least(x1, x2).alias("xlo"), F.least(y1, y2).alias("ylo"), F.greatest(x1, x2).alias("xhi"), F.greatest(y1, y2).alias("yhi")]


def context_box(box: DataFrame, degrees: float = 3.2) -> DataFrame:
    """A square of fixed size around a box's centre."""
    cx, cy, half = (F.col("xlo") + F.col("xhi")) / 2, (F.col("ylo") + F.col("yhi")) / 2, degrees / 2
    return box.withColumns({"xlo": cx - half, "ylo": cy - half, "xhi": cx + half, "yhi": cy + half})


def wrap_longitude(lon: Column, source_min: float) -> Column:
    """-180..180 to the range of a source that begins at ``source_min`` (0 for 0..360)."""
    return F.when(F.lit(source_min >= 0) & (lon < 0), lon + 360).otherwise(lon)


def normalise_bands(rows: DataFrame, norms: DataFrame) -> DataFrame:
    """(value - mean) / std with the parameters of the row's fold and band; the parameters are few rows."""
    return rows.join(F.broadcast(norms), ["fold", "band"]).withColumn("value", F.try_divide(F.col("value") - F.col("mean"), F.col("std")))


def impute_missing(rows: DataFrame, how: str, *by: str) -> DataFrame:
    """Missing values to zero, or to the mean of those that are there within ``by``."""
    if how == "zero":
        return rows.withColumn("value", F.coalesce("value", F.lit(0.0)))
    mean = rows.groupBy(*by).agg(F.avg("value").alias("mean"))
    return rows.join(mean, list(by)).withColumn("value", F.coalesce("value", "mean")).drop("mean")


def argmax_class(scores: Column) -> Column:
    """Place of the highest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == c).cast("int"))


def hour_offset_rows(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of a series between two times, with their hours since 1900-01-01."""
    origin = F.lit("1900-01-01").cast("timestamp_ntz")
    hours = lambda c: F.timestamp_diff("HOUR", origin, c)
    row = hours(F.col("start_time"))
    return rows.withColumn("hour", row).where(row.between(hours(F.lit(first).cast("timestamp_ntz")), hours(F.lit(last).cast("timestamp_ntz"))))


def scene_product_filter(scenes: DataFrame, polarization: str = "VV+VH") -> DataFrame:
    return scenes.where(F.col("polarization") == polarization).orderBy("start_time", "event_id")


def fill_with_band_min(rows: DataFrame) -> DataFrame:
    """Missing values to the band's least; few bands, so their range is broadcast."""
    span = rows.groupBy("band").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return rows.join(F.broadcast(span), "band").withColumn("value", F.coalesce("value", "least"))


def rescale_minmax(rows: DataFrame) -> DataFrame:
    """Values of each band to 0..1."""
    return fill_with_band_min(rows).withColumn("value", F.coalesce(F.try_divide(F.col("value") - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0)))


def uniform(*of: Column) -> Column:
    """A number above 0 and up to 1, the same each time for the same values, however rows are dealt."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 53)) + 1).cast("double") / float(1 << 53)


def normal(*of: Column) -> Column:
    """A draw of the normal distribution, from two uniform ones."""
    return F.sqrt(F.log(uniform(F.lit("length"), *of)) * -2.0) * F.cos(uniform(F.lit("turn"), *of) * (2 * math.pi))


def blurred(values: Column, side: int) -> Column:
    """Each cell of a tile (an array in rows of ``side``) as the mean of the up to nine cells around it."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (-1, 0, 1) for i in (-1, 0, 1)])

    def mean(at: Column, own: Column) -> Column:
        x, y = at % side, F.floor(at / side).cast("int")
        near = F.filter(F.transform(steps, lambda s: F.when((x + s["i"]).between(0, side - 1), F.try_element_at(own, F.when(y + s["j"] >= 0, at + s["i"] + s["j"] * side + 1)))), lambda v: v.isNotNull())
        return F.aggregate(near, F.lit(0.0), lambda a, b: a + b) / F.size(near)

    whole = F.transform(values, lambda v: v.cast("double"))
    return F.get(F.transform(F.array(whole), lambda own: F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda at: mean(at, own))), F.lit(0))


def mirrored(values: Column, side: int) -> Column:
    rows = F.transform(F.sequence(F.lit(0), (F.size(values) / side).cast("int") - 1), lambda i: F.slice(values, i * side + 1, F.lit(side)))
    return F.flatten(F.transform(rows, F.reverse))


def augment_tiles(tiles: DataFrame, values: str, side: int, seed: int = 0, noise: float = 0.01, label: str | None = None, flip: float = 0.5, blur: float = 0.0, key: str = "vec_id") -> DataFrame:
    """Tiles (one array in rows of ``side``) with normal noise scaled by the tile's largest value, then blurred or not, then flipped sideways or not.

    ``flip`` and ``blur`` are the shares of tiles; a tile's ``label``, an array of the same form, is flipped with it and otherwise left
    alone. All draws go by the tile's ``key`` and the seed, so a task that runs again makes the same tiles.
    """
    draw = lambda what: uniform(F.lit(what), F.col(key), F.lit(seed))
    turned, soft = draw("flip") <= flip, draw("blur") <= blur
    most = F.array_max(F.col(values)).cast("double")
    noisy = F.transform(F.col(values), lambda x, i: x.cast("double") + normal(F.col(key), i, F.lit(seed)) * noise * most)
    found = tiles.withColumns({"flipped": turned, "blurred": soft, "augmented": noisy})
    found = found.withColumn("augmented", F.when(F.col("blurred"), blurred(F.col("augmented"), side)).otherwise(F.col("augmented")))
    for c in ["augmented", *([label] if label else [])]:
        found = found.withColumn(c, F.when(F.col("flipped"), mirrored(F.col(c), side)).otherwise(F.col(c)))
    return found


def context_window(boxes: DataFrame, t: tuple[float, ...], pixels: int) -> DataFrame:
    """The window of a grid (affine transform ``t`` without turn) around each box, grown by ``pixels`` and outward to whole ones: pxlo, pylo,
    pxhi, pyhi in pixels, and the box that it is. The bounds of a hull that is grown are the grown bounds of the hull."""
    a, _, c, _, e, f = t
    x0, x1, y0, y1 = (F.col("xlo") - c) / a, (F.col("xhi") - c) / a, (F.col("ylo") - f) / e, (F.col("yhi") - f) / e
    low = lambda p, q: F.floor(F.round(F.least(p, q) - pixels, 9))
    high = lambda p, q: F.ceil(F.round(F.greatest(p, q) + pixels, 9))
    found = boxes.withColumns({"pxlo": low(x0, x1), "pylo": low(y0, y1), "pxhi": high(x0, x1), "pyhi": high(y0, y1)})
    ends = lambda p, scale, shift: (F.col(f"{p}lo") * scale + shift, F.col(f"{p}hi") * scale + shift)
    (xa, xb), (ya, yb) = ends("px", F.lit(a), F.lit(c)), ends("py", F.lit(e), F.lit(f))
    return found.withColumns({"xlo": F.least(xa, xb), "ylo": F.least(ya, yb), "xhi": F.greatest(xa, xb), "yhi": F.greatest(ya, yb)})


def flood_of_key(key: Column) -> Column:
    """The flood id that a site's key (flood-basin) begins with, null if it does not."""
    return F.regexp_extract(key, r"^(\d+)-\d+$", 1).try_cast("long")


def scene_stem(key: Column, day: Column) -> Column:
    """The name of a scene's files: key and day."""
    return F.concat_ws("-", key, F.date_format(day, "yyyy-MM-dd"))


# --- queries -------------------------------------------------------------------------------------------------


@query("continent_of", "SELECT hybas_id, continent AS c FROM g_basin")
def _continent(v):
    return v("g_basin").select("hybas_id", continent_of(F.col("hybas_id")).alias("c"))


@query("label_dims", f"SELECT b.hybas_id, c.name AS continent_name, z.name AS zone_name FROM g_basin b JOIN (VALUES {values_sql(CONTINENTS)}) c(k, name) ON b.continent = c.k JOIN (VALUES {values_sql(CLIMATE_ZONES)}) z(k, name) ON b.clz_cl_smj = z.k")
def _labels(v):
    return v("g_basin").select("hybas_id", label_of(F.col("continent"), CONTINENTS).alias("continent_name"), label_of(F.col("clz_cl_smj"), CLIMATE_ZONES).alias("zone_name"))


@query("coastal_outlets", "SELECT hybas_id, riv_tc_usu FROM g_basin WHERE riv_tc_usu > 100 AND next_down = 0 AND endo = 0")
def _outlets(v):
    return coastal_outlets(v("g_basin")).select("hybas_id", "riv_tc_usu")


@query("static_basin_filter", "SELECT hybas_id FROM g_basin WHERE riv_tc_usu > 100 AND pop_ct_usu > 1000 AND next_down = 0 AND endo = 0")
def _static(v):
    return static_basin_filter(v("g_basin"), 100, 1000).select("hybas_id")


@query("impactful_floods", "SELECT id, dead, displaced FROM g_flood WHERE dead > 40 OR displaced > 35000")
def _impactful(v):
    return impactful_floods(v("g_flood"), 40, 35000).select("id", "dead", "displaced")


@query("flood_impact", "SELECT id, dead * 20000 + displaced AS impact FROM g_flood")
def _impact(v):
    return v("g_flood").select("id", flood_impact(F.col("dead"), F.col("displaced")).alias("impact"))


_NAMES = "SELECT roi_id, post_date, CASE WHEN type = 'kurosiwo' THEN lpad(CAST(roi_id AS VARCHAR), 3, '0') || '-' || fold || '-' ELSE 'gen-' || roi_id || '-' END || strftime(post_date, '%Y-%m-%d') AS name FROM g_roi"


def _named(v):
    head = F.when(F.col("type") == "kurosiwo", F.concat(F.lpad(F.col("roi_id").cast("string"), 3, "0"), F.lit("-"), F.col("fold"), F.lit("-"))).otherwise(F.concat(F.lit("gen-"), F.col("roi_id"), F.lit("-")))
    return v("g_roi").withColumn("name", F.concat(head, F.date_format("post_date", "yyyy-MM-dd")))


@query("is_labelled_name", f"SELECT roi_id, name, regexp_matches(name, '^[0-9]{{3}}-[0-9]{{1,2}}-') AS labelled FROM ({_NAMES})")
def _labelled(v):
    return _named(v).select("roi_id", "name", is_labelled_name(F.col("name")).alias("labelled"))


@query("parse_name_date", f"SELECT roi_id, post_date AS day FROM ({_NAMES})")
def _name_date(v):
    return _named(v).select("roi_id", name_date(F.col("name")).alias("day"))


@query("lead_days", "SELECT roi_id, CAST(post_date - pre1_date AS INT) AS days, CAST(least(post_date - pre1_date, 59) AS INT) AS capped FROM g_roi")
def _lead(v):
    return v("g_roi").select("roi_id", lead_days(F.col("pre1_date"), F.col("post_date")).alias("days"), lead_days(F.col("pre1_date"), F.col("post_date"), LEAD_BINS - 1).alias("capped"))


@query("valid_date_range", "SELECT CAST(max(a) + 19 AS DATE) AS first_day, min(b) AS last_day FROM (SELECT band, min(day) AS a, max(day) AS b FROM g_weather GROUP BY band)")
def _valid(v):
    return valid_date_range(v("g_weather"), 20)


@query("in_date_range", "SELECT roi_id FROM g_roi WHERE post_date - 19 >= DATE '2000-02-01' AND post_date <= DATE '2000-09-30'")
def _in_range(v):
    return in_date_range(v("g_roi"), "2000-02-01", "2000-09-30", 20).select("roi_id")


@query("weather_window_bounds", "SELECT event_id, CAST(start_time - INTERVAL 19 DAY AS DATE) - CASE WHEN start_time - INTERVAL 19 DAY > CAST(CAST(start_time - INTERVAL 19 DAY AS DATE) AS TIMESTAMP) THEN 1 ELSE 0 END AS first_day, CAST(start_time AS DATE) AS last_day FROM g_scene")
def _bounds(v):
    first, last = weather_window_bounds(F.col("start_time"), 20)
    return v("g_scene").select("event_id", first.alias("first_day"), last.alias("last_day"))


_DECODED = "SELECT day, gx, gy, band, CASE WHEN NOT is_nodata THEN raw_i16 * 0.5E0 + 10 END AS value FROM g_weather"


def decoded(v) -> DataFrame:
    return v("g_weather").select("day", "gx", "gy", "band", decode_band(F.col("raw_i16"), F.col("is_nodata"), 0.5, 10.0).alias("value"))


@query("decode_band", f"SELECT * FROM ({_DECODED})")
def _decode(v):
    return decoded(v)


@query("encode_band", f"WITH d AS ({_DECODED}), s AS (SELECT band, min(value) AS o, (max(value) - min(value)) / 16384 AS s FROM d GROUP BY band) SELECT d.band, CASE WHEN s > 0 THEN CAST(round((value - o) / s) AS BIGINT) ELSE 0 END AS code, count(*) AS n FROM d JOIN s ON d.band = s.band WHERE value IS NOT NULL GROUP BY d.band, CASE WHEN s > 0 THEN CAST(round((value - o) / s) AS BIGINT) ELSE 0 END")
def _encode(v):
    return encode_band(decoded(v).where("value IS NOT NULL")).groupBy("band", "code").agg(F.count(F.lit(1)).alias("n"))


@query("tile_flooded", "SELECT roi_id, tile_id, n_flooded / CAST(n_background + n_permanent_water + n_flooded AS DOUBLE) > 0.05 AS flooded FROM g_tile")
def _flooded(v):
    return v("g_tile").select("roi_id", "tile_id", tile_flooded().alias("flooded"))


@query("tile_valid", "SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE)) < 0.01)) < 0.1 * len(embedding) AS valid FROM embeddings")
def _tile_valid(v):
    return v.table("embeddings").select("vec_id", tile_valid(F.transform("embedding", lambda x: x.cast("double")), 0.01, 0.1).alias("valid"))


@query("drop_empty_tiles", "SELECT tile_id, count(*) AS n FROM g_pixel GROUP BY tile_id HAVING max(targ) < 255")
def _empty(v):
    return drop_empty_tiles(v("g_pixel"))


@query("large_water_tile", "SELECT tile_id FROM g_tile WHERE n_permanent_water / 50176.0 > 0.3 OR n_background / 50176.0 < 0.35")
def _water(v):
    return large_water_tile(v("g_tile"), 0.3, 0.35).select("tile_id")


@query("rounded_bounds", "SELECT tile_id, CAST(floor(xlo) AS BIGINT) AS xlo, CAST(floor(ylo) AS BIGINT) AS ylo, CAST(ceil(xhi) AS BIGINT) AS xhi, CAST(ceil(yhi) AS BIGINT) AS yhi FROM g_tile")
def _rounded(v):
    return rounded_bounds(v("g_tile")).select("tile_id", "xlo", "ylo", "xhi", "yhi")


_GEO = (0.1, 0.0, -180.0, 0.0, -0.1, 90.0)


@query("pixel_window", "SELECT hybas_id, CAST(floor((xlo + 180) * 10 + 0.5) AS BIGINT) AS col_off, CAST(floor((90 - yhi) * 10 + 0.5) AS BIGINT) AS row_off, CAST(30 AS BIGINT) AS n_cols, CAST(30 AS BIGINT) AS n_rows FROM g_basin")
def _window(v):
    return pixel_window(v("g_basin"), _GEO).select("hybas_id", "col_off", "row_off", "n_cols", "n_rows")


@query("apply_affine", "SELECT tile_id, round(tx * 0.25E0 - 180, 6) AS x, round(ty * -0.25E0 + 90, 6) AS y, CAST(tx AS DOUBLE) AS tx_back, CAST(ty AS DOUBLE) AS ty_back FROM g_tile")
def _affine(v):
    t = (0.25, 0.0, -180.0, 0.0, -0.25, 90.0)
    x, y = apply_affine(F.col("tx"), F.col("ty"), t)
    rows = v("g_tile").select("tile_id", x.alias("x"), y.alias("y"))
    bx, by = apply_affine(F.col("x"), F.col("y"), invert_affine(t))
    return rows.select("tile_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(bx, 6).alias("tx_back"), F.round(by, 6).alias("ty_back"))


@query("reproject", "SELECT gauge_id, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(0.7853981633974483 + radians(lat) / 2)) * 6378137.0, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM g_gauge")
def _reproject(v):
    x, y = to_mercator(F.col("lon"), F.col("lat"))
    rows = v("g_gauge").select("gauge_id", x.alias("x"), y.alias("y"))
    lon, lat = from_mercator(F.col("x"), F.col("y"))
    return rows.select("gauge_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("read_tile_window", "SELECT tile_id, px, targ FROM g_pixel WHERE px BETWEEN 2 AND 5 AND tile_id IN (SELECT tile_id FROM g_tile WHERE n_flooded > 10000)")
def _tile_window(v):
    return read_tile_window(v("g_pixel"), v("g_tile").where("n_flooded > 10000").select("tile_id"), 2, 5).select("tile_id", "px", "targ")


@query("grid_checks", "SELECT roi_id, count(DISTINCT round(xhi - xlo, 6)) = 1 AS one_size, CAST(count_if(n_background IS NULL) AS BIGINT) AS n_missing FROM g_tile GROUP BY roi_id")
def _checks(v):
    return grid_checks(v("g_tile"))


@query("image_footprint", "SELECT hybas_id, CAST(-180 AS DOUBLE) AS xlo, 90 - 0.1E0 * (100 + hybas_id % 50) AS ylo, -180 + 0.1E0 * (200 + hybas_id % 30) AS xhi, CAST(90 AS DOUBLE) AS yhi FROM g_basin")
def _footprint(v):
    return v("g_basin").select("hybas_id", *image_footprint(F.lit(200) + F.col("hybas_id") % 30, F.lit(100) + F.col("hybas_id") % 50, _GEO))


@query("context_box", "SELECT tile_id, round((xlo + xhi) / 2 - 1.6, 6) AS xlo, round((ylo + yhi) / 2 - 1.6, 6) AS ylo, round((xlo + xhi) / 2 + 1.6, 6) AS xhi, round((ylo + yhi) / 2 + 1.6, 6) AS yhi FROM g_tile")
def _context(v):
    return context_box(v("g_tile")).select("tile_id", *[F.round(c, 6).alias(c) for c in ("xlo", "ylo", "xhi", "yhi")])


@query("wrap_longitude", "SELECT gauge_id, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon360, lon FROM g_gauge")
def _wrap(v):
    return v("g_gauge").select("gauge_id", wrap_longitude(F.col("lon"), 0.0).alias("lon360"), wrap_longitude(F.col("lon"), -180.0).alias("lon"))


@query("normalise_bands", f"WITH d AS (SELECT *, CAST(gx % 5 AS INT) AS fold FROM ({_DECODED})), n AS (SELECT fold, band, avg(value) AS mean, stddev_pop(value) AS std FROM d GROUP BY fold, band) SELECT d.day, d.gx, d.gy, d.band, round((value - mean) / std, 6) AS value FROM d JOIN n ON d.fold = n.fold AND d.band = n.band")
def _normalise(v):
    rows = decoded(v).withColumn("fold", F.col("gx") % 5)
    norms = rows.groupBy("fold", "band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return normalise_bands(rows, norms).select("day", "gx", "gy", "band", F.round("value", 6).alias("value"))


@query("impute_missing", f"WITH d AS ({_DECODED}), m AS (SELECT gx, gy, band, avg(value) AS mean FROM d GROUP BY gx, gy, band) SELECT d.day, d.gx, d.gy, d.band, round(coalesce(value, mean), 6) AS value, coalesce(value, 0) AS zeroed FROM d JOIN m ON d.gx = m.gx AND d.gy = m.gy AND d.band = m.band")
def _impute(v):
    rows = decoded(v).withColumn("zeroed", F.coalesce("value", F.lit(0.0)))
    return impute_missing(rows, "mean", "gx", "gy", "band").select("day", "gx", "gy", "band", F.round("value", 6).alias("value"), "zeroed")


@query("land_sea_mask", f"SELECT gx, gy, count(value) > 0 AS land FROM ({_DECODED}) WHERE band = 'surface_pressure' GROUP BY gx, gy")
def _land(v):
    return decoded(v).where("band = 'surface_pressure'").groupBy("gx", "gy").agg((F.count("value") > 0).alias("land"))


@query("argmax_class", """WITH a AS (SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class, CAST(len(embedding) AS INT) AS n FROM embeddings)
    SELECT vec_id, class, repeat('0,', class) || '1' || repeat(',0', n - 1 - class) AS hot FROM a""")  # fmt: skip
def _argmax(v):
    c, e = argmax_class(F.col("embedding")), F.col("embedding")
    return v.table("embeddings").select("vec_id", c.alias("class"), F.array_join(F.transform(e, lambda x, i: (i == c).cast("int")), ",").alias("hot"))


@query("hour_offset_rows", "SELECT event_id, date_diff('hour', TIMESTAMP '1900-01-01', date_trunc('hour', start_time)) AS hour FROM g_scene WHERE date_diff('hour', TIMESTAMP '1900-01-01', date_trunc('hour', start_time)) BETWEEN date_diff('hour', TIMESTAMP '1900-01-01', TIMESTAMP '2024-01-05') AND date_diff('hour', TIMESTAMP '1900-01-01', TIMESTAMP '2024-01-12')")
def _hours(v):
    return hour_offset_rows(v("g_scene"), "2024-01-05", "2024-01-12").select("event_id", "hour")


@query("scene_product_filter", "SELECT event_id, start_time FROM g_scene WHERE polarization = 'VV+VH'")
def _products(v):
    return scene_product_filter(v("g_scene")).select("event_id", "start_time")


_SPAN = "s AS (SELECT band, min(value) AS lo, max(value) AS hi FROM d GROUP BY band)"


@query("fill_with_band_min", f"WITH d AS ({_DECODED}), {_SPAN} SELECT d.band, coalesce(value, lo) AS value, count(*) AS n FROM d JOIN s ON d.band = s.band GROUP BY d.band, coalesce(value, lo)")
def _fill(v):
    return fill_with_band_min(decoded(v)).groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))


@query("rescale_minmax", f"WITH d AS ({_DECODED}), {_SPAN} SELECT d.band, round((coalesce(value, lo) - lo) / (hi - lo), 6) AS value, count(*) AS n FROM d JOIN s ON d.band = s.band GROUP BY d.band, round((coalesce(value, lo) - lo) / (hi - lo), 6)")
def _rescale(v):
    return rescale_minmax(decoded(v)).groupBy("band", F.round("value", 6).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("augment_tiles")
def _augment(v):
    e = v.table("embeddings").withColumn("label", F.transform("embedding", lambda x: (x > 0).cast("int")))
    return augment_tiles(e, "embedding", 8, label="label", blur=0.3).select("vec_id", "flipped", "blurred", "augmented", "label")


@query("context_window", """WITH b AS (SELECT roi_id, min(xlo) AS xlo, min(ylo) AS ylo, max(xhi) AS xhi, max(yhi) AS yhi FROM g_tile GROUP BY roi_id),
    p AS (SELECT roi_id, CAST(floor(round((xlo + 180) / 0.1E0 - 5, 9)) AS BIGINT) AS pxlo, CAST(floor(round((90 - yhi) / 0.1E0 - 5, 9)) AS BIGINT) AS pylo, CAST(ceil(round((xhi + 180) / 0.1E0 + 5, 9)) AS BIGINT) AS pxhi, CAST(ceil(round((90 - ylo) / 0.1E0 + 5, 9)) AS BIGINT) AS pyhi FROM b)
    SELECT *, round(pxlo * 0.1E0 - 180, 6) AS xlo, round(90 - pyhi * 0.1E0, 6) AS ylo, round(pxhi * 0.1E0 - 180, 6) AS xhi, round(90 - pylo * 0.1E0, 6) AS yhi FROM p""")  # fmt: skip
def _window_around(v):
    boxes = v("g_tile").groupBy("roi_id").agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"))
    return context_window(boxes, (0.1, 0.0, -180.0, 0.0, -0.1, 90.0), 5).withColumns({c: F.round(c, 6) for c in ("xlo", "ylo", "xhi", "yhi")})


@query("scene_stem", "SELECT id, began AS day, concat(CAST(id AS VARCHAR), '-', CAST(1080000000 + id % 7 AS VARCHAR), '-', strftime(began, '%Y-%m-%d')) AS stem, id AS flood_id FROM g_flood")
def _stem(v):
    key = F.concat_ws("-", F.col("id").cast("string"), (F.lit(1080000000) + F.col("id") % 7).cast("string"))
    rows = v("g_flood").select("id", F.col("began").alias("day"), key.alias("key"))
    return rows.select("id", "day", scene_stem(F.col("key"), F.col("day")).alias("stem"), flood_of_key(F.col("key")).alias("flood_id"))
