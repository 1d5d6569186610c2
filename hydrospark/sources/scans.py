"""Reading and writing the tables of the data model, and the manifests of what there is and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hydrospark.plans.registry import query
from hydrospark.plans.scratch import new_path

ROI_META = T.StructType([
    T.StructField("roi_id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("HYBAS_ID", T.LongType()), T.StructField("HYBAS_ID_4", T.LongType()),
    T.StructField("pre1_date", T.StringType()), T.StructField("post_date", T.StringType()), T.StructField("visit_tiles", T.StringType()),
])
SCENES = "array<struct<event_id:bigint,start_time:string,flight_direction:string>>"
# Groups of causes and their names, and the groups whose floods are of use.
CAUSES = {"Heavy Rain": "Heavy rain;Torrential rain;Monsoonal rain", "Cyclone/storm": "Tropical cyclone;Tropical storm", "Tides/Surge": "Storm surge;Tidal surge", "Dam": "Dam break;Dam release", "Snow": "Snowmelt;Rain and snowmelt"}
WANTED_CAUSES = ("Cyclone/storm", "Heavy Rain", "Heavy Rain AND Cyclone/storm", "Heavy Rain AND Tides/Surge", "Tides/Surge")


def scan_basins(basins: DataFrame, columns: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """Basins that meet a box; the comparisons of bounds and the columns reach the Parquet reader."""
    xlo, ylo, xhi, yhi = box
    return basins.where((F.col("xhi") >= xlo) & (F.col("xlo") <= xhi) & (F.col("yhi") >= ylo) & (F.col("ylo") <= yhi)).select(*columns)


def scan_rivers(rivers: DataFrame, min_flow: int | None = None, min_upland: int | None = None) -> DataFrame:
    if min_flow is not None:
        rivers = rivers.where(F.col("riv_tc_usu") >= min_flow)
    return rivers if min_upland is None else rivers.where(F.col("upland_skm") >= min_upland)


def scan_floods(floods: DataFrame, causes: dict[str, str] = CAUSES, since: str | None = None) -> DataFrame:
    """Floods whose cause is one of the names of a wanted group; names of a group are split at ';'."""
    spark = floods.sparkSession
    table = spark.createDataFrame(list(causes.items()), "grp string, all_names string")
    names = table.where(F.col("grp").isin(*WANTED_CAUSES)).select(F.explode(F.split("all_names", ";")).alias("maincause"))
    kept = floods.join(F.broadcast(names), "maincause", "left_semi")
    return kept if since is None else kept.where(F.col("began") >= F.lit(since).cast("date"))


def parse_cyclones(rows: DataFrame) -> DataFrame:
    """Text columns (year, basin, name, first, last) with times as YYYYMMDDHH to keyed storms; a basin 'NA' is a name, not a null."""
    stamp = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyyMMddHH"))
    return rows.select(F.concat_ws("_", "year", "basin", "name").alias("storm_key"), stamp("first").cast("date").alias("first_track"), stamp("last").cast("date").alias("last_track"))


def read_cyclones(spark: SparkSession, path: str) -> DataFrame:
    """Storms from CSV files with a header; only an empty field is null."""
    return parse_cyclones(spark.read.csv(path, header=True, schema="year string, basin string, name string, first string, last string", nullValue=""))


def scan_roi_meta(lines: DataFrame, types: list[str]) -> DataFrame:
    """JSON records to rows with one basin key, whichever field has it; records of other types are left out."""
    rows = lines.select(F.from_json("json", ROI_META).alias("m")).select("m.*")
    return rows.where(F.col("type").isin(*types)).withColumn("basin", F.coalesce("HYBAS_ID_4", "HYBAS_ID"))


def read_roi_meta(spark: SparkSession, glob: str, types: list[str]) -> DataFrame:
    return scan_roi_meta(spark.read.text(glob, wholetext=True).withColumnRenamed("value", "json"), types)


def standardise_meta(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old records (roi_id, type, flooding, tiles array) to records with a key and without dead fields, and the tiles as their own table."""
    key = F.when(F.col("type") == "kurosiwo", F.concat(F.lit("ks-"), F.col("roi_id"))).otherwise(F.concat(F.lit("gen-"), F.col("roi_id")))
    metas = old.withColumn("key", key).withColumn("visit_tiles", F.concat("key", F.lit("-visit.parquet"))).drop("tiles", "flooding")
    return metas, old.select("roi_id", F.posexplode("tiles").alias("pos", "tile_id"))


def scan_scene_cache(cache: DataFrame) -> DataFrame:
    """(key, json array) to one row for each scene; the key is 'event-basin'."""
    return cache.select("key", F.explode(F.from_json("json", SCENES)).alias("s")).select(F.split("key", "-")[0].alias("event"), F.split("key", "-")[1].alias("basin"), "s.*")


def upsert_scene_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache with the results whose keys it lacks; cached ones are never replaced."""
    return cache.unionByName(found.join(cache, "key", "left_anti"))


def unpack_band_names(bands: DataFrame) -> DataFrame:
    """Labels 'YYYY-MM-DD-name' to (day, name)."""
    label = F.col("label")
    return bands.select(F.to_date(F.regexp_extract(label, r"^(\d{4}-\d{2}-\d{2})-", 1)).alias("day"), F.regexp_extract(label, r"^\d{4}-\d{2}-\d{2}-(.+)$", 1).alias("name"), "*").drop("label")


def scan_label_tiles(spark: SparkSession, folder: str, name: str = "info.json") -> DataFrame:
    """All files of a name (or pattern) under a folder, however deep; each is one JSON object."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(folder)


def labelled_folders(files: DataFrame, mark: str = "MK0_MLU_") -> DataFrame:
    """Files whose folder also holds a label file."""
    rows = files.withColumns({"folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "name": F.regexp_extract("path", r"([^/]*)$", 1)})
    return rows.join(rows.where(F.col("name").startswith(mark)).select("folder").distinct(), "folder", "left_semi")


def manifest_filter(rows: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key is in ``include``, or not in ``exclude``; exactly one is given."""
    if (include is None) == (exclude is None):
        raise ValueError("give either include or exclude")
    return rows.join(include, key, "left_semi") if include is not None else rows.join(exclude, key, "left_anti")


def pending_work(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is wanted and has no output yet."""
    return wanted.join(done, key, "left_anti")


def fold_role(fold: Column, test: int, n_folds: int = 5) -> Column:
    """Fold ``test`` tests, the next one validates, the others train."""
    return F.when(fold == test, "test").when(fold == (test + 1) % n_folds, "val").otherwise("train")


def read_folds(spark: SparkSession, glob: str) -> DataFrame:
    """Lists of names, one file for each fold, to (name, fold)."""
    rows = spark.read.text(glob).select(F.col("value").alias("name"), F.col("_metadata.file_name").alias("file"))
    return rows.where(F.trim("name") != "").select("name", F.regexp_extract("file", r"_(\d+)\.txt$", 1).cast("int").alias("fold"))


def scan_norms(norms: DataFrame, order: list[str]) -> DataFrame:
    """Parameters of the wanted bands, with their place in the wanted order."""
    return norms.where(F.col("band").isin(*order)).withColumn("pos", F.array_position(F.array(*[F.lit(b) for b in order]), F.col("band")).cast("int") - 1)


def write_norms(norms: DataFrame, path: str) -> None:
    """One folder of CSV for each fold."""
    norms.write.partitionBy("fold").option("header", True).csv(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Parquet by ROI; the rows of a ROI are written together."""
    tiles.repartition("roi_id").write.partitionBy("roi_id").parquet(path)


def scan_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_partitions(rows: DataFrame, path: str) -> None:
    rows.repartition("partition").write.partitionBy("partition").parquet(path)


def write_results(result: DataFrame, path: str, form: str = "json") -> None:
    result.write.format(form).save(path)


def tile_key_manifest(areas: DataFrame, n: int) -> DataFrame:
    """The n by n degree tiles that cover each area: (north, east) of their lower left corner; each tile once."""
    start = lambda c: (F.floor(F.col(c) / n) * n).cast("int")
    last = lambda c: (F.ceil(F.col(c) / n) * n - n).cast("int")
    reach = lambda lo, hi: F.sequence(start(lo), F.greatest(start(lo), last(hi)), F.lit(n))
    return areas.select(F.explode(reach("ylo", "yhi")).alias("north"), "xlo", "xhi").select("north", F.explode(reach("xlo", "xhi")).alias("east")).distinct()


def corner(north: Column, east: Column) -> tuple[Column, Column]:
    """'N05' and 'E010' of a corner in degrees."""
    return F.concat(F.when(north < 0, "S").otherwise("N"), F.lpad(F.abs(north).cast("string"), 2, "0")), F.concat(F.when(east < 0, "W").otherwise("E"), F.lpad(F.abs(east).cast("string"), 3, "0"))


def product_tile_names(tiles: DataFrame, year: int = 2021) -> DataFrame:
    """File names of each product's tile at (north, east): elevation, height above drainage, land cover (3 degrees), old elevation (5), surface water (10)."""
    north, east = F.col("north"), F.col("east")
    n, e = corner(north, east)
    n3, e3 = corner((F.floor(north / 3) * 3).cast("int"), (F.floor(east / 3) * 3).cast("int"))
    north10, east10 = F.floor(north / 10) * 10, F.floor(east / 10) * 10
    pad = lambda c, k: F.lpad(c.cast("int").cast("string"), k, "0")
    return tiles.select(
        "north", "east", F.concat(F.lit("Copernicus_DSM_10_"), n, F.lit("_00_"), e, F.lit("_00")).alias("dem"), F.concat(F.lit("Copernicus_DSM_COG_10_"), n, F.lit("_00_"), e, F.lit("_00_HAND.tif")).alias("hand"),
        F.concat(F.lit(f"ESA_WorldCover_10m_{year}_v200_"), n3, e3, F.lit("_Map.tif")).alias("cover"),
        F.concat(F.lit("srtm_"), pad(F.floor((east + 180) / 5) + 1, 2), F.lit("_"), pad(F.floor((60 - north) / 5) + 1, 2)).alias("srtm"),
        F.concat(F.lit(f"yearlyClassification{year}-000"), pad((70 - north10) * 4 / 10, 3), F.lit("0000-000"), pad((east10 + 180) * 4 / 10, 3), F.lit("0000.tif")).alias("water"),
    )


def product_mosaic(pixels: DataFrame, box: tuple[float, float, float, float], seam: int | None = None) -> DataFrame:
    """Pixels (gx, gy) of all tiles of a product within a box; of tiles that share a seam, its row and column ``seam`` are left out."""
    xlo, ylo, xhi, yhi = box
    kept = pixels.where(F.col("gx").between(xlo, xhi) & F.col("gy").between(ylo, yhi))
    return kept if seam is None else kept.where((F.col("gx") % seam != 0) & (F.col("gy") % seam != 0))


def backfill_manifest(rois: DataFrame, days: int = 20) -> DataFrame:
    """One request for the ROI's date and each of the days before it."""
    return rois.select("roi_id", F.explode(F.sequence(F.date_sub("post_date", days - 1), F.col("post_date"))).alias("day"))


@query("scan_basins", "SELECT hybas_id, continent, xlo, ylo FROM g_basin WHERE xhi >= -30 AND xlo <= 60 AND yhi >= -20 AND ylo <= 50")
def _basins(v):
    return scan_basins(v("g_basin"), ["hybas_id", "continent", "xlo", "ylo"], (-30, -20, 60, 50))


@query("scan_rivers", "SELECT * FROM g_river WHERE riv_tc_usu >= 500 AND upland_skm >= 1000")
def _rivers(v):
    return scan_rivers(v("g_river"), 500, 1000)


@query("scan_floods", "SELECT * FROM g_flood WHERE maincause IN ('Heavy rain', 'Torrential rain', 'Monsoonal rain', 'Tropical cyclone', 'Tropical storm', 'Storm surge', 'Tidal surge') AND began >= DATE '1996-01-01'")
def _floods(v):
    return scan_floods(v("g_flood"), since="1996-01-01")


@query("scan_cyclones", "SELECT storm_key, first_track, last_track FROM g_cyclone")
def _cyclones(v):
    part = F.split("storm_key", "_", 3)
    text = v("g_cyclone").select(part[0].alias("year"), part[1].alias("basin"), part[2].alias("name"), F.date_format("first_track", "yyyyMMdd00").alias("first"), F.date_format("last_track", "yyyyMMdd00").alias("last"))
    return parse_cyclones(text)


def _old_records(v):
    return v("g_roi").select(F.to_json(F.struct("roi_id", "type", F.when(F.col("type") == "kurosiwo", F.col("roi_id") + 1000).alias("HYBAS_ID_4"), F.when(F.col("type") != "kurosiwo", F.col("roi_id") + 2000).alias("HYBAS_ID"), "pre1_date", "post_date")).alias("json"))


@query("scan_roi_meta", "SELECT roi_id, roi_id + 2000 AS basin, CAST(post_date AS DATE) AS post_date FROM g_roi WHERE type = 'generated'")
def _roi_meta(v):
    return scan_roi_meta(_old_records(v), ["generated"]).select("roi_id", "basin", F.to_date("post_date").alias("post_date"))


@query("standardise_meta", """SELECT r.roi_id, CASE WHEN r.type = 'kurosiwo' THEN 'ks-' ELSE 'gen-' END || r.roi_id AS key, CASE WHEN r.type = 'kurosiwo' THEN 'ks-' ELSE 'gen-' END || r.roi_id || '-visit.parquet' AS visit_tiles,
    count(t.tile_id) AS n_tiles, CAST(sum(t.tile_id) AS BIGINT) AS tile_sum FROM g_roi r JOIN g_tile t ON r.roi_id = t.roi_id GROUP BY r.roi_id, r.type""")  # fmt: skip
def _standardise(v):
    tiles = v("g_tile").groupBy("roi_id").agg(F.collect_list("tile_id").alias("tiles"))
    metas, rings = standardise_meta(v("g_roi").join(tiles, "roi_id"))
    return metas.select("roi_id", "key", "visit_tiles").join(rings.groupBy("roi_id").agg(F.count("tile_id").alias("n_tiles"), F.sum("tile_id").alias("tile_sum")), "roi_id")


@query("scan_tiles", "SELECT roi_id, tile_id, n_flooded FROM g_tile")
def _tiles(v):
    path = new_path(v.spark, "tiles")
    write_tiles(v("g_tile"), path)
    return scan_tiles(v.spark, path).select(F.col("roi_id").cast("long").alias("roi_id"), "tile_id", "n_flooded")


def _cache(v, kept):
    scenes = v("g_scene").where(kept).groupBy(F.concat_ws("-", F.lit("7"), F.col("basin_key").cast("string")).alias("key"))
    return scenes.agg(F.to_json(F.collect_list(F.struct("event_id", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"), "flight_direction"))).alias("json"))


@query("scan_scene_cache", "SELECT '7' AS event, CAST(basin_key AS VARCHAR) AS basin, event_id, strftime(start_time, '%Y-%m-%dT%H:%M:%S') AS start_time, flight_direction FROM g_scene")
def _scene_cache(v):
    return scan_scene_cache(_cache(v, F.lit(True)))


@query("upsert_scene_cache", "SELECT CAST(basin_key AS VARCHAR) AS basin, event_id FROM g_scene WHERE basin_key >= 10 OR event_id % 2 = 0")
def _upsert(v):
    cached = _cache(v, (F.col("basin_key") < 10) & (F.col("event_id") % 2 == 0))
    return scan_scene_cache(upsert_scene_cache(cached, _cache(v, F.lit(True)))).select("basin", "event_id")


@query("unpack_band_names", "SELECT day, band AS name, count(*) AS n, CAST(sum(raw_i16) AS BIGINT) AS total FROM g_weather GROUP BY day, band")
def _unpack(v):
    rows = v("g_weather").select(F.concat_ws("-", F.date_format("day", "yyyy-MM-dd"), F.col("band")).alias("label"), "raw_i16")
    return unpack_band_names(rows).groupBy("day", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_i16").alias("total"))


@query("scan_gauges", "SELECT gauge_id, lon, lat FROM g_gauge")
def _gauges(v):
    path = new_path(v.spark, "gauges")
    v("g_gauge").write.option("header", True).csv(path)
    return v.spark.read.csv(path, header=True, schema="gauge_id long, lon double, lat double")


@query("scan_label_tiles", "SELECT concat('act/', roi_id) AS folder, CAST(post_date AS VARCHAR) AS flood_date FROM g_roi")
def _label_tiles(v):
    path = new_path(v.spark, "labels")
    v("g_roi").select("roi_id", F.concat_ws("/", F.lit("act"), F.col("roi_id").cast("string")).alias("folder"), F.date_format("post_date", "yyyy-MM-dd").alias("flood_date")).write.partitionBy("roi_id").json(path)
    return scan_label_tiles(v.spark, path, "*.json").select("folder", "flood_date")


@query("labelled_folders", "WITH f AS (SELECT DISTINCT roi_id, tile_id, px, targ FROM g_pixel), l AS (SELECT DISTINCT roi_id, tile_id FROM f WHERE targ = 2) SELECT f.roi_id, f.tile_id, count(*) AS n FROM f JOIN l ON f.roi_id = l.roi_id AND f.tile_id = l.tile_id GROUP BY f.roi_id, f.tile_id")
def _labelled(v):
    name = F.concat(F.when(F.col("targ") == 2, "MK0_MLU_").otherwise("S1_"), F.col("px"), F.lit("_"), F.col("targ"))
    files = v("g_pixel").select("roi_id", "tile_id", "px", "targ").distinct().withColumn("path", F.concat_ws("/", F.col("roi_id").cast("string"), F.col("tile_id").cast("string"), name))
    return labelled_folders(files).groupBy("roi_id", "tile_id").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_filter", "SELECT roi_id, 'kept' AS side FROM g_roi WHERE fold = 1 UNION ALL SELECT roi_id, 'rest' FROM g_roi WHERE fold <> 1")
def _manifest(v):
    listed = v("g_roi").where("fold = 1").select("roi_id")
    kept, rest = manifest_filter(v("g_roi"), "roi_id", include=listed), manifest_filter(v("g_roi"), "roi_id", exclude=listed)
    return kept.select("roi_id", F.lit("kept").alias("side")).unionByName(rest.select("roi_id", F.lit("rest").alias("side")))


@query("pending_work", "SELECT roi_id, type FROM g_roi WHERE roi_id NOT IN (SELECT roi_id FROM g_tile WHERE n_flooded > 19000)")
def _pending(v):
    return pending_work(v("g_roi"), v("g_tile").where("n_flooded > 19000").select("roi_id"), "roi_id").select("roi_id", "type")


@query("scan_folds", "SELECT roi_id, k.test AS test_fold, CASE WHEN fold = k.test THEN 'test' WHEN fold = (k.test + 1) % 5 THEN 'val' ELSE 'train' END AS role FROM g_roi, (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS test) k")
def _scan_folds(v):
    rows = [v("g_roi").select("roi_id", F.lit(k).alias("test_fold"), fold_role(F.col("fold"), k).alias("role")) for k in range(5)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("scan_norms", "SELECT band, round(avg(raw_i16), 6) AS mean, CASE band WHEN 'temperature_2m' THEN 0 ELSE 1 END AS pos FROM g_weather WHERE band IN ('temperature_2m', 'surface_pressure') GROUP BY band")
def _norms(v):
    return scan_norms(v("g_weather").groupBy("band").agg(F.round(F.avg("raw_i16"), 6).alias("mean")), ["temperature_2m", "surface_pressure"])


_TILE_KEYS = """k AS (SELECT DISTINCT CAST(n AS INT) AS north, CAST(e AS INT) AS east FROM (SELECT n, unnest(generate_series(CAST(floor(xlo/{n})*{n} AS BIGINT), greatest(CAST(floor(xlo/{n})*{n} AS BIGINT), CAST(ceil(xhi/{n})*{n} - {n} AS BIGINT)), {n})) AS e
    FROM (SELECT unnest(generate_series(CAST(floor(ylo/{n})*{n} AS BIGINT), greatest(CAST(floor(ylo/{n})*{n} AS BIGINT), CAST(ceil(yhi/{n})*{n} - {n} AS BIGINT)), {n})) AS n, xlo, xhi FROM g_tile) a) b)"""


@query("tile_key_manifest", f"WITH {_TILE_KEYS.format(n=3)} SELECT north, east FROM k")
def _tile_keys(v):
    return tile_key_manifest(v("g_tile"), 3)


@query("product_tile_names", f"""WITH {_TILE_KEYS.format(n=1)}, c AS (SELECT north, east, CASE WHEN north < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(north) AS VARCHAR), 2, '0') AS n, CASE WHEN east < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(east) AS VARCHAR), 3, '0') AS e,
      CAST(floor(north / 3.0) * 3 AS INT) AS n3, CAST(floor(east / 3.0) * 3 AS INT) AS e3, CAST(floor(north / 10.0) * 10 AS INT) AS n10, CAST(floor(east / 10.0) * 10 AS INT) AS e10 FROM k)
    SELECT north, east, 'Copernicus_DSM_10_' || n || '_00_' || e || '_00' AS dem, 'Copernicus_DSM_COG_10_' || n || '_00_' || e || '_00_HAND.tif' AS hand,
      'ESA_WorldCover_10m_2021_v200_' || CASE WHEN n3 < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(n3) AS VARCHAR), 2, '0') || CASE WHEN e3 < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(e3) AS VARCHAR), 3, '0') || '_Map.tif' AS cover,
      'srtm_' || lpad(CAST(CAST(floor((east + 180) / 5.0) + 1 AS INT) AS VARCHAR), 2, '0') || '_' || lpad(CAST(CAST(floor((60 - north) / 5.0) + 1 AS INT) AS VARCHAR), 2, '0') AS srtm,
      'yearlyClassification2021-000' || lpad(CAST(CAST((70 - n10) * 4 / 10 AS INT) AS VARCHAR), 3, '0') || '0000-000' || lpad(CAST(CAST((e10 + 180) * 4 / 10 AS INT) AS VARCHAR), 3, '0') || '0000.tif' AS water FROM c""")  # fmt: skip
def _products(v):
    return product_tile_names(tile_key_manifest(v("g_tile"), 1))


@query("product_mosaic", "SELECT band, count(*) AS n, CAST(sum(raw_i16) AS BIGINT) AS total FROM g_weather WHERE gx BETWEEN 3 AND 17 AND gy BETWEEN 2 AND 9 AND gx % 8 <> 0 AND gy % 8 <> 0 GROUP BY band")
def _mosaic(v):
    return product_mosaic(v("g_weather"), (3, 2, 17, 9), 8).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_i16").alias("total"))


@query("backfill_manifest", "SELECT roi_id, CAST(unnest(generate_series(post_date - 19, post_date, INTERVAL 1 DAY)) AS DATE) AS day FROM g_roi")
def _backfill(v):
    return backfill_manifest(v("g_roi"))


@query("write_results", "SELECT continent, count(*) AS n FROM g_basin GROUP BY continent")
def _results(v):
    path = new_path(v.spark, "results")
    write_results(v("g_basin").groupBy("continent").agg(F.count(F.lit(1)).alias("n")), path)
    return v.spark.read.schema("continent int, n long").json(path)


@query("write_partitions", "SELECT hybas_id, CAST(continent % 5 AS INT) AS \"partition\" FROM g_basin")
def _partitions(v):
    path = new_path(v.spark, "partitions")
    write_partitions(v("g_basin").select("hybas_id", (F.col("continent") % 5).alias("partition")), path)
    return v.spark.read.parquet(path).select("hybas_id", F.col("partition").cast("int").alias("partition"))
