"""Evaluation of flood maps: confusion counts and what follows from them.

All metrics come from one partial and final aggregation of pixels to (target, prediction) counts; a null class
is ignored. Where tiles are counted too, equal pixels become counts batch by batch, so that a task's memory does not grow with its tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.plans.joins import by_sort
from hydrospark.plans.registry import query

IGNORED = 255
N_CLASSES = 3
WATER_COVER = 80  # class of the land cover layer


def flatten_class(c: Column, n_classes: int = N_CLASSES) -> Column:
    """Classes above 2 become null (ignored); with 2 classes flood counts as water."""
    return F.when(c <= 2, F.least(c, F.lit(1)) if n_classes == 2 else c)


def flatten_classes(pixels: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    return pixels.withColumns({"targ": flatten_class(F.col("targ"), n_classes), "pred": flatten_class(F.col("pred"), n_classes)})


def confusion_matrix(pixels: DataFrame, *by: str) -> DataFrame:
    """Counts of (target, prediction), also as a share of the target; pixels with a null class are left out."""
    counts = pixels.where(F.col("targ").isNotNull() & F.col("pred").isNotNull()).groupBy(*by, "targ", "pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "targ")))


def hits(pixels: DataFrame, *by: str) -> DataFrame:
    """True and false positives and false negatives of each class, within the groups ``by``."""
    m = pixels.where(F.col("targ").isNotNull() & F.col("pred").isNotNull()).groupBy(*by, "targ", "pred").agg(F.count(F.lit(1)).alias("n"))
    sides = m.select(*by, "n", F.explode(F.when(F.col("targ") == F.col("pred"), F.array(F.struct(F.col("targ").alias("class"), F.lit("tp").alias("side")))).otherwise(F.array(F.struct(F.col("targ").alias("class"), F.lit("fn").alias("side")), F.struct(F.col("pred").alias("class"), F.lit("fp").alias("side"))))).alias("s"))
    total = lambda side: F.sum(F.when(F.col("s.side") == side, F.col("n")).otherwise(0)).alias(side)
    return sides.groupBy(*by, F.col("s.class").cast("int").alias("class")).agg(total("tp"), total("fp"), total("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"f1": F.try_divide(2.0 * tp, 2 * tp + fp + fn), "precision": F.try_divide(1.0 * tp, tp + fp), "recall": F.try_divide(1.0 * tp, tp + fn), "iou": F.try_divide(1.0 * tp, tp + fp + fn)})


def class_metrics(pixels: DataFrame) -> DataFrame:
    return metrics(hits(pixels))


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows of a batch become one with their number ``n``, so that no task keeps more than a batch, and a key with very many rows travels once a batch."""
    by = rows.columns

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(by, use_threads=False).aggregate([([], "count_all")]).select([*by, "count_all"]).rename_columns([*by, "n"]).to_batches()

    return rows.mapInArrow(work, rows.withColumn("n", F.lit(0).cast("long")).schema)


def stratified_f1(pixels: DataFrame) -> DataFrame:
    """F1 of each class, overall and within each continent, climate zone (null ones left out) and coast flag, with tiles."""
    of = ["continent", "clim_zone", "coast"]
    kept = pixels.where(F.col("targ").isNotNull() & F.col("pred").isNotNull()).select(*of, "tile_id", "targ", "pred")
    # neither side of this shuffle has a row of sums for each of its tiles; as many tasks as the session says, else they are put together by
    # their compressed bytes and a task gets millions of tiles
    dealt = counted(kept).repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile_id")
    # a tile counts at its first row in a stratum; one sort tells, then rows are summed for the few groups, and only these are spread over strata
    tile = Window.partitionBy("tile_id").orderBy(*of)
    before = tile.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.array_contains(F.collect_set(c).over(before), c)
    tiles = {"all_tiles": F.row_number().over(tile) == 1, "continent_tiles": ~seen(F.col("continent")), "clim_zone_tiles": ~seen(F.col("clim_zone")), "coast_tiles": ~seen(F.coalesce("coast", F.lit(False)))}
    pairs = [(i, j) for i in range(N_CLASSES) for j in range(N_CLASSES)]
    cells = [F.sum(F.when((F.col("targ") == i) & (F.col("pred") == j), F.col("n")).otherwise(0)).alias(f"n{i}{j}") for i, j in pairs]
    groups = dealt.withColumns(tiles).groupBy(*of).agg(*cells, *[F.count_if(F.col("tile_id").isNotNull() & F.col(c)).alias(c) for c in tiles])
    value = {"all": F.lit("all"), "continent": F.col("continent").cast("string"), "clim_zone": F.col("clim_zone").cast("string"), "coast": F.when(F.col("coast"), "coast").otherwise("inland")}
    strata = F.array(*[F.struct(F.lit(k).alias("stratum"), v.alias("value"), F.col(f"{k}_tiles").alias("tiles")) for k, v in value.items()])
    spread = groups.select(F.explode(F.filter(strata, lambda s: s["value"].isNotNull())).alias("s"), *[f"n{i}{j}" for i, j in pairs])
    found = spread.groupBy("s.stratum", "s.value").agg(F.sum("s.tiles").alias("n_tiles"), *[F.sum(f"n{i}{j}").alias(f"n{i}{j}") for i, j in pairs])
    total = lambda which: sum((F.col(f"n{i}{j}") for i, j in which), F.lit(0))
    others = lambda k: [i for i in range(N_CLASSES) if i != k]
    of_class = [F.struct(F.lit(k).alias("class"), F.col(f"n{k}{k}").alias("tp"), total((i, k) for i in others(k)).alias("fp"), total((k, i) for i in others(k)).alias("fn")) for k in range(N_CLASSES)]
    f1 = found.select("stratum", "value", "n_tiles", F.explode(F.array(*of_class)).alias("c")).select("stratum", "value", "n_tiles", "c.*").where("tp + fp + fn > 0")
    return metrics(f1).select("stratum", "value", "class", "f1", "n_tiles")


def tilewise_mse(pixels: DataFrame, last_class: int = N_CLASSES - 1) -> DataFrame:
    """Mean squared error of the last class's count for each tile."""
    tiles = pixels.where(F.col("targ").isNotNull() & F.col("pred").isNotNull()).groupBy("roi_id", "tile_id").agg(F.count_if(F.col("targ") == last_class).alias("t"), F.count_if(F.col("pred") == last_class).alias("p"))
    return tiles.agg(F.avg(((F.col("t") - F.col("p")) * (F.col("t") - F.col("p"))).cast("double")).alias("mse"), F.count(F.lit(1)).alias("n_tiles"))


def map_agreement(pixels: DataFrame) -> DataFrame:
    """IoU of each class between two runs (targ, pred), for each ROI and over all (null ROI); tiles with nodata are left out."""
    # pixels become counts for each tile before anything else
    counts = pixels.groupBy("roi_id", "tile_id", "targ", "pred").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.withColumn("worst", F.max("targ").over(Window.partitionBy("tile_id"))).where(F.col("worst") < IGNORED).groupBy("roi_id", "targ", "pred").agg(F.sum("n").alias("n"))
    classes = whole.select("roi_id", F.explode(F.sequence(F.lit(0), F.lit(N_CLASSES - 1))).alias("class"), "targ", "pred", "n")
    c = F.col("class")
    both, either = (F.col("targ") == c) & (F.col("pred") == c), (F.col("targ") == c) | (F.col("pred") == c)
    add = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    found = classes.groupingSets([["roi_id", "class"], ["class"]], "roi_id", "class").agg(add(both).alias("both_n"), add(either).alias("either_n"))
    return found.withColumn("iou", F.try_divide(F.col("both_n").cast("double"), F.col("either_n")))


def weighted_nll(pixels: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 4.0), sure: float = 0.8) -> DataFrame:
    """Mean of -weight * log(probability) over pixels that are not ignored; a prediction has ``sure``, each other class half the rest."""
    p = F.when(F.col("targ") == F.col("pred"), sure).otherwise((1 - sure) / 2)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("targ") + 1)
    return pixels.where(F.col("targ").isNotNull()).agg(F.round(F.avg(-weight * F.log(p)), 6).alias("nll"), F.count(F.lit(1)).alias("n"))


def blockout_join(pixels: DataFrame, water_tiles: DataFrame) -> DataFrame:
    """Target and prediction become null where the reference layer marks permanent water."""
    marked = pixels.join(water_tiles, "tile_id", "left")
    masked = F.coalesce(F.col("is_water"), F.lit(False))
    return marked.withColumns({"targ": F.when(~masked, F.col("targ")), "pred": F.when(~masked, F.col("pred"))}).drop("is_water")


def paste_permanent_water(pixels: DataFrame, cover: DataFrame) -> DataFrame:
    """The class becomes permanent water (1) where land cover says water or is missing, in tiles of the ocean."""
    found = pixels.join(by_sort(cover), "tile_id", "left")
    return found.withColumn("pasted", F.when(F.col("coast") & (F.coalesce(F.col("cover"), F.lit(WATER_COVER)) == WATER_COVER), 1).otherwise(F.col("targ"))).drop("cover")


def fold_mean_std(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of each model's F1 by class, and of the mean over classes (class 'F1')."""
    names = F.create_map(*[x for k, v in enumerate(("F1-B", "F1-W", "F1-F")) for x in (F.lit(k), F.lit(v))])
    single = scores.select("model", "fold", F.element_at(names, F.col("class")).alias("metric"), "f1")
    mean = scores.groupBy("model", "fold").agg(F.avg("f1").alias("f1")).select("model", "fold", F.lit("F1").alias("metric"), "f1")
    return single.unionByName(mean).groupBy("model", "metric").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.stddev_pop("f1"), 6).alias("std_f1"))


_VALID = "SELECT *, CASE WHEN targ <= 2 THEN targ END AS t, CASE WHEN pred <= 2 THEN pred END AS p FROM g_pixel"
_HITS = """c AS (SELECT {by} t, p, count(*) AS n FROM v WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY {by} t, p),
    k AS (SELECT unnest([0, 1, 2]) AS class),
    h AS (SELECT {by} CAST(k.class AS INT) AS class, CAST(sum(CASE WHEN t = k.class AND p = k.class THEN n ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN t <> k.class AND p = k.class THEN n ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN t = k.class AND p <> k.class THEN n ELSE 0 END) AS BIGINT) AS fn FROM c, k GROUP BY {by} k.class)"""


@query("flatten_classes", "WITH f AS (SELECT roi_id, CASE WHEN targ <= 2 THEN least(targ, 1) END AS targ, CASE WHEN pred <= 2 THEN least(pred, 1) END AS pred FROM g_pixel) SELECT roi_id, targ, pred, count(*) AS n FROM f GROUP BY roi_id, targ, pred")
def _flatten(v):
    return flatten_classes(v("g_pixel"), 2).groupBy("roi_id", "targ", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("confusion_matrix", f"WITH v AS ({_VALID}), c AS (SELECT t, p, count(*) AS n FROM v WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY t, p) SELECT t AS targ, p AS pred, n, n / sum(n) OVER (PARTITION BY t) AS share FROM c")
def _confusion(v):
    return confusion_matrix(flatten_classes(v("g_pixel")))


@query("class_metrics", f"WITH v AS ({_VALID}), {_HITS.format(by='')} SELECT class, tp, fp, fn, 2.0 * tp / (2 * tp + fp + fn) AS f1, 1.0 * tp / (tp + fp) AS \"precision\", 1.0 * tp / (tp + fn) AS recall, 1.0 * tp / (tp + fp + fn) AS iou FROM h")
def _metrics(v):
    return class_metrics(flatten_classes(v("g_pixel")))


_STRATA = """s AS (SELECT 'all' AS stratum, 'all' AS value, tile_id, t, p FROM v UNION ALL SELECT 'continent', CAST(continent AS VARCHAR), tile_id, t, p FROM v
    UNION ALL SELECT 'clim_zone', CAST(clim_zone AS VARCHAR), tile_id, t, p FROM v WHERE clim_zone IS NOT NULL
    UNION ALL SELECT 'coast', CASE WHEN coast THEN 'coast' ELSE 'inland' END, tile_id, t, p FROM v), k AS (SELECT unnest([0, 1, 2]) AS class),
    h AS (SELECT stratum, value, k.class, count_if(t = class AND p = class) AS tp, count_if(t <> class AND p = class) AS fp, count_if(t = class AND p <> class) AS fn,
      count(DISTINCT tile_id) AS n_tiles FROM s, k WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY stratum, value, k.class)"""


@query("stratified_f1", f"WITH v AS ({_VALID}), {_STRATA} SELECT stratum, value, CAST(class AS INT) AS class, CAST(2.0 * tp / (2 * tp + fp + fn) AS DOUBLE) AS f1, n_tiles FROM h WHERE tp + fp + fn > 0")
def _stratified(v):
    return stratified_f1(flatten_classes(v("g_pixel")))


@query("tilewise_mse", f"WITH v AS ({_VALID}), t AS (SELECT roi_id, tile_id, count_if(t = 2) AS a, count_if(p = 2) AS b FROM v WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY roi_id, tile_id) SELECT CAST(avg(CAST((a - b) * (a - b) AS DOUBLE)) AS DOUBLE) AS mse, count(*) AS n_tiles FROM t")
def _mse(v):
    return tilewise_mse(flatten_classes(v("g_pixel")))


@query("map_agreement", """WITH w AS (SELECT * FROM (SELECT *, max(targ) OVER (PARTITION BY tile_id) AS worst FROM g_pixel) WHERE worst < 255), k AS (SELECT unnest([0, 1, 2]) AS class),
    a AS (SELECT roi_id, CAST(k.class AS INT) AS class, CAST(count_if(targ = class AND pred = class) AS BIGINT) AS both_n, CAST(count_if(targ = class OR pred = class) AS BIGINT) AS either_n FROM w, k GROUP BY GROUPING SETS ((roi_id, k.class), (k.class)))
    SELECT roi_id, class, both_n, either_n, CASE WHEN either_n > 0 THEN CAST(both_n AS DOUBLE) / either_n END AS iou FROM a""")  # fmt: skip
def _agreement(v):
    return map_agreement(v("g_pixel"))


@query("weighted_nll", f"WITH v AS ({_VALID}) SELECT round(avg(-(CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 4.0 END) * ln(CASE WHEN t = p THEN 0.8E0 ELSE 0.1E0 END)), 6) AS nll, count(*) AS n FROM v WHERE t IS NOT NULL")
def _nll(v):
    return weighted_nll(flatten_classes(v("g_pixel")), sure=0.8)


@query("blockout_join", """WITH m AS (SELECT p.roi_id, CASE WHEN coalesce(t.n_permanent_water > 10000, false) THEN NULL ELSE p.targ END AS targ, CASE WHEN coalesce(t.n_permanent_water > 10000, false) THEN NULL ELSE p.pred END AS pred
    FROM g_pixel p LEFT JOIN g_tile t ON p.tile_id = t.tile_id) SELECT roi_id, count(targ) AS n_targ, count(pred) AS n_pred, count(*) AS n FROM m GROUP BY roi_id""")  # fmt: skip
def _blockout(v):
    water = v("g_tile").select("tile_id", (F.col("n_permanent_water") > 10000).alias("is_water"))
    return blockout_join(v("g_pixel"), water).groupBy("roi_id").agg(F.count("targ").alias("n_targ"), F.count("pred").alias("n_pred"), F.count(F.lit(1)).alias("n"))


@query("paste_permanent_water", """WITH c AS (SELECT tile_id, CASE WHEN tile_id % 3 = 0 THEN 80 WHEN tile_id % 3 = 1 THEN 10 END AS cover FROM g_tile),
    m AS (SELECT p.roi_id, CASE WHEN p.coast AND coalesce(c.cover, 80) = 80 THEN 1 ELSE p.targ END AS pasted FROM g_pixel p LEFT JOIN c ON p.tile_id = c.tile_id) SELECT roi_id, pasted, count(*) AS n FROM m GROUP BY roi_id, pasted""")  # fmt: skip
def _paste(v):
    cover = v("g_tile").select("tile_id", F.when(F.col("tile_id") % 3 == 0, 80).when(F.col("tile_id") % 3 == 1, 10).alias("cover"))
    return paste_permanent_water(v("g_pixel"), cover).groupBy("roi_id", "pasted").agg(F.count(F.lit(1)).alias("n"))


@query("fold_mean_std", f"""WITH v AS (SELECT *, roi_id % 5 AS fold, CASE WHEN coast THEN 'coast_model' ELSE 'inland_model' END AS model FROM ({_VALID})), {_HITS.format(by="model, fold,")},
    f AS (SELECT model, fold, CASE class WHEN 0 THEN 'F1-B' WHEN 1 THEN 'F1-W' ELSE 'F1-F' END AS metric, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM h),
    a AS (SELECT model, fold, metric, f1 FROM f UNION ALL SELECT model, fold, 'F1', avg(f1) FROM f GROUP BY model, fold)
    SELECT model, metric, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM a GROUP BY model, metric""")  # fmt: skip
def _folds(v):
    pixels = flatten_classes(v("g_pixel")).withColumns({"fold": F.col("roi_id") % 5, "model": F.when(F.col("coast"), "coast_model").otherwise("inland_model")})
    return fold_mean_std(metrics(hits(pixels, "model", "fold")))
