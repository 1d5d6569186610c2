"""User models over tiles, blending of tiles, and a pixel classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.operators.projections import argmax_class
from hydrospark.operators.rasters import focal
from hydrospark.plans.registry import query


def score_tiles(tiles: DataFrame, values: str, key: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(key, scores) of each tile by a user's model; ``load`` is called once for each task and gives a function of a batch of tiles."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], "scores": list(model(np.stack(pdf[values].to_numpy())).astype(float))})

    return tiles.select(key, values).mapInPandas(work, f"{key} {tiles.schema[key].dataType.simpleString()}, scores array<double>")


def ensemble_mean(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Mean of two models' scores."""
    joined = a.join(b.withColumnRenamed("scores", "other"), key)
    return joined.select(key, F.zip_with("scores", "other", lambda x, y: (x + y) / 2).alias("scores"))


def edge_weights(side: int) -> np.ndarray:
    """(3, 3, side, side): how much each neighbour counts at each pixel, itself in the middle; it falls to its edges, where theirs rise."""
    c = (side - 1) / 2
    x = np.arange(side) / c
    one = np.stack((np.maximum(0, 1 - x), 1 - np.abs(x - 1), np.maximum(0, x - 1)))
    return one[:, None, :, None] * one[None, :, None, :]


def blend_offset_tiles(tiles: DataFrame, side: int) -> DataFrame:
    """Tiles (ox, oy, tx, ty, values) of the lattice (0, 0), blended with their up to eight neighbours that are half a tile off.

    A neighbour's half that lies on the tile counts by ``edge_weights``; missing ones add nothing. Each tile of
    an offset lattice goes to the tiles that it touches: one equi-join key, at most nine arrays in a group.
    """
    half = side // 2
    w = edge_weights(side)
    # by row and column of the 3 x 3: the lattice, the step to the tile, and the pixel shift
    parts = []
    for r in range(3):
        for c in range(3):
            weights = w[r, c].ravel()
            parts.append((int(c != 1), int(r != 1), 1 if c == 0 else 0, 1 if r == 0 else 0, (0 if c == 1 else half if c == 0 else -half), (0 if r == 1 else half if r == 0 else -half), weights.tolist()))
    ox, oy = F.col("ox"), F.col("oy")

    def share(p: tuple) -> Column:
        lx, ly, sx, sy, dx, dy, weights = p
        places = F.sequence(F.lit(0), F.lit(side * side - 1))
        weight = F.array(*[F.lit(x) for x in weights])
        shifted = F.transform(places, lambda i: F.element_at(weight, i + 1) * F.coalesce(F.when((i % side + dx).between(0, side - 1) & (F.floor(i / side) + dy).between(0, side - 1), F.try_element_at(F.col("values"), (i + dx + dy * side + 1).cast("int"))), F.lit(0.0)))
        return F.when((ox == lx) & (oy == ly), F.struct((F.col("tx") + sx).alias("tx"), (F.col("ty") + sy).alias("ty"), shifted.alias("share")))

    spread = tiles.select(F.explode(F.filter(F.array(*[share(p) for p in parts]), lambda s: s.isNotNull())).alias("s")).select("s.*")
    zero = F.array_repeat(F.lit(0.0), side * side)
    summed = spread.groupBy("tx", "ty").agg(F.aggregate(F.collect_list("share"), zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("blended"))
    return tiles.where("ox = 0 AND oy = 0").select("tx", "ty").join(summed, ["tx", "ty"])


def pixel_logreg(rows: DataFrame, label: str, rounds: int = 20) -> DataFrame:
    """Weights of a logistic regression of a pixel's class on its own value and the mean of its 3 x 3 neighbourhood."""
    around = focal(rows.select("roi_id", "gx", "gy", "value"), [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], "roi_id").groupBy("roi_id", "gx", "gy").agg(F.avg("value").alias("around"))
    features = VectorAssembler(inputCols=["value", "around"], outputCol="features").transform(rows.join(around, ["roi_id", "gx", "gy"]).select("value", "around", F.col(label).cast("double").alias("label")))
    model = LogisticRegression(maxIter=rounds, regParam=0.01).fit(features)
    names = ["value", "around", "constant"]
    weights = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    return rows.sparkSession.createDataFrame(list(zip(names, weights)), "feature string, weight double")


def pixel_logreg_scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Probability of each pixel by a weights table (three rows)."""
    w = {r["feature"]: r["weight"] for r in weights.collect()}
    around = focal(rows.select("roi_id", "gx", "gy", "value"), [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], "roi_id").groupBy("roi_id", "gx", "gy").agg(F.avg("value").alias("around"))
    z = F.col("value") * w["value"] + F.col("around") * w["around"] + w["constant"]
    return rows.join(around, ["roi_id", "gx", "gy"]).select("roi_id", "gx", "gy", (1 / (1 + F.exp(-z))).alias("p"))


# --- queries -------------------------------------------------------------------------------------------------


def three_sums() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in model: the sums of the thirds of a tile."""
    return lambda x: np.stack([part.sum(1) for part in np.array_split(x.astype(float), 3, axis=1)], axis=1)


def three_peaks() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in model: the peaks of the thirds of a tile."""
    return lambda x: np.stack([part.max(1) for part in np.array_split(x.astype(float), 3, axis=1)], axis=1)


@query("score_tiles")
def _score(v):
    scored = score_tiles(v.table("embeddings"), "embedding", "vec_id", three_sums)
    return scored.select("vec_id", argmax_class(F.col("scores")).alias("class"), F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


@query("ensemble_mean")
def _ensemble(v):
    t = v.table("embeddings")
    mean = ensemble_mean(score_tiles(t, "embedding", "vec_id", three_sums), score_tiles(t, "embedding", "vec_id", three_peaks), "vec_id")
    return mean.select("vec_id", argmax_class(F.col("scores")).alias("class"))


@query("blend_offset_tiles")
def _blend(v):
    e = v.table("embeddings")
    k = F.floor(F.col("vec_id") / 4)
    tiles = e.select((F.col("vec_id") % 2).cast("int").alias("ox"), (F.floor(F.col("vec_id") / 2) % 2).cast("int").alias("oy"), (k % 16).alias("tx"), F.floor(k / 16).alias("ty"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    return blend_offset_tiles(tiles, 8).select("tx", "ty", F.transform("blended", lambda x: F.round(x, 6)).alias("blended"))


def _pixels(v) -> DataFrame:
    return v("g_tile").select("roi_id", F.col("tx").alias("gx"), F.col("ty").alias("gy"), (F.col("n_permanent_water") / 20000.0).alias("value"), (F.col("n_flooded") > 5000).cast("int").alias("label"))


@query("pixel_logreg")
def _logreg(v):
    return pixel_logreg(_pixels(v), "label").withColumn("weight", F.round("weight", 4))


@query("extra_processing", "SELECT roi_id, count(*) AS n FROM (SELECT roi_id, CASE WHEN targ <= 2 THEN targ END AS t FROM g_pixel) WHERE t = 2 GROUP BY roi_id")
def _extra(v):
    hook = lambda df: df.where(F.col("targ") == 2)  # noqa: E731  a user's function of the pixels
    from hydrospark.operators.evaluation import flatten_classes

    return v("g_pixel").transform(flatten_classes).transform(hook).groupBy("roi_id").agg(F.count(F.lit(1)).alias("n"))
