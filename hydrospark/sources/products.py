"""Products by name: rasters that are stored as square tiles of some degrees, read for an area.

A product is a Parquet folder by tile (north, east: the lower left corner), so an area reads its own tiles and no others. Each product has a
way of its own to make its tiles fit together, such as to leave out the row and the column that neighbours share.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from hydrospark.plans.registry import query
from hydrospark.plans.scratch import new_path

Box = tuple[float, float, float, float]


class MissingTiles(LookupError):
    """An area needs tiles that a product lacks."""


@dataclass(frozen=True)
class Product:
    """``degrees`` of a tile's side, the folder that it is in, and what is done to its pixels (north, east, x, y, ...) before they are put together."""

    name: str
    degrees: int
    path: str
    preprocess: Callable[[DataFrame], DataFrame] | None = None


def without_seam(degrees: int) -> Callable[[DataFrame], DataFrame]:
    """Leaves out the last column and the last row of each tile, those at its right and its lower edge, which the next tiles have too."""
    return lambda pixels: pixels.where((F.col("x") < F.col("east") + degrees) & (F.col("y") > F.col("north")))


@dataclass
class Products:
    """Products by their names."""

    spark: SparkSession
    known: dict[str, Product] = field(default_factory=dict)

    def add(self, product: Product) -> Products:
        if product.name in self.known:
            raise ValueError(f"there is a product {product.name} already")
        self.known[product.name] = product
        return self

    def _tiles(self, name: str) -> tuple[Product, DataFrame]:
        if name not in self.known:
            raise KeyError(f"no product {name}; there are {', '.join(sorted(self.known)) or 'none'}")
        product = self.known[name]
        return product, self.spark.read.parquet(product.path)

    def mosaic(self, name: str, box: Box, lenient: bool = False) -> DataFrame:
        """Pixels of a product in a box, its edges included, from all tiles under it. Tiles under its inside that are not there raise
        ``MissingTiles``; if ``lenient``, they are left out."""
        product, pixels = self._tiles(name)
        xlo, ylo, xhi, yhi = box
        n = product.degrees
        reach = lambda lo, hi: range(math.floor(lo / n) * n, max(math.ceil(hi / n) * n, math.floor(lo / n) * n + n), n)
        touched = lambda lo, hi: list(range(math.ceil(lo / n) * n - n, math.floor(hi / n) * n + 1, n))
        norths, easts = list(reach(ylo, yhi)), list(reach(xlo, xhi))
        own = pixels.where(F.col("north").isin(touched(ylo, yhi)) & F.col("east").isin(touched(xlo, xhi)))
        if not lenient:
            # tiles are as many as the area has; nothing but their keys is read
            there = {tuple(r) for r in own.select("north", "east").distinct().collect()}
            if lost := [(a, b) for a in norths for b in easts if (a, b) not in there]:
                raise MissingTiles(f"{name} lacks tiles {lost[:10]}{' and others' if len(lost) > 10 else ''}")
        fitted = product.preprocess(own) if product.preprocess else own
        return fitted.where(F.col("x").between(xlo, xhi) & F.col("y").between(ylo, yhi)).drop("north", "east")

    def mosaics(self, name: str, areas: DataFrame, key: str) -> DataFrame:
        """The same for a table of areas (key, box) at once, lenient: (key, pixel). Areas meet tiles by key, so tiles under none are not read."""
        product, pixels = self._tiles(name)
        own = areas.select(key, "xlo", "ylo", "xhi", "yhi")
        wanted = own.withColumn("tile", F.explode(F.expr(_tiles_of(product.degrees)))).select(key, "xlo", "ylo", "xhi", "yhi", "tile.*")
        fitted = product.preprocess(pixels) if product.preprocess else pixels
        met = fitted.join(wanted, ["north", "east"]).where("x >= xlo AND x <= xhi AND y >= ylo AND y <= yhi")
        return met.drop("north", "east", "xlo", "ylo", "xhi", "yhi")


def _tiles_of(n: int) -> str:
    """SQL for the corners of the tiles that a box touches, edges included."""
    span = lambda lo, hi: f"sequence(cast(ceil({lo} / {n}) * {n} - {n} AS int), cast(floor({hi} / {n}) * {n} AS int), {n})"
    return f"flatten(transform({span('ylo', 'yhi')}, a -> transform({span('xlo', 'xhi')}, b -> named_struct('north', a, 'east', b))))"


def write_product(pixels: DataFrame, product: Product, seam: bool = False) -> None:
    """Pixels (x, y, ...) as tiles of a product; with ``seam``, those on a tile's right or lower edge are in that tile too."""
    n = product.degrees
    start = lambda c: (F.floor(F.col(c) / n) * n).cast("int")
    # the tile that begins at a pixel's column, and the one that ends there; rows likewise, from above
    east = F.array_distinct(F.array(start("x"), (F.ceil(F.col("x") / n) * n - n).cast("int"))) if seam else F.array(start("x"))
    north = F.array_distinct(F.array((F.ceil(F.col("y") / n) * n - n).cast("int"), start("y"))) if seam else F.array(start("y"))
    rows = pixels.withColumn("east", F.explode(east)).withColumn("north", F.explode(north))
    rows.repartition("north", "east").write.partitionBy("north", "east").parquet(product.path)


# --- queries ---------------------------------------------------------------------------------------------------


def stand_in_products(v) -> Products:
    """Two products from the weather cells as degrees: rain in tiles of six degrees that share their edges, without the tile at (0, 6); warmth in tiles of four."""
    cells = v("g_weather").where("NOT is_nodata").groupBy(F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"), "band").agg(F.sum("raw_i16").alias("value"))
    rain = Product("rain", 6, new_path(v.spark, "product-rain"), without_seam(6))
    warmth = Product("warmth", 4, new_path(v.spark, "product-warmth"))
    tile = "floor(x / 6) = 1 AND y > 0 AND y <= 6"
    write_product(cells.where(f"band = 'total_precipitation_sum' AND NOT ({tile})").drop("band"), rain, seam=True)
    write_product(cells.where("band = 'temperature_2m'").drop("band"), warmth)
    return Products(v.spark).add(rain).add(warmth)


_CELLS = "c AS (SELECT gx AS x, gy AS y, band, sum(raw_i16)::BIGINT AS value FROM g_weather WHERE NOT is_nodata GROUP BY gx, gy, band)"
_HELD = "(band = 'temperature_2m' OR band = 'total_precipitation_sum' AND NOT (floor(x / 6) = 1 AND y > 0 AND y <= 6) AND y > 0)"


@query("product_by_name", f"WITH {_CELLS} SELECT CASE band WHEN 'temperature_2m' THEN 'warmth' ELSE 'rain' END AS name, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, value FROM c WHERE x BETWEEN 3 AND 17 AND y BETWEEN 1 AND 9 AND {_HELD}")
def _by_name(v):
    known, box = stand_in_products(v), (3.0, 1.0, 17.0, 9.0)
    found = [known.mosaic(name, box, lenient=name == "rain").select(F.lit(name).alias("name"), "x", "y", "value") for name in ("rain", "warmth")]
    return found[0].unionByName(found[1])


# each continent's area is a box of six by four cells
@query("products_of_areas", f"""WITH {_CELLS}, a AS (SELECT DISTINCT continent, continent * 2 AS xlo, continent % 5 + 1 AS ylo FROM g_roi)
    SELECT continent, CASE band WHEN 'temperature_2m' THEN 'warmth' ELSE 'rain' END AS name, count(*) AS n, sum(value)::BIGINT AS total FROM a JOIN c ON x BETWEEN xlo AND xlo + 6 AND y BETWEEN ylo AND ylo + 4 WHERE {_HELD} GROUP BY continent, band""")  # fmt: skip
def _of_areas(v):
    known = stand_in_products(v)
    box = {"xlo": F.col("continent") * 2.0, "ylo": F.col("continent") % 5 + 1.0}
    areas = v("g_roi").select("continent").distinct().withColumns(box).withColumns({"xhi": F.col("xlo") + 6, "yhi": F.col("ylo") + 4})
    found = [known.mosaics(name, areas, "continent").withColumn("name", F.lit(name)) for name in ("rain", "warmth")]
    return found[0].unionByName(found[1]).groupBy("continent", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
