"""Fixed names and band lists of the data model, and small tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names by number, as the atlas and the maps number them.
CLASSES = {0: "background", 1: "permanent water", 2: "flood"}
CONTINENTS = {
    1: "Africa",
    2: "Europe and middle east",
    3: "Russia",
    4: "Asia",
    5: "Oceania, pacific islands and south-east Asia",
    6: "South America",
    7: "North America 1",
    8: "North America 2",
    9: "Greenland",
}
CLIMATE_ZONES = {
    1: "Arctic 1",
    2: "Arctic 2",
    3: "Extremely cold and wet 1",
    4: "Extremely cold and wet 2",
    5: "Cold and wet",
    6: "Extremely cold and mesic",
    7: "Cold and mesic",
    8: "Cool temperate and dry",
    9: "Cool temperate and xeric",
    10: "Cool temperate and moist",
    11: "Warm temperate and mesic",
    12: "Warm temperate and xeric",
    13: "Hot and mesic",
    14: "Hot and dry",
    15: "Hot and arid",
    16: "Extremely hot and arid",
    17: "Extremely hot and xeric",
    18: "Extremely hot and moist",
}


def label_of(number: Column, names: dict[int, str]) -> Column:
    """The name of a number, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), number.cast("int"))


def domain(spark: SparkSession, names: dict[int, str], key: str) -> DataFrame:
    """A table of (key, name): at most a few dozen rows, so it may be broadcast."""
    return spark.createDataFrame(list(names.items()), f"{key} int, name string")


def values_sql(names: dict[int, str]) -> str:
    return ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in names.items())
