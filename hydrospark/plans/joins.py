"""Joins of sides that grow with the input.

Spark takes a side for small by the bytes of its files or of its shuffle, which are compressed and, before an explode, a fraction of its
rows. Such a side is then collected and hashed on the driver, though it has millions of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MANY = 200_000  # rows, from which a table is not collected on the driver
ALIKE = 250  # keys of alike rows in one array; a task holds the product of two


def by_sort(side: DataFrame) -> DataFrame:
    """``side`` of a join that is never collected on the driver: both sides are shuffled and merged. ``F.broadcast`` of the other side, if it is known to be small, goes before."""
    return side.hint("merge")


def by_size(written: DataFrame, rows: int) -> DataFrame:
    """A written table of ``rows`` rows: Spark may collect it only if they are few."""
    return by_sort(written) if rows > MANY else written


def alike_keys(rows: DataFrame, on: list[str], key: str, first: str, keys: str) -> DataFrame:
    """(on, first, keys): the keys of the rows that are equal in ``on``, in arrays of up to ``ALIKE``; ``first`` is the least of all of them."""
    order = Window.partitionBy(*on).orderBy(key)
    numbered = rows.select(*on, key, F.first(key).over(order).alias(first), F.floor((F.row_number().over(order) - 1) / ALIKE).alias("lot"))
    return numbered.groupBy(*on, first, "lot").agg(F.collect_list(key).alias(keys)).drop("lot")


def of_alike(pairs: DataFrame, a: DataFrame, on_a: list[str], b: DataFrame, on_b: list[str]) -> DataFrame:
    """Pairs of alike rows (on_a, on_b, ...) with the ``keys`` of both, each as a row: the result may be the product of the two, so
    its rows are made last, side by side with what they share, and no row of it is moved or worked on after."""
    kept = [c for c in pairs.columns if c not in (*on_a, *on_b)]
    own = lambda members, on: by_sort(members.select(*on, *[c for c in members.columns if c not in on]))
    (key_a,), (key_b,) = ([c for c in m.columns if c not in on] for m, on in ((a, on_a), (b, on_b)))
    met = pairs.join(own(b, on_b), on_b).join(own(a, on_a), on_a)
    return met.select(key_a, F.explode(key_b).alias(key_b), *kept).select(F.explode(key_a).alias(key_a), key_b, *kept)
