"""Best-fit-decreasing bin packing of indivisible groups into shards.

Groups, largest first, enter the bin with the tightest remaining room that still holds them; a balanced tree
of rooms finds it. One walk over all groups would be one task, so groups are dealt out: small ones into many
buckets by a hash of their key, larger ones into ever fewer, up to one bucket for the largest. A bucket packs
its share of every shard on its own. Buckets with larger groups come first, and what they put into a shard
leaves it less room in the next round, so that small groups even out what large ones leave uneven.

Bounds: a bucket holds about ``PER_BUCKET`` groups at the lowest level and at most n_shards * GROW * PARTS
above it; the driver sees one total for each shard.

Defined cases: a group larger than a shard stays whole, alone if it can; ties of size go by key; equal texts
(repeated rows too) are one group; a null text counts as an empty one, a null id is kept and comes first; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from hydrospark.llm.common import checksum, whole_text
from hydrospark.plans.scratch import written

PER_BUCKET = 1000
GROW = 16  # times fewer buckets from level to level
PARTS = 8  # a bin of a bucket holds as many of its largest groups at least
PER_CELL = 1000  # rows that are numbered together


class RoomTree:
    """A balanced (AA) tree of distinct keys, here (room, tie, bin); ``ceiling`` finds the least key not below one."""

    __slots__ = ("root",)

    def __init__(self, keys: Iterable[tuple] = ()) -> None:
        self.root: list | None = None  # [key, level, left, right]
        for key in keys:
            self.add(key)

    @staticmethod
    def _skew(t: list | None) -> list | None:
        if t and t[2] and t[2][1] == t[1]:
            low = t[2]
            t[2], low[3] = low[3], t
            return low
        return t

    @staticmethod
    def _split(t: list | None) -> list | None:
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            high = t[3]
            t[3], high[2] = high[2], t
            high[1] += 1
            return high
        return t

    def add(self, key: tuple) -> None:
        def into(t: list | None) -> list:
            if not t:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = into(t[side])
            return self._split(self._skew(t))

        self.root = into(self.root)

    def remove(self, key: tuple) -> None:
        def out(t: list | None, key: tuple) -> list | None:
            if not t:
                return None
            if key == t[0]:
                if not t[2] and not t[3]:
                    return None
                side = 3 if t[3] else 2
                near = t[side]
                while near[5 - side]:
                    near = near[5 - side]
                t[0] = near[0]
                t[side] = out(t[side], near[0])
            else:
                side = 2 if key < t[0] else 3
                t[side] = out(t[side], key)
            level = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
            if level < t[1]:
                t[1] = level
                if t[3] and t[3][1] > level:
                    t[3][1] = level
            t = self._skew(t)
            if t[3]:
                t[3] = self._skew(t[3])
                if t[3][3]:
                    t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            if t[3]:
                t[3] = self._split(t[3])
            return t

        self.root = out(self.root, key)

    def ceiling(self, key: tuple) -> tuple | None:
        t, best = self.root, None
        while t:
            if t[0] >= key:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best

    def largest(self) -> tuple | None:
        t = self.root
        while t and t[3]:
            t = t[3]
        return t and t[0]


def best_fit(sizes: list[int], rooms: list[float], turn: int = 0) -> list[int]:
    """The bin of each size; sizes come largest first. What fits nowhere goes where most room is left."""
    n = len(rooms)
    tree = RoomTree((room, (b + turn) % n, b) for b, room in enumerate(rooms))
    bins = []
    for size in sizes:
        found = tree.ceiling((size,)) or tree.largest()
        tree.remove(found)
        tree.add((found[0] - size, found[1], found[2]))
        bins.append(found[2])
    return bins


def best_fit_bins(sizes: list[int], capacity: float) -> list[int]:
    """Bins of a fixed capacity, as few as best fit opens; a size above the capacity has a bin of its own."""
    tree, bins, n = RoomTree(), [], 0
    for size in sizes:
        found = tree.ceiling((size,))
        if found:
            tree.remove(found)
        else:
            found, n = (max(capacity, size), n), n + 1
        tree.add((found[0] - size, found[1]))
        bins.append(found[1])
    return bins


def packer(shares: list[float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one bucket (key, size, bucket); each shard has its share of the bucket's sum as room."""

    def into(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True])
        total = float(pdf["size"].sum())
        return pdf.assign(shard=best_fit(pdf["size"].tolist(), [x * total for x in shares], int(pdf["bucket"].iloc[0])))[["key", "size", "shard"]]

    return into


def pack(groups: DataFrame, n_shards: int) -> DataFrame:
    """``groups`` (key binary, size long, distinct keys) to (key, shard), shards 0 to n_shards - 1 of near equal size."""
    spark = groups.sparkSession
    seen = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    buckets = [max(1, -(-seen["n"] // PER_BUCKET))]
    while buckets[-1] > 1:
        buckets.append(-(-buckets[-1] // GROW))
    level = F.lit(len(buckets) - 1)
    for at in range(len(buckets) - 2, -1, -1):
        level = F.when(F.col("size") * PARTS * n_shards * buckets[at] <= seen["total"], at).otherwise(level)
    placed = groups.select("key", "size", level.alias("level"))
    left = {r["level"]: r["size"] for r in placed.groupBy("level").agg(F.sum("size").alias("size")).collect()}
    load, done = [0] * n_shards, []
    for at in sorted(left, reverse=True):
        rest = sum(size for k, size in left.items() if k <= at)
        room = [max(0.0, seen["total"] / n_shards - x) for x in load]
        scale = rest / sum(room) if sum(room) else 1.0

        into = packer([x * scale / max(rest, 1) for x in room])
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets[at])).alias("bucket")
        table = written(placed.where(F.col("level") == at).select("key", "size", bucket).groupBy("bucket").applyInPandas(into, "key binary, size long, shard int"), "packed")
        done.append(table.select("key", "shard"))
        if at > min(left):
            for r in table.groupBy("shard").agg(F.sum("size").alias("size")).collect():
                load[r["shard"]] += r["size"]
    result = done[0] if done else spark.createDataFrame([], "key binary, shard int")
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def numbered(rows: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """``rows`` (with shard, doc_id, text_crc32) with ``slot``: 0, 1, ... within the shard.

    Rows of a shard are dealt into cells by a hash of their id; a cell's first number is the sum of the cells
    before it, so that no task orders a whole shard.
    """
    cells = max(1, -(-n_rows // (n_shards * PER_CELL)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1)
    return ranked.join(base, ["shard", "cell"]).withColumn("slot", (F.col("base") + F.col("own")).cast("long")).drop("cell", "base", "own")


def shard_documents(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each document; equal texts share a shard, shards are near equal in bytes."""
    text = whole_text()
    rows = written(docs.select(F.col("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), checksum(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups")
    n_rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # written: the numbering reads it twice, and both times it must be the same
    placed = written(rows.join(pack(groups.select("key", "size"), n_shards), "key").drop("key"), "shard-placed")
    return numbered(placed, n_rows, n_shards)
