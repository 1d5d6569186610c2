"""As-of joins: to each row the nearest row of another table in time, after or before it, without a join of all pairs.

Both sides are put into one table and read in the order of time, the last row of the other side being carried along. A key's time is cut
into spans, each sorted apart, so that a key with most of the rows is many tasks; what a span lacks comes from the first span that
has something, which is looked up in a table of one row a key and span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.plans.registry import query

SPAN_DAYS = 30


def span_of(time: Column, days: int = SPAN_DAYS) -> Column:
    """The number of the span of time that a timestamp (without a zone) or a date is in."""
    return F.floor(F.date_diff(time.cast("date"), F.lit("2000-01-01").cast("date")) / days)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, into: str = "match", after: bool = True, strict: bool = False, days: int = SPAN_DAYS) -> DataFrame:
    """Rows of ``left``, each with the nearest row of ``right`` (``into``, a struct of its columns but ``on``) that has its key and is not before it; null if there is none.

    Not ``after``: the nearest that is not after it. ``strict``: equal times do not count. Of rows of ``right`` of one time the first in the
    order of their columns is taken, the last one if not ``after``. Null keys and null times meet nothing.
    """
    values = [c for c in right.columns if c not in on]
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(on)]
    keys = [f"k{i}" for i in range(len(on))]
    row = F.struct(F.col(right_time).alias("t"), F.struct(*[F.col(c) for c in values]).alias("v"))
    ours = left.select(*key, F.col(left_time).alias("t"), F.struct("*").alias("own"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("other"))
    known = F.col(right_time).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    theirs = right.where(known).select(*key, F.col(right_time).alias("t"), F.lit(None).cast(left.select(F.struct("*").alias("own")).schema["own"].dataType).alias("own"), row.alias("other"))
    both = ours.unionByName(theirs).withColumn("span", span_of(F.col("t"), days))
    # the way in which time is read: what is wanted comes by before what wants it
    turn = (lambda c: F.col(c).desc()) if after else (lambda c: F.col(c).asc())
    first = F.col("own").isNotNull() if not strict else F.col("own").isNull()  # at equal times
    order = [turn("t"), first.asc(), turn("other")]
    within = F.last("other", ignorenulls=True).over(Window.partitionBy(*keys, "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("found", within).where("own IS NOT NULL")
    # the nearest row of each span, and of the nearest further span that has one
    nearest = both.groupBy(*keys, "span").agg((F.min if after else F.max)("other").alias("edge"))
    beyond = F.last("edge", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(turn("span")).rowsBetween(Window.unboundedPreceding, -1))
    edges = nearest.withColumn("beyond", beyond).select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("span").alias("e_span"), "beyond").where("beyond IS NOT NULL")
    same = F.col("span") == F.col("e_span")
    for k in keys:
        same = same & (F.col(k) == F.col(f"e_{k}"))
    return met.join(edges, same, "left").select("own.*", F.coalesce("found.v", F.when(F.col("t").isNotNull(), F.col("beyond.v"))).alias(into))


def latest_in_span(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str, longest: int, shortest: int, fits: Column, order: list[str], days: int = SPAN_DAYS) -> DataFrame:
    """Rows of ``left`` with the last row (``match``, by ``order``) of ``right`` that is from ``longest`` to ``shortest`` days before it and for which ``fits``; null if none is.

    Sides meet on spans of time, so a row meets only those of the few spans that its days reach back to. ``left`` has no two equal rows; the
    sides share no column names but ``on``.
    """
    back = lambda n: span_of(F.date_sub(F.col(left_day), n), days)
    wide = left.withColumn("span", F.explode(F.sequence(back(longest), back(shortest))))
    pairs = wide.join(right.withColumn("span", span_of(F.col(right_day), days)), [*on, "span"])
    gap = F.date_diff(F.col(left_day), F.col(right_day).cast("date"))
    values = F.struct(*[F.col(c) for c in right.columns if c not in on])
    best = pairs.where(gap.between(shortest, longest) & fits).groupBy(*left.columns).agg(F.max_by(values, F.struct(*order)).alias("match"))
    best = best.withColumnsRenamed({c: f"of_{c}" for c in left.columns})
    same = F.lit(True)
    for c in left.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return left.join(best, same, "left").select(*left.columns, "match")


# --- queries ---------------------------------------------------------------------------------------------------

# the days of each basin's event and of 30 days on, each with the scene that is next and the one before
_DAYS = "d AS (SELECT basin_key, CAST(began + CAST(i AS INT) AS TIMESTAMP) AS at FROM g_scene_event, generate_series(0, 30) AS g(i))"


@query("asof_scenes", f"""WITH {_DAYS}, s AS (SELECT basin_key, start_time, max(event_id) AS last_id, min(event_id) AS first_id FROM g_scene GROUP BY basin_key, start_time),
    n AS (SELECT d.basin_key, d.at, s.start_time AS next_time, s.first_id AS next_id FROM d ASOF LEFT JOIN s ON d.basin_key = s.basin_key AND d.at <= s.start_time)
    SELECT n.*, s.start_time AS last_time, s.last_id FROM n ASOF LEFT JOIN s ON n.basin_key = s.basin_key AND n.at > s.start_time""")  # fmt: skip
def _asof(v):
    days = v("g_scene_event").select("basin_key", F.explode(F.sequence("began", F.date_add("began", 30))).alias("day")).select("basin_key", F.col("day").cast("timestamp_ntz").alias("at"))
    scenes = v("g_scene").select("basin_key", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "event_id")
    found = asof_join(days, scenes, ["basin_key"], "at", "start_time", "n", days=7)
    found = asof_join(found, scenes, ["basin_key"], "at", "start_time", "l", after=False, strict=True, days=7)
    return found.select("basin_key", "at", F.col("n.start_time").alias("next_time"), F.col("n.event_id").alias("next_id"), F.col("l.start_time").alias("last_time"), F.col("l.event_id").alias("last_id"))
