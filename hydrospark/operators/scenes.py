"""Satellite scenes: day groups, eligibility, as-of joins and tuplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.operators.asof import asof_join, latest_in_span
from hydrospark.operators.polygons import bound, box_corners, common_ring, hull_ring, ring_holds_ring, share_of_pairs
from hydrospark.operators.spatial import clipped, ring_area, ring_planes
from hydrospark.plans.registry import query

SIDE = 2.5  # degrees of a scene


def with_box(scenes: DataFrame) -> DataFrame:
    return scenes.withColumns({"xhi": F.col("xlo") + SIDE, "yhi": F.col("ylo") + SIDE})


def dual(scenes: DataFrame) -> DataFrame:
    """Scenes with both polarizations; all later steps work on these."""
    return scenes.where(F.col("polarization") == "VV+VH")


def scene_day_groups(scenes: DataFrame) -> DataFrame:
    """Runs of scenes of one day in the order of time, for each basin and direction, with the convex hull of all of them and the box around it.

    Scenes of one day are successive captures of a basin that is wider than one, so a day's footprint is around their union.
    Captures of one place count once, whatever their number.
    """
    day = F.to_date("start_time")
    order = Window.partitionBy("basin_key", "flight_direction").orderBy("start_time", "event_id")
    flagged = scenes.withColumn("day", day).withColumn("starts", (F.lag("day").over(order).isNull() | (F.lag("day").over(order) != F.col("day"))).cast("int"))
    grouped = flagged.withColumn("grp", F.sum("starts").over(order)).groupBy("basin_key", "flight_direction", "grp", "day")
    found = grouped.agg(F.count(F.lit(1)).alias("n_scenes"), F.min("start_time").alias("first_time"), *footprint(), F.collect_set(F.struct("xlo", "ylo")).alias("places"))
    corners = F.flatten(F.transform("places", lambda p: box_corners(p["xlo"], p["ylo"], p["xlo"] + SIDE, p["ylo"] + SIDE)))
    return found.withColumn("ring", hull_ring(corners)).drop("places")


def footprint() -> list[Column]:
    """The box around the scenes of a group."""
    return [F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), (F.max("xlo") + SIDE).alias("xhi"), (F.max("ylo") + SIDE).alias("yhi")]


def footprint_intersection(groups: DataFrame, *by: str) -> DataFrame:
    """What the hulls of several day groups have in common: a convex ring, empty if there is nothing, and its area."""
    shared = groups.groupBy(*by).agg(F.collect_list("ring").alias("rings")).withColumn("ring", common_ring(F.col("rings")))
    return shared.withColumn("area", F.coalesce(ring_area(F.col("ring")), F.lit(0.0))).drop("rings")


def day_coverage(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """(basin_key, flight_direction, day, share): how much of an event's box the union of a day's captures covers."""
    taken = with_box(scenes).withColumn("day", F.to_date("start_time")).select("basin_key", "flight_direction", "day", *[F.col(c).alias(f"b_{c}") for c in ("xlo", "ylo", "xhi", "yhi")]).distinct()
    return share_of_pairs(taken.join(events.select("basin_key", "xlo", "ylo", "xhi", "yhi"), "basin_key"), ["basin_key", "flight_direction", "day"])


def scene_eligibility(scenes: DataFrame, events: DataFrame, n: int = 3, share: float | None = None) -> DataFrame:
    """Basins and the direction to use: at least n - 1 scene days before the event and one after; ascending is preferred.

    With ``share``, a day counts only if its captures together cover that part of the event's box.
    """
    days = dual(scenes).select("basin_key", "flight_direction", F.to_date("start_time").alias("day")).distinct()
    if share is not None:
        # nine digits, so that a day that covers it all does
        days = day_coverage(dual(scenes), events).where(F.round("share", 9) >= share).select("basin_key", "flight_direction", "day")
    counts = days.join(events.select("basin_key", "began"), "basin_key").groupBy("basin_key", "flight_direction").agg(F.count_if(F.col("day") < F.col("began")).alias("n_before"), F.count_if(F.col("day") >= F.col("began")).alias("n_after"))
    fit = counts.where((F.col("n_before") >= n - 1) & (F.col("n_after") >= 1))
    return fit.groupBy("basin_key").agg(F.min("flight_direction").alias("flight_direction"), F.min_by("n_before", "flight_direction").alias("n_before"), F.min_by("n_after", "flight_direction").alias("n_after"))


def first_scene_after(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """The first scene at or after the start of each event, of which a basin may have many; null if there is none."""
    shots = scenes.select("basin_key", F.col("start_time").cast("timestamp_ntz").alias("at"), "start_time", "event_id")
    found = asof_join(events.select("basin_key", "began", F.col("began").cast("timestamp_ntz").alias("from")), shots, ["basin_key"], "from", "at")
    return found.select("basin_key", "began", "match.start_time", "match.event_id")


def latest_covering_scene(scenes: DataFrame, events: DataFrame, days: int = 60, gap: int = 7) -> DataFrame:
    """The newest scene of the ``days`` that end ``gap`` days before the event and that covers its box; else the event's own (null id)."""
    e = events.select("basin_key", "began", *[F.col(c).alias(f"e_{c}") for c in ("xlo", "ylo", "xhi", "yhi")]).distinct()
    shots = with_box(scenes).select("basin_key", "start_time", "event_id", "xlo", "ylo", "xhi", "yhi")
    covers = (F.col("xlo") <= F.col("e_xlo")) & (F.col("ylo") <= F.col("e_ylo")) & (F.col("xhi") >= F.col("e_xhi")) & (F.col("yhi") >= F.col("e_yhi"))
    found = latest_in_span(e, shots, ["basin_key"], "began", "start_time", days + gap, gap, covers, ["start_time", "event_id"])
    return found.select("basin_key", "began", "match.event_id", F.coalesce(F.to_date("match.start_time"), F.col("began")).alias("day"))


def scene_tuplets(groups: DataFrame, events: DataFrame, min_area: float, n: int = 3) -> DataFrame:
    """For each day group from the event (basin_key, began) on, the closest earlier pair (n = 3) or single (n = 2) whose hulls share more than ``min_area`` with its own.

    Positions k, j, i count the groups of a basin and direction in the order of time. A key's days are one array, one group
    a day at most; each late day is a row of its own that walks back in it and stops at the first that fits. What a pair shares is
    clipped by the third, and a pair that shares too little is not gone on with.
    """
    keys = ["basin_key", "flight_direction"]
    listed = groups.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "grp", F.col("first_time").cast("timestamp_ntz").alias("first_time"), "ring"))).alias("days"))
    rows = listed.join(events.select("basin_key", F.col("began").cast("timestamp_ntz").alias("began")), "basin_key")
    late = F.filter(F.sequence(F.lit(1), F.size("days")), lambda k: F.element_at("days", k)["first_time"] >= F.col("began"))
    rows = rows.select(*keys, F.transform("days", lambda d: d["ring"]).alias("rings"), F.explode(late).alias("k")).repartition(*keys, "k")
    ring = lambda k: F.element_at("rings", k)
    kind = "struct<j:int,i:int,ring:array<struct<x:double,y:double>>>"
    none = F.lit(None).cast(kind)

    def back(of: Column, base: Column, found) -> Column:
        """The first of the places before ``of``, the last first, for which ``found`` gives something for what it shares with ``base``."""
        places = F.when(of > 1, F.sequence(of - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        shared = lambda at: bound(clipped(base, ring_planes(ring(at))), lambda both: F.when(F.coalesce(ring_area(both), F.lit(0.0)) > min_area, found(at, both)).otherwise(none))
        return F.aggregate(places, none, lambda got, at: F.when(got.isNotNull(), got).otherwise(shared(at)))

    made = lambda j, i, both: F.struct(j.cast("int").alias("j"), i.cast("int").alias("i"), both.alias("ring")).cast(kind)
    if n == 2:
        best = back(F.col("k"), ring(F.col("k")), lambda j, both: made(j, F.lit(None), both))
    else:
        best = back(F.col("k"), ring(F.col("k")), lambda j, both: back(j, both, lambda i, three: made(j, i, three)))
    found = rows.withColumn("best", best).where("best IS NOT NULL")
    return found.select(*keys, "k", "best.j", "best.i", "best.ring", ring_area(F.col("best.ring")).alias("area"))


def matching_scene(tiles: DataFrame, groups: DataFrame, key: str = "tile_id") -> DataFrame:
    """Tiles (key, basin_key, days, box) of which every day has a scene group of their basin, all in one direction, and that lie wholly in the hull of the first day's."""
    corners = box_corners(*[F.col(c) for c in ("xlo", "ylo", "xhi", "yhi")])
    days = tiles.select(key, "basin_key", F.size(F.array_distinct("days")).alias("n_days"), corners.alias("box"), F.posexplode("days").alias("place", "day"))
    met = days.join(groups.select("basin_key", "day", "flight_direction", "ring"), ["basin_key", "day"])
    per = met.groupBy(key, "flight_direction").agg(F.first("n_days").alias("n_days"), F.count_distinct("day").alias("n"), F.max(F.when(F.col("place") == 0, ring_holds_ring(F.col("ring"), F.col("box")))).alias("inside"))
    return tiles.join(per.where("n = n_days AND inside").select(key).distinct(), key, "left_semi")


def search_funnel(scenes: DataFrame, events: DataFrame, n: int = 3) -> DataFrame:
    """How many basins are left after each test, by direction: any scene, ``n`` dual ones, ``n`` days of them, n - 1 days before the event, one from it on."""
    j = scenes.join(events.select("basin_key", "began"), "basin_key").withColumn("day", F.when(F.col("polarization") == "VV+VH", F.to_date("start_time")))
    days = j.groupBy("basin_key", "flight_direction", "day").agg(F.count("day").alias("n_dual"), F.first("began").alias("began"))
    early = F.col("day") < F.col("began")
    per = days.groupBy("basin_key", "flight_direction").agg(F.sum("n_dual").alias("n_dual"), F.count("day").alias("n_days"), F.count_if(early).alias("n_before"), F.count_if(~early).alias("n_after"))
    steps, found = {"dual": F.col("n_dual") >= n, "days": F.col("n_days") >= n, "before": F.col("n_before") >= n - 1, "after": F.col("n_after") >= 1}, {}
    held = F.lit(True)
    for name, test in steps.items():
        held = held & test
        found[name] = F.count_if(held)
    return per.groupBy("flight_direction").agg(F.count(F.lit(1)).alias("searched"), *[c.alias(name) for name, c in found.items()])


# --- queries -------------------------------------------------------------------------------------------------

_GROUPS = """f AS (SELECT *, CAST(start_time AS DATE) AS day, CASE WHEN lag(CAST(start_time AS DATE)) OVER o IS DISTINCT FROM CAST(start_time AS DATE) THEN 1 ELSE 0 END AS starts FROM g_scene WHERE polarization = 'VV+VH' WINDOW o AS (PARTITION BY basin_key, flight_direction ORDER BY start_time, event_id)),
    h AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY basin_key, flight_direction ORDER BY start_time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM f),
    g AS (SELECT basin_key, flight_direction, grp, day, count(*) AS n_scenes, min(start_time) AS first_time, min(xlo) AS xlo, min(ylo) AS ylo, max(xlo + 2.5E0) AS xhi, max(ylo + 2.5E0) AS yhi FROM h GROUP BY basin_key, flight_direction, grp, day)"""


# hulls as heights: upper and lower ends at the places of a half-degree grid, between which they are straight; all corners stand on it
_HULLS = f"""{_GROUPS}, c AS (SELECT DISTINCT basin_key, flight_direction, grp, CAST(round(2 * (xlo + 170 - 4 * basin_key)) AS BIGINT) AS i, ylo AS y FROM h),
    e AS (SELECT basin_key, flight_direction, grp, i + 5 * r AS i, min(y) AS l, max(y) + 2.5E0 AS u FROM c, (SELECT unnest([0, 1]) AS r) r GROUP BY basin_key, flight_direction, grp, i + 5 * r),
    b AS (SELECT p.basin_key, p.flight_direction, p.grp, s AS i, max(p.u + (q.u - p.u) * coalesce((s - p.i) / nullif(q.i - p.i, 0), 0)) AS u, min(p.l + (q.l - p.l) * coalesce((s - p.i) / nullif(q.i - p.i, 0), 0)) AS l
      FROM e p JOIN e q ON p.basin_key = q.basin_key AND p.flight_direction = q.flight_direction AND p.grp = q.grp AND p.i <= q.i, generate_series(0, 7) AS s(s) WHERE s BETWEEN p.i AND q.i GROUP BY p.basin_key, p.flight_direction, p.grp, s),
    z AS (SELECT basin_key, flight_direction, grp, i, u AS u0, l AS l0, lead(u) OVER w AS u1, lead(l) OVER w AS l1 FROM b WINDOW w AS (PARTITION BY basin_key, flight_direction, grp ORDER BY i)),
    a AS (SELECT basin_key, flight_direction, grp, sum((u0 - l0 + u1 - l1) / 4) AS hull_area FROM z WHERE u1 IS NOT NULL GROUP BY basin_key, flight_direction, grp)"""


def _shared(sets: str, n: int) -> str:
    """SQL for (nr, area) of ``sets`` (nr, m, basin_key, flight_direction, grp): what the ``n`` hulls of each have in common. In each grid
    cell all ends are straight, so between the places where two of them cross the height is too."""
    return f"""(WITH zz AS (SELECT s.nr, s.m, z.* FROM {sets} s JOIN z ON s.basin_key = z.basin_key AND s.flight_direction = z.flight_direction AND s.grp = z.grp WHERE u1 IS NOT NULL),
      ln AS (SELECT nr, i, m, true AS up, u0 AS v0, u1 AS v1 FROM zz UNION ALL SELECT nr, i, m, false, l0, l1 FROM zz), full_ AS (SELECT nr, i FROM zz GROUP BY nr, i HAVING count(*) = {n}),
      ts AS (SELECT nr, i, t FROM full_, (SELECT unnest([0.0E0, 1]) AS t) t UNION SELECT x.nr, x.i, (x.v0 - y.v0) / (x.v0 - y.v0 - x.v1 + y.v1) FROM ln x JOIN ln y ON x.nr = y.nr AND x.i = y.i WHERE (x.v0 - y.v0) * (x.v1 - y.v1) < 0),
      iv AS (SELECT nr, i, t AS t0, lead(t) OVER (PARTITION BY nr, i ORDER BY t) AS t1 FROM ts SEMI JOIN full_ USING (nr, i)),
      hh AS (SELECT iv.nr, iv.i, t0, t1, min(CASE WHEN up THEN v0 + (v1 - v0) * (t0 + t1) / 2 END) - max(CASE WHEN NOT up THEN v0 + (v1 - v0) * (t0 + t1) / 2 END) AS height FROM iv JOIN ln ON iv.nr = ln.nr AND iv.i = ln.i WHERE t1 IS NOT NULL GROUP BY iv.nr, iv.i, t0, t1)
      SELECT nr, sum((t1 - t0) / 2 * greatest(height, 0)) AS area FROM hh GROUP BY nr)"""


@query("scene_day_groups", f"WITH {_HULLS} SELECT g.*, round(hull_area, 6) AS hull_area FROM g JOIN a ON g.basin_key = a.basin_key AND g.flight_direction = a.flight_direction AND g.grp = a.grp")
def _day_groups(v):
    return scene_day_groups(dual(v("g_scene"))).withColumn("hull_area", F.round(ring_area(F.col("ring")), 6)).drop("ring")


@query("footprint_intersection", f"""WITH {_HULLS}, d AS (SELECT basin_key * 100000 + epoch(day) // 86400 AS nr, basin_key, day, flight_direction, grp, count(*) OVER (PARTITION BY basin_key, day) AS n FROM g),
    s AS MATERIALIZED (SELECT nr, 1 AS m, basin_key, flight_direction, grp FROM d WHERE n = 1), t AS MATERIALIZED (SELECT nr, row_number() OVER (PARTITION BY nr ORDER BY flight_direction) AS m, basin_key, flight_direction, grp FROM d WHERE n = 2),
    r AS (SELECT * FROM {_shared('s', 1)} x UNION ALL SELECT * FROM {_shared('t', 2)} y)
    SELECT basin_key, day, round(coalesce(any_value(area), 0), 6) AS area FROM d LEFT JOIN r ON d.nr = r.nr GROUP BY basin_key, day""")  # fmt: skip
def _footprint(v):
    return footprint_intersection(scene_day_groups(dual(v("g_scene"))), "basin_key", "day").select("basin_key", "day", F.round("area", 6).alias("area"))


@query("scene_eligibility", """WITH d AS (SELECT DISTINCT basin_key, flight_direction, CAST(start_time AS DATE) AS day FROM g_scene WHERE polarization = 'VV+VH'),
    c AS (SELECT d.basin_key, flight_direction, CAST(count_if(day < began) AS BIGINT) AS n_before, CAST(count_if(day >= began) AS BIGINT) AS n_after FROM d JOIN g_scene_event e ON d.basin_key = e.basin_key GROUP BY d.basin_key, flight_direction)
    SELECT basin_key, flight_direction, n_before, n_after FROM (SELECT *, row_number() OVER (PARTITION BY basin_key ORDER BY flight_direction) AS r FROM c WHERE n_before >= 2 AND n_after >= 1) WHERE r = 1""")  # fmt: skip
def _eligible(v):
    return scene_eligibility(v("g_scene"), v("g_scene_event"))


# the captures' offsets and the box's sides are on a half-degree grid, so nine cells tell what is covered
@query("scene_eligibility_covered", """WITH t AS (SELECT DISTINCT s.basin_key, flight_direction, CAST(start_time AS DATE) AS day, began, s.xlo - e.xlo AS dx, s.ylo - e.ylo AS dy FROM g_scene s JOIN g_scene_event e ON s.basin_key = e.basin_key WHERE polarization = 'VV+VH'),
    d AS (SELECT basin_key, flight_direction, day, any_value(began) AS began FROM t, generate_series(0, 2) AS p(p), generate_series(0, 2) AS q(q) WHERE dx <= p / 2 AND dy <= q / 2 GROUP BY basin_key, flight_direction, day HAVING count(DISTINCT p * 3 + q) >= 0.75 * 9),
    c AS (SELECT basin_key, flight_direction, CAST(count_if(day < began) AS BIGINT) AS n_before, CAST(count_if(day >= began) AS BIGINT) AS n_after FROM d GROUP BY basin_key, flight_direction)
    SELECT basin_key, flight_direction, n_before, n_after FROM (SELECT *, row_number() OVER (PARTITION BY basin_key ORDER BY flight_direction) AS r FROM c WHERE n_before >= 2 AND n_after >= 1) WHERE r = 1""")  # fmt: skip
def _eligible_covered(v):
    return scene_eligibility(v("g_scene"), v("g_scene_event"), share=0.75)


@query("first_scene_after", """SELECT e.basin_key, e.began, s.start_time, s.event_id FROM g_scene_event e LEFT JOIN (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.basin_key ORDER BY start_time, event_id) AS r
    FROM g_scene c JOIN g_scene_event x ON c.basin_key = x.basin_key WHERE start_time >= x.began) WHERE r = 1) s ON e.basin_key = s.basin_key""")  # fmt: skip
def _after(v):
    return first_scene_after(v("g_scene"), v("g_scene_event"))


@query("latest_covering_scene", """SELECT e.basin_key, e.began, s.event_id, coalesce(CAST(s.start_time AS DATE), e.began) AS day FROM g_scene_event e LEFT JOIN (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.basin_key ORDER BY start_time DESC, event_id DESC) AS r
    FROM g_scene c JOIN g_scene_event x ON c.basin_key = x.basin_key WHERE CAST(start_time AS DATE) BETWEEN x.began - 67 AND x.began - 7 AND c.xlo <= x.xlo AND c.ylo <= x.ylo AND c.xlo + 2.5 >= x.xhi AND c.ylo + 2.5 >= x.yhi) WHERE r = 1) s ON e.basin_key = s.basin_key""")  # fmt: skip
def _covering(v):
    return latest_covering_scene(v("g_scene"), v("g_scene_event"))


# all pairs and triples of days that share enough are compared here; the least area is such that many fail
_TUPLETS = f"""o AS (SELECT g.basin_key, g.flight_direction, g.grp, CAST(row_number() OVER (PARTITION BY g.basin_key, g.flight_direction ORDER BY day, g.grp) AS INT) AS pos, first_time >= began AS late, hull_area FROM g JOIN g_scene_event e ON g.basin_key = e.basin_key JOIN a ON g.basin_key = a.basin_key AND g.flight_direction = a.flight_direction AND g.grp = a.grp),
    p2 AS MATERIALIZED (SELECT row_number() OVER () AS nr, k.basin_key, k.flight_direction, k.pos AS k, j.pos AS j, k.grp AS kg, j.grp AS jg, k.late FROM o k JOIN o j ON k.basin_key = j.basin_key AND k.flight_direction = j.flight_direction AND j.pos < k.pos WHERE k.hull_area > {{least}} AND j.hull_area > {{least}}),
    s2 AS MATERIALIZED (SELECT nr, 1 AS m, basin_key, flight_direction, kg AS grp FROM p2 UNION ALL SELECT nr, 2, basin_key, flight_direction, jg FROM p2), f2 AS MATERIALIZED (SELECT p2.* FROM p2 JOIN {_shared('s2', 2)} x ON p2.nr = x.nr WHERE area > {{least}}),
    p3 AS MATERIALIZED (SELECT row_number() OVER () AS nr, x.basin_key, x.flight_direction, x.k, x.j, y.j AS i, x.kg, x.jg, y.jg AS ig FROM f2 x JOIN f2 y ON x.basin_key = y.basin_key AND x.flight_direction = y.flight_direction AND y.k = x.j SEMI JOIN f2 w ON w.basin_key = x.basin_key AND w.flight_direction = x.flight_direction AND w.k = x.k AND w.j = y.j WHERE x.late),
    s3 AS MATERIALIZED (SELECT nr, 1 AS m, basin_key, flight_direction, kg AS grp FROM p3 UNION ALL SELECT nr, 2, basin_key, flight_direction, jg FROM p3 UNION ALL SELECT nr, 3, basin_key, flight_direction, ig FROM p3),
    q AS (SELECT basin_key, flight_direction, k, j, i, round(area, 6) AS area, row_number() OVER (PARTITION BY basin_key, flight_direction, k ORDER BY j DESC, i DESC) AS rn FROM p3 JOIN {_shared('s3', 3)} x ON p3.nr = x.nr WHERE area > {{least}})"""


@query("scene_tuplets", f"WITH {_HULLS}, {_TUPLETS.format(least=9.51)} SELECT basin_key, flight_direction, k, j, i, area FROM q WHERE rn = 1")
def _tuplets(v):
    found = scene_tuplets(scene_day_groups(dual(v("g_scene"))), v("g_scene_event"), 9.51)
    return found.select("basin_key", "flight_direction", "k", "j", "i", F.round("area", 6).alias("area"))


@query("matching_scene", f"""WITH {_HULLS}, n AS (SELECT e.basin_key, began, d, y, g.flight_direction, (SELECT count(*) FROM b WHERE b.basin_key = g.basin_key AND b.flight_direction = g.flight_direction AND b.grp = g.grp AND b.i IN (2, 3) AND b.l <= -20 + y AND b.u >= -19.5E0 + y) = 2 AS inside
      FROM g_scene_event e, generate_series(0, 3) AS o(o), (SELECT unnest([0, 2]) AS d) t, (SELECT o2 / 2 AS y FROM generate_series(1, 5) AS o2(o2)) y JOIN g ON g.basin_key = e.basin_key AND g.day = began + d WHERE o = 0)
    SELECT DISTINCT basin_key, y FROM n GROUP BY basin_key, y, flight_direction HAVING count(DISTINCT d) = 2 AND bool_or(d = 0 AND inside)""")  # fmt: skip
def _matching(v):
    """Half-degree tiles in a column above each event, of its day and the second day after it."""
    e = v("g_scene_event").select("basin_key", F.array("began", F.date_add("began", 2)).alias("days"), (F.col("xlo") + 1).alias("xlo"), (F.col("xlo") + 1.5).alias("xhi"), F.explode(F.expr("transform(sequence(1, 5), o -> o / 2.0D)")).alias("y"))
    tiles = e.select(F.struct("basin_key", "y").alias("tile_id"), "basin_key", "y", "days", "xlo", (F.lit(-20.0) + F.col("y")).alias("ylo"), "xhi", (F.lit(-19.5) + F.col("y")).alias("yhi"))
    return matching_scene(tiles, scene_day_groups(dual(v("g_scene")))).select("basin_key", "y")


@query("search_funnel", """WITH d AS (SELECT s.basin_key, flight_direction, CASE WHEN polarization = 'VV+VH' THEN CAST(start_time AS DATE) END AS day, began FROM g_scene s JOIN g_scene_event e ON s.basin_key = e.basin_key),
    p AS (SELECT basin_key, flight_direction, count(day) AS n, count(DISTINCT day) AS d, count(DISTINCT CASE WHEN day < began THEN day END) AS b, count(DISTINCT CASE WHEN day >= began THEN day END) AS a FROM d GROUP BY basin_key, flight_direction)
    SELECT flight_direction, count(*) AS searched, CAST(count_if(n >= 3) AS BIGINT) AS dual, CAST(count_if(n >= 3 AND d >= 3) AS BIGINT) AS days, CAST(count_if(n >= 3 AND d >= 3 AND b >= 2) AS BIGINT) AS before, CAST(count_if(n >= 3 AND d >= 3 AND b >= 2 AND a >= 1) AS BIGINT) AS after FROM p GROUP BY flight_direction""")  # fmt: skip
def _funnel(v):
    return search_funnel(v("g_scene"), v("g_scene_event"))
