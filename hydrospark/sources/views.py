"""Stand-in hydrology tables derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "g_basin": """SELECT hybas_id, next_down, next_sink, endo, coast, continent, clz_cl_smj, riv_tc_usu, pop_ct_usu, tmp_dc_uyr, pre_mm_uyr,
        xlo, ylo, xlo + 3.0 AS xhi, ylo + 3.0 AS yhi
        FROM (SELECT (c+1)*1000000000 + 80000000 + k AS hybas_id,
          CASE WHEN q = 0 THEN CAST(0 AS BIGINT) ELSE (c+1)*1000000000 + 80000000 + (CAST(floor((q-1)/2.0) AS BIGINT)*8 + s)*9 + c END AS next_down,
          (c+1)*1000000000 + 80000000 + s*9 + c AS next_sink,
          CASE WHEN s = 7 THEN 2 ELSE 0 END AS endo, CASE WHEN q = 0 THEN 1 ELSE 0 END AS coast,
          CAST(c+1 AS INT) AS continent, CAST(1 + k % 18 AS INT) AS clz_cl_smj,
          (k*37) % 30000 AS riv_tc_usu, (k*7919) % 100000 AS pop_ct_usu,
          CAST((k*13) % 400 AS DOUBLE)/10.0 AS tmp_dc_uyr, CAST((k*29) % 3000 AS DOUBLE) AS pre_mm_uyr,
          CAST(-180 + 3*(k % 120) AS DOUBLE) AS xlo, CAST(-60 + 3*(CAST(floor(k/120.0) AS BIGINT) % 40) AS DOUBLE) AS ylo
        FROM (SELECT k, k % 9 AS c, CAST(floor(k/9.0) AS BIGINT) % 8 AS s, CAST(floor(CAST(floor(k/9.0) AS BIGINT)/8.0) AS BIGINT) AS q
          FROM (SELECT p_partkey - (SELECT min(p_partkey) FROM {part}) AS k FROM {part}) a) b) c2""",
    "g_flood": """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS began, ended,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Heavy rain' WHEN '2-HIGH' THEN 'Tropical cyclone' WHEN '3-MEDIUM' THEN 'Storm surge' WHEN '4-NOT SPECIFIED' THEN 'Dam break' ELSE 'Snowmelt' END AS maincause,
        CAST(o_custkey % 50 AS BIGINT) AS dead, (o_orderkey * 97) % 40000 AS displaced, xlo, ylo, xlo + 2.0 + (o_orderkey % 5) AS xhi, ylo + 2.0 + (o_custkey % 4) AS yhi
        FROM (SELECT *, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 21 AS INT) AS ended,
          CAST(-180 + (o_orderkey * 31) % 355 AS DOUBLE) AS xlo, CAST(-60 + (o_custkey * 17) % 115 AS DOUBLE) AS ylo FROM {orders}) t""",
    "g_cyclone": """SELECT concat(CAST(1995 + c_custkey % 7 AS VARCHAR(4)), '_', CASE c_nationkey % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'WP' ELSE 'SI' END, '_', c_name) AS storm_key,
        DATE '1995-01-01' + CAST((c_custkey * 7) % 2400 AS INT) AS first_track, DATE '1995-01-01' + CAST((c_custkey * 7) % 2400 + 3 + c_custkey % 10 AS INT) AS last_track,
        CAST(-180 + (c_custkey * 29) % 350 AS DOUBLE) AS xlo, CAST(-40 + (c_custkey * 13) % 80 AS DOUBLE) AS ylo,
        CAST(-180 + (c_custkey * 29) % 350 AS DOUBLE) + 8.0 AS xhi, CAST(-40 + (c_custkey * 13) % 80 AS DOUBLE) + 8.0 AS yhi FROM {customer}""",
    "g_gauge": """SELECT c_custkey AS gauge_id, CAST((c_custkey * 53) % 3600 AS DOUBLE)/10.0 - 180.0 + 0.05 AS lon,
        CAST((c_custkey * 31) % 1100 AS DOUBLE)/10.0 - 60.0 + 0.05 AS lat FROM {customer}""",
    # a third of the rivers go to the right, a third to the left, a third stand upright (some are single points)
    "g_river": """SELECT river_id, riv_tc_usu, upland_skm, CASE WHEN turn = 1 THEN x + 4.0 ELSE x END AS x1, CASE WHEN turn = 1 THEN y + rise ELSE y END AS y1,
        CASE WHEN turn = 0 THEN x + 4.0 ELSE x END AS x2, CASE WHEN turn = 1 THEN y ELSE y + rise END AS y2
        FROM (SELECT p_partkey AS river_id, (p_partkey * 41) % 3000 AS riv_tc_usu, (p_partkey * 19) % 4000 AS upland_skm, p_partkey % 3 AS turn,
          CAST((p_partkey * 7) % 64 AS DOUBLE) AS x, CAST((p_partkey * 11) % 8 AS DOUBLE) AS y, CAST(p_size % 5 AS DOUBLE) AS rise FROM {part}) r""",
    "g_scene": """SELECT event_id, ts AS start_time, CAST(user_id % 40 AS BIGINT) AS basin_key,
        CASE WHEN event_id % 5 = 0 THEN 'HH+HV' ELSE 'VV+VH' END AS polarization,
        CASE WHEN event_id % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS flight_direction,
        CAST(-170 + 4*(user_id % 40) AS DOUBLE) + (event_id % 3)*0.5E0 AS xlo, CAST(-20 AS DOUBLE) + (event_id % 4)*0.5E0 AS ylo FROM {events}""",
    "g_scene_event": """SELECT basin_key, DATE '2024-01-05' + CAST(basin_key % 20 AS INT) AS began,
        CAST(-170 + 4*basin_key AS DOUBLE) AS xlo, CAST(-20 AS DOUBLE) AS ylo, CAST(-170 + 4*basin_key AS DOUBLE) + 1.5E0 AS xhi, CAST(-20 AS DOUBLE) + 1.5E0 AS yhi
        FROM (SELECT DISTINCT CAST(user_id % 40 AS BIGINT) AS basin_key FROM {events}) t""",
    "g_roi": """SELECT roi_id, CASE WHEN roi_id % 5 = 0 THEN 'kurosiwo' ELSE 'generated' END AS type,
        CAST(1 + roi_id % 9 AS INT) AS continent, CAST(roi_id % 5 AS INT) AS fold, roi_id % 3 <> 0 AS flooding,
        DATE '2000-01-01' + CAST(roi_id * 3 AS INT) AS pre1_date, DATE '2000-01-01' + CAST(roi_id * 3 + 1 + roi_id % 70 AS INT) AS post_date
        FROM (SELECT DISTINCT o_orderkey % 97 AS roi_id FROM {orders}) t""",
    "g_tile": """SELECT roi_id, tile_id, tx, ty, n_background, n_permanent_water, n_flooded, xlo, ylo, xlo + 0.25E0 AS xhi, ylo + 0.25E0 AS yhi
        FROM (SELECT roi_id, tile_id, rk % 64 AS tx, CAST(floor(rk/64.0) AS BIGINT) AS ty, 50176 - n_pw - n_fl AS n_background, n_pw AS n_permanent_water, n_fl AS n_flooded,
          CAST(-170 + (roi_id * 3) % 340 AS DOUBLE) + CAST(rk % 64 AS DOUBLE)/4.0 AS xlo,
          CAST(-59 + (roi_id * 7) % 45 AS DOUBLE) + CAST(CAST(floor(rk/64.0) AS BIGINT) AS DOUBLE)/4.0 AS ylo
        FROM (SELECT o_orderkey % 97 AS roi_id, o_orderkey AS tile_id, CAST(floor(o_orderkey/97.0) AS BIGINT) AS rk,
          (o_orderkey * 11) % 20000 AS n_pw, CASE WHEN o_custkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE (o_custkey * 37) % 20000 END AS n_fl FROM {orders}) t) u""",
    "g_pixel": """SELECT l_orderkey % 97 AS roi_id, l_orderkey AS tile_id, l_linenumber AS px,
        CASE WHEN CAST(l_quantity AS INT) % 10 < 5 THEN 0 WHEN CAST(l_quantity AS INT) % 10 < 7 THEN 1 WHEN CAST(l_quantity AS INT) % 10 < 9 THEN 2 ELSE 255 END AS targ,
        CASE WHEN (CAST(l_quantity AS INT) + CAST(l_suppkey % 3 AS INT)) % 10 < 5 THEN 0 WHEN (CAST(l_quantity AS INT) + CAST(l_suppkey % 3 AS INT)) % 10 < 8 THEN 1 ELSE 2 END AS pred,
        CAST(1 + (l_orderkey % 97) % 9 AS INT) AS continent,
        CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(1 + l_orderkey % 18 AS INT) END AS clim_zone, l_orderkey % 4 = 0 AS coast FROM {lineitem}""",
    "g_weather": """SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_partkey % 24 AS INT) AS gx, CAST(l_suppkey % 12 AS INT) AS gy,
        CASE l_returnflag WHEN 'A' THEN 'total_precipitation_sum' WHEN 'N' THEN 'temperature_2m' ELSE 'surface_pressure' END AS band,
        CAST(round(l_quantity) AS BIGINT) * 100 AS raw_i16, CASE WHEN l_linenumber = 7 THEN true ELSE false END AS is_nodata FROM {lineitem}""",
}


class Views:
    """The stand-in tables of one folder; ``views("g_basin")`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        return self.spark.sql(sql, **{t: self.table(t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def with_views(sql: str) -> str:
    """DuckDB SQL with the stand-in tables that it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    plain = ", ".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {plain}, {body[15:]}"
    return f"WITH {plain}, {body[5:]}" if body.startswith("WITH ") else f"WITH {plain} {body}"
