"""Tile collection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfell.functions import fixed, geo
from tarnfell.operators import raster as raster_ops
from tarnfell.operators import regions as region_ops
from tarnfell.operators import tiles as ops
from tarnfell.plans import sqlgeo
from tarnfell.plans.registry import query
from tarnfell.plans.telemetry import SQL_LAYERS
from tarnfell.session import scratch_path
from tarnfell.sources.tables import table
from tarnfell.sources.views import cte, view

TILES = "SELECT DISTINCT server, z, x, y FROM fx_region_tiles"


def stored(spark, sf):
    return view(spark, sf, "region_tiles").select(*ops.TILE).distinct()


@query("S7_zoom_scan", cte("region_tiles") + f"SELECT * FROM ({TILES}) WHERE z BETWEEN 8 AND 11")
def s7(spark, sf):
    return ops.zoom_scan(stored(spark, sf), 8, 11)


@query("S7_zoom_count", cte("region_tiles") + f"SELECT z, count(*) AS n FROM ({TILES}) WHERE z BETWEEN 8 AND 11 GROUP BY z")
def s7c(spark, sf):
    return ops.zoom_count(stored(spark, sf), 8, 11)


_WANTED = """SELECT DISTINCT CAST(7 + o_custkey % 8 AS INT) AS z, o_custkey % 64 AS x, o_orderkey % 64 AS y FROM {orders}"""


@query("S8_coordinate_scan", cte("region_tiles") + f"""SELECT * FROM ({TILES}) WHERE (z, x, y) IN
  (SELECT (z, x, y) FROM ({_WANTED.format(orders='orders')}))""")
def s8(spark, sf):
    wanted = spark.sql(_WANTED, orders=table(spark, sf, "orders"))
    return ops.coordinate_scan(stored(spark, sf), wanted).select(*ops.TILE)


_KEYS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 6
    WHEN 0 THEN concat(CAST(l_suppkey % 20 AS VARCHAR(20)), '/', CAST(l_orderkey AS VARCHAR(20)), '/', CAST(l_partkey AS VARCHAR(20)))
    WHEN 1 THEN concat(CAST(l_suppkey % 20 AS VARCHAR(20)), ':', CAST(l_orderkey AS VARCHAR(20)), ':', CAST(l_partkey AS VARCHAR(20)))
    WHEN 2 THEN concat('z', CAST(l_suppkey % 20 AS VARCHAR(20)), '/y', CAST(l_orderkey AS VARCHAR(20)), '/x', CAST(l_partkey AS VARCHAR(20)))
    WHEN 3 THEN concat(CAST(l_suppkey % 20 AS VARCHAR(20)), '/', CAST(l_orderkey AS VARCHAR(20)))
    WHEN 4 THEN concat(' ', CAST(l_suppkey % 20 AS VARCHAR(20)), '/-', CAST(l_orderkey AS VARCHAR(20)), '/', CAST(l_partkey AS VARCHAR(20)))
    ELSE concat(CAST(l_suppkey % 20 AS VARCHAR(20)), '/99999999999/', CAST(l_partkey AS VARCHAR(20))) END AS tile_text
  FROM {lineitem}"""


@query("S9_parsed_tile_keys", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z, x, y,
    z IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AS ok
  FROM (SELECT *, TRY_CAST(regexp_extract(tile_text, p, 1) AS INT) AS z, TRY_CAST(regexp_extract(tile_text, p, 3) AS INT) AS x,
    TRY_CAST(regexp_extract(tile_text, p, 2) AS INT) AS y FROM ({_KEYS.format(lineitem='lineitem')}),
    (SELECT '^\\s*z?(\\d+)[/:]y?(\\d+)[/:]x?(\\d+)\\s*$' AS p))""")
def s9(spark, sf):
    keys = spark.sql(_KEYS, lineitem=table(spark, sf, "lineitem"))
    return ops.parsed_keys(keys, "tile_text").drop("tile_text")


@query("S10_tile_sink", cte("region_tiles") + f"""SELECT server, z, x, y, concat('slope/v1/', z, '/', y, '/', x, '.png') AS tile_key
  FROM ({TILES})""")
def s10(spark, sf):
    path = scratch_path(spark, "tiles")
    ops.write_tiles(stored(spark, sf).withColumn("tile_key", ops.tile_key("slope/v1")), path)
    back = spark.read.parquet(path)
    return back.select(F.col("server"), F.col("z").cast("int").alias("z"), "x", F.col("y").cast("long").alias("y"), "tile_key")


@query("S12_unpublished", cte("region_tiles") + f"""SELECT * FROM ({TILES}) t WHERE NOT EXISTS (
  SELECT 1 FROM fx_region_tiles d WHERE d.region_id < '3' AND d.server = t.server AND d.z = t.z AND d.x = t.x AND d.y = t.y)""")
def s12(spark, sf):
    done = view(spark, sf, "region_tiles").filter("region_id < '3'")
    return ops.unpublished(stored(spark, sf), done, ops.TILE)


SQL_REGIONS = """regions AS (SELECT adm, kind, min(lat_e5) / 1e5 AS min_lat, max(lat_e5) / 1e5 AS max_lat, min(lon_e5) / 1e5 AS min_lon,
    max(lon_e5) / 1e5 AS max_lon FROM fx_places GROUP BY adm, kind)"""
SQL_RANGES = SQL_REGIONS + f""", ranges AS (SELECT adm, kind, z, {sqlgeo.tile_x('min_lon', 'z')} AS x0, {sqlgeo.tile_x('max_lon', 'z')} AS x1,
    {sqlgeo.tile_y('max_lat', 'z', fixed.LATITUDE_LIMIT_APP)} AS y0, {sqlgeo.tile_y('min_lat', 'z', fixed.LATITUDE_LIMIT_APP)} AS y1
    FROM regions, (SELECT CAST(unnest(range(7, 15)) AS INT) AS z))"""
SQL_JOBS = SQL_RANGES + f""", {SQL_LAYERS}, jobs AS (SELECT adm, kind, server, z, x, unnest(range(y0, y1 + 1)) AS y FROM (
    SELECT adm, kind, server, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM ranges JOIN layers ON z BETWEEN offline_min_z AND offline_max_z))"""


def _regions(spark, sf):
    return region_ops.place_regions(view(spark, sf, "places"))


@query("J15_region_jobs", cte("places") + f", {SQL_JOBS} SELECT * FROM jobs")
def j15(spark, sf):
    return ops.region_jobs(_regions(spark, sf), ["adm", "kind"], fixed.layers(spark))


@query("K3_job_order", cte("places") + f", {SQL_JOBS} SELECT DISTINCT server, z, x, y FROM jobs")
def k3(spark, sf):
    jobs = ops.region_jobs(_regions(spark, sf), ["adm", "kind"], fixed.layers(spark))
    return ops.job_order(jobs.select(*ops.TILE).distinct())


_BASE = "CASE WHEN z < 11 THEN 84000e0 / pow(2, 11 - z) WHEN z = 11 THEN 84000e0 WHEN z = 12 THEN 61000e0 WHEN z = 13 THEN 55000e0 ELSE 50000e0 END"
_SLOPE = "CASE z " + " ".join(f"WHEN {z} THEN {b}e0" for z, b in fixed.SLOPE_BYTES.items()) + " END * 0.45e0"


@query("A24_download_estimate", cte("places") + f""", {SQL_RANGES} SELECT adm, kind, tile_count, bytes, bytes > 1500000000 AS over_limit,
  bytes > 40000000 AS over_free FROM (SELECT adm, kind, CAST(sum(n * (CASE WHEN z < 14 THEN 4 ELSE 3 END
      + CASE WHEN z = 12 THEN 1 ELSE 0 END)) AS BIGINT) AS tile_count,
    CAST(floor(sum(n * ({_BASE} + {_SLOPE} + CASE WHEN z = 12 THEN 18400e0 * 0.8e0 ELSE 0e0 END) ORDER BY z)) AS BIGINT) AS bytes
    FROM (SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) AS n FROM ranges) GROUP BY adm, kind)""")
def a24(spark, sf):
    return ops.download_estimate(_regions(spark, sf), ["adm", "kind"], F.lit(40_000_000))


@query("J6_resume_plan", cte("region_tiles") + """SELECT r.region_id, r.server, r.z, r.x, r.y FROM (
    SELECT DISTINCT CAST((CAST(region_id AS BIGINT) + 1) AS VARCHAR) AS region_id, server, z, x, y FROM fx_region_tiles) r
  WHERE NOT EXISTS (SELECT 1 FROM fx_region_tiles h WHERE h.region_id = r.region_id AND h.server = r.server AND h.z = r.z
    AND h.x = r.x AND h.y = r.y)""")
def j6(spark, sf):
    held = view(spark, sf, "region_tiles")
    required = held.withColumn("region_id", (F.col("region_id").cast("long") + 1).cast("string"))
    keys = ["region_id", *ops.TILE]
    return ops.unpublished(required.select(*keys), held, keys)


@query("J7_refcounted_delete", cte("region_tiles") + """SELECT server, z, x, y, count(*) AS owners,
  count(*) FILTER (WHERE CAST(region_id AS BIGINT) % 3 <> 0) AS remaining,
  count(*) FILTER (WHERE CAST(region_id AS BIGINT) % 3 <> 0) = 0 AS deleted FROM fx_region_tiles GROUP BY server, z, x, y""")
def j7(spark, sf):
    doomed = F.col("region_id").cast("long") % 3 == 0
    return ops.refcounted_delete(view(spark, sf, "region_tiles"), doomed)


_REQUESTED = """SELECT event_id AS request_id, CAST(user_id % 5 AS INT) AS server, CAST(8 + event_id % 11 AS INT) AS z,
    (event_id * 31 + user_id) % 64 * CAST(pow(2, event_id % 4) AS BIGINT) AS x, (event_id * 17 + user_id) % 64 * CAST(pow(2, event_id % 4) AS BIGINT) AS y,
    CASE event_id % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'expectedNoData' WHEN 2 THEN 'unexpectedNoData' WHEN 3 THEN 'failure' ELSE 'network' END AS outcome
  FROM {events}"""
SQL_ANCESTORS = f"""req AS ({_REQUESTED.format(events='events')}), held AS ({TILES}),
  climb AS (SELECT server, z, x, y, unnest(range(7, z)) AS anc_z FROM (SELECT DISTINCT server, z, x, y FROM req) WHERE z > 7),
  anc AS (SELECT server, z, x, y, anc_z, anc_x, anc_y FROM (SELECT c.*, h.x AS anc_x, h.y AS anc_y,
      row_number() OVER (PARTITION BY c.server, c.z, c.x, c.y ORDER BY anc_z DESC) AS rn
    FROM climb c JOIN held h ON h.server = c.server AND h.z = c.anc_z AND h.x = c.x >> CAST(c.z - c.anc_z AS INT)
      AND h.y = c.y >> CAST(c.z - c.anc_z AS INT)) WHERE rn = 1)"""


def _requested(spark, sf):
    return spark.sql(_REQUESTED, events=table(spark, sf, "events"))


@query("J8_nearest_ancestor", cte("region_tiles") + f", {SQL_ANCESTORS} SELECT server, z, x, y, CAST(anc_z AS INT) AS anc_z, anc_x, anc_y FROM anc")
def j8(spark, sf):
    return ops.nearest_ancestors(_requested(spark, sf), stored(spark, sf))


@query("J9_tiered_lookup", cte("region_tiles") + f""", {SQL_ANCESTORS}, {SQL_LAYERS},
  store AS (SELECT DISTINCT server, z, x, y FROM fx_region_tiles WHERE CAST(region_id AS BIGINT) % 2 = 0),
  cache AS (SELECT DISTINCT server, z, x, y FROM fx_region_tiles WHERE CAST(region_id AS BIGINT) % 3 = 0),
  anc2 AS (SELECT c.server, c.z, c.x, c.y, max(anc_z) AS anc_z FROM climb c JOIN store h ON h.server = c.server AND h.z = c.anc_z
    AND h.x = c.x >> CAST(c.z - c.anc_z AS INT) AND h.y = c.y >> CAST(c.z - c.anc_z AS INT) GROUP BY ALL)
  SELECT request_id, source, CASE WHEN source = 'upscaledAncestor' THEN CAST(anc_z AS INT) END AS anc_z FROM (
    SELECT r.request_id, a.anc_z, CASE WHEN s.z IS NOT NULL THEN 'offlineStore' WHEN k.z IS NOT NULL THEN 'urlCache'
      WHEN r.outcome <> 'network' AND r.z > l.offline_max_z AND a.anc_z IS NOT NULL THEN 'upscaledAncestor' ELSE r.outcome END AS source
    FROM req r JOIN layers l ON l.server = r.server
    LEFT JOIN store s ON s.server = r.server AND s.z = r.z AND s.x = r.x AND s.y = r.y
    LEFT JOIN cache k ON k.server = r.server AND k.z = r.z AND k.x = r.x AND k.y = r.y
    LEFT JOIN anc2 a ON a.server = r.server AND a.z = r.z AND a.x = r.x AND a.y = r.y)""")
def j9(spark, sf):
    tiles = view(spark, sf, "region_tiles")
    number = F.col("region_id").cast("long")
    return ops.tiered_lookup(_requested(spark, sf), tiles.filter(number % 2 == 0), tiles.filter(number % 3 == 0), fixed.layers(spark))


_JOBS = """SELECT CAST(l_suppkey AS VARCHAR(20)) AS region_id, CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_linestatus = 'O' THEN 'open'
    ELSE 'stored' END AS state, CAST(l_quantity AS BIGINT) * 100 AS bytes FROM {lineitem}"""
_REGION_ROWS = """SELECT CAST(s_suppkey AS VARCHAR(20)) AS region_id, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 700 END AS tile_total,
    s_suppkey % 7 = 0 AS write_failed, s_suppkey % 4 = 0 AS cancelled FROM {supplier}"""


@query("A23_region_rollup", f"""SELECT region_id, tile_total, coalesce(tile_done, 0) AS tile_done, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes,
  CASE WHEN tile_total > 0 THEN coalesce(tile_done, 0) / tile_total ELSE 1e0 END AS fraction,
  CASE WHEN write_failed THEN 'failed' WHEN cancelled THEN 'paused' ELSE 'complete' END AS status
  FROM ({_REGION_ROWS.format(supplier='supplier')}) LEFT JOIN (SELECT region_id, count(*) FILTER (WHERE state IN ('stored', 'failed')) AS tile_done,
    sum(bytes) FILTER (WHERE state = 'stored') AS bytes FROM ({_JOBS.format(lineitem='lineitem')}) GROUP BY region_id) USING (region_id)""")
def a23(spark, sf):
    return ops.region_rollup(spark.sql(_JOBS, lineitem=table(spark, sf, "lineitem")),
                             spark.sql(_REGION_ROWS, supplier=table(spark, sf, "supplier")))


@query("A23_stored_bytes", cte("region_tiles") + """SELECT server, count(*) AS tiles, CAST(sum(1000 + x * 7 + y) AS BIGINT) AS bytes
  FROM (SELECT DISTINCT server, z, x, y FROM fx_region_tiles) GROUP BY server""")
def a23b(spark, sf):
    sized = view(spark, sf, "region_tiles").withColumn("bytes", 1000 + F.col("x") * 7 + F.col("y"))
    return ops.stored_bytes(sized)


# Height rasters: the columns and rows that one block of orders covers.
_EXTENTS = """SELECT CAST(floor(o_orderkey / 500.0) AS BIGINT) AS extent_id, min(CAST(o_orderkey % 120 AS BIGINT)) + (CAST(floor(o_orderkey / 500.0) AS BIGINT) * 37) % 300 AS col,
    min(CAST(floor(o_orderkey / 120.0) AS BIGINT)) AS row, max(CAST(o_orderkey % 120 AS BIGINT)) - min(CAST(o_orderkey % 120 AS BIGINT)) + 1 AS width,
    max(CAST(floor(o_orderkey / 120.0) AS BIGINT)) - min(CAST(floor(o_orderkey / 120.0) AS BIGINT)) + 1 AS height FROM {orders} GROUP BY CAST(floor(o_orderkey / 500.0) AS BIGINT)"""
_WINDOWS = """SELECT l_orderkey * 8 + l_linenumber AS window_id, l_partkey % 400 AS col, CAST(floor(l_orderkey / 120.0) AS BIGINT) - 20 AS row,
    1 + l_suppkey % 25 AS width, 1 + l_partkey % 19 AS height FROM {lineitem}"""


def _extents(spark, sf):
    return spark.sql(_EXTENTS, orders=table(spark, sf, "orders"))


@query("J5_window_overlap", f"""SELECT window_id, extent_id, greatest(w.col, e.col) AS col0, greatest(w.row, e.row) AS row0,
  least(w.col + w.width, e.col + e.width) AS col1, least(w.row + w.height, e.row + e.height) AS row1
  FROM ({_WINDOWS.format(lineitem='lineitem')}) w JOIN ({_EXTENTS.format(orders='orders')}) e
  ON w.col < e.col + e.width AND e.col < w.col + w.width AND w.row < e.row + e.height AND e.row < w.row + w.height""")
def j5(spark, sf):
    return ops.overlapping_blocks(spark.sql(_WINDOWS, lineitem=table(spark, sf, "lineitem")), _extents(spark, sf), 64)


@query("A18_mosaic_bounds", f"""SELECT min(col) AS col0, min(row) AS row0, max(col + width) AS col1, max(row + height) AS row1
  FROM ({_EXTENTS.format(orders='orders')})""")
def a18(spark, sf):
    return ops.mosaic_bounds(_extents(spark, sf))


@query("A18_candidate_tiles", f"""WITH e AS ({_EXTENTS.format(orders='orders')}), box AS (SELECT extent_id,
    400000e0 + col * 10e0 AS x0, 400000e0 + (col + width) * 10e0 AS x1, 7400000e0 - (row + height) * 10e0 AS y0, 7400000e0 - row * 10e0 AS y1 FROM e),
  edge AS (SELECT *, i / 21e0 AS t FROM box, (SELECT unnest(range(0, 22)) AS i)),
  rim AS (SELECT extent_id, x0 + (x1 - x0) * t AS px, y0 AS py FROM edge UNION ALL SELECT extent_id, x0 + (x1 - x0) * t, y1 FROM edge
    UNION ALL SELECT extent_id, x0, y0 + (y1 - y0) * t FROM edge UNION ALL SELECT extent_id, x1, y0 + (y1 - y0) * t FROM edge),
  {sqlgeo.unproject_cte('back', 'rim', 'px', 'py')},
  geo AS (SELECT extent_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM back GROUP BY extent_id),
  idx AS (SELECT {sqlgeo.tile_x('w', '14')} AS tx0, {sqlgeo.tile_x('e', '14')} AS tx1, {sqlgeo.tile_y('n', '14')} AS ty0,
    {sqlgeo.tile_y('s', '14')} AS ty1 FROM geo)
  SELECT DISTINCT x, unnest(range(ty0, ty1 + 1)) AS y FROM (SELECT unnest(range(tx0, tx1 + 1)) AS x, ty0, ty1 FROM idx)""")
def a18t(spark, sf):
    return raster_ops.candidate_tiles(_extents(spark, sf), 14, 400_000.0, 7_400_000.0)
