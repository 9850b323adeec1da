"""Raster queries on cells tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfell.functions import fixed
from tarnfell.operators import raster as ops
from tarnfell.plans import sqlgeo
from tarnfell.plans.registry import query
from tarnfell.sources.tables import table
from tarnfell.sources.views import cte, view

OX, OY = 400_000.0, 7_400_000.0
SMALL = 16


def sql_slopes(name: str, src: str) -> str:
    """CTEs ending in ``name``: row, col, height, slope, class of the cells of ``src``."""
    weights = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
    offsets = ", ".join(f"({dr}, {dc}, {dc * (2 - abs(dr))}, {dr * (2 - abs(dc))})" for dr, dc in weights)
    return f"""{name}_w AS (SELECT * FROM (VALUES {offsets}) AS t(dr, dc, wx, wy)),
      {name}_g AS (SELECT s.row + dr AS row, s.col + dc AS col, sum(-wx * height) AS gx, sum(-wy * height) AS gy, count(height) AS n
        FROM {src} s, {name}_w GROUP BY 1, 2),
      {name}_s AS (SELECT c.row, c.col, c.height, CASE WHEN n = 8 THEN
          degrees(atan(sqrt((gx / 80e0) * (gx / 80e0) + (gy / 80e0) * (gy / 80e0)))) END AS slope
        FROM {src} c LEFT JOIN {name}_g g ON g.row = c.row AND g.col = c.col),
      {name} AS (SELECT *, CASE WHEN slope IS NULL OR height IS NULL THEN 0 WHEN slope >= 50 THEN 5 WHEN slope >= 45 THEN 4
        WHEN slope >= 40 THEN 3 WHEN slope >= 35 THEN 2 WHEN slope >= 30 THEN 1 ELSE 0 END AS class FROM {name}_s)"""


def dem(spark, sf):
    return view(spark, sf, "dem")


_PARTS = """SELECT row, col, height, concat('t', CAST(CAST(floor(row / 40.0) AS INT) AS VARCHAR(20))) AS path FROM {dem}
  UNION ALL SELECT row, col, height, concat('u', CAST(CAST(floor((row + 20) / 40.0) AS INT) AS VARCHAR(20))) FROM {truth} WHERE row % 40 >= 20 OR col < 30"""


@query("R1_mosaic", cte("dem", "truth") + f"""SELECT row, col, height FROM (SELECT *, row_number() OVER (PARTITION BY row, col
  ORDER BY path DESC) AS rn FROM ({_PARTS.format(dem='fx_dem', truth='fx_truth')})) WHERE rn = 1""")
def r1(spark, sf):
    return ops.mosaic(spark.sql(_PARTS, dem=dem(spark, sf), truth=view(spark, sf, "truth")))


@query("R2_horn_slope", cte("dem") + f", {sql_slopes('sl', 'fx_dem')} SELECT row, col, height, round(slope, 6) AS slope FROM sl")
def r2(spark, sf):
    found = ops.horn_slope(dem(spark, sf))
    return found.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "height", F.round("slope", 6).alias("slope"))


@query("R3_slope_class", cte("dem") + f", {sql_slopes('sl', 'fx_dem')} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, class FROM sl")
def r3(spark, sf):
    return ops.slope_classes(dem(spark, sf))


def _extent(spark, sf):
    """One extent per 64 rows of the grid."""
    return dem(spark, sf).groupBy(F.floor(F.col("row") / 64).alias("extent_id")).agg(
        F.min("col").alias("col"), F.min("row").alias("row"), (F.max("col") - F.min("col") + 1).alias("width"),
        (F.max("row") - F.min("row") + 1).alias("height"))


def sql_pixels(z: int) -> str:
    """CTEs ending in ``pix``: x, y, px_row, px_col, gx, gy."""
    span = f"(2e0 * {sqlgeo.SPAN} / {float(1 << z)}e0)"
    return f"""ext AS (SELECT floor(row / 64) AS extent_id, {OX}e0 + min(col) * 10e0 AS x0, {OX}e0 + (max(col) + 1) * 10e0 AS x1,
      {OY}e0 - (max(row) + 1) * 10e0 AS y0, {OY}e0 - min(row) * 10e0 AS y1 FROM fx_dem GROUP BY 1),
    edge AS (SELECT *, i / 21e0 AS t FROM ext, (SELECT unnest(range(0, 22)) AS i)),
    rim AS (SELECT extent_id, x0 + (x1 - x0) * t AS px, y0 AS py FROM edge UNION ALL SELECT extent_id, x0 + (x1 - x0) * t, y1 FROM edge
      UNION ALL SELECT extent_id, x0, y0 + (y1 - y0) * t FROM edge UNION ALL SELECT extent_id, x1, y0 + (y1 - y0) * t FROM edge),
    {sqlgeo.unproject_cte('back', 'rim', 'px', 'py')},
    lim AS (SELECT extent_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM back GROUP BY extent_id),
    idx AS (SELECT {sqlgeo.tile_x('w', str(z))} AS tx0, {sqlgeo.tile_x('e', str(z))} AS tx1, {sqlgeo.tile_y('n', str(z))} AS ty0,
      {sqlgeo.tile_y('s', str(z))} AS ty1 FROM lim),
    cand AS (SELECT DISTINCT x, unnest(range(ty0, ty1 + 1)) AS y FROM (SELECT unnest(range(tx0, tx1 + 1)) AS x, ty0, ty1 FROM idx)),
    grid AS (SELECT x, y, px_row, unnest(range(0, 256)) AS px_col FROM (SELECT x, y, unnest(range(0, 256)) AS px_row FROM cand)),
    placed AS (SELECT x, y, px_row, px_col, ((x + (px_col + 0.5e0) / 256) * {span} - {sqlgeo.SPAN}) / {sqlgeo.SPAN} * 180e0 AS plon,
      degrees(2e0 * atan(exp(({sqlgeo.SPAN} - (y + (px_row + 0.5e0) / 256) * {span}) / {sqlgeo.SPAN} * pi())) - pi() / 2e0) AS plat FROM grid),
    {sqlgeo.project_cte('prj', 'placed', 'plon', 'plat')},
    pix AS (SELECT x, y, CAST(px_row AS INT) AS px_row, CAST(px_col AS INT) AS px_col, (easting - {OX}e0) / 10e0 AS gx,
      ({OY}e0 - northing) / 10e0 AS gy FROM prj)"""


def _pixels(spark, sf, z):
    return ops.tile_pixels(ops.candidate_tiles(_extent(spark, sf), z, OX, OY), z, OX, OY)


@query("R4_nearest_warp", cte("dem") + f""", {sql_slopes('sl', 'fx_dem')}, {sql_pixels(13)}
  SELECT x, y, px_row, px_col, class FROM pix JOIN sl ON sl.row = floor(gy) AND sl.col = floor(gx)""")
def r4(spark, sf):
    return ops.nearest_warp(_pixels(spark, sf, 13), ops.slope_classes(dem(spark, sf)), "class")


@query("R5_bilinear_warp", cte("dem") + f""", {sql_pixels(12)}, near AS (SELECT x, y, px_row, px_col,
    (CASE WHEN dc = 1 THEN gx - 0.5e0 - floor(gx - 0.5e0) ELSE 1 - (gx - 0.5e0 - floor(gx - 0.5e0)) END)
    * (CASE WHEN dr = 1 THEN gy - 0.5e0 - floor(gy - 0.5e0) ELSE 1 - (gy - 0.5e0 - floor(gy - 0.5e0)) END) AS w,
    floor(gy - 0.5e0) + dr AS row, floor(gx - 0.5e0) + dc AS col FROM pix, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(dr, dc))
  SELECT x, y, px_row, px_col, round(sum(w * height) / sum(w), 4) AS height FROM near JOIN fx_dem USING (row, col)
  WHERE height IS NOT NULL GROUP BY x, y, px_row, px_col""")
def r5(spark, sf):
    warped = ops.bilinear_warp(_pixels(spark, sf, 12), dem(spark, sf))
    return warped.withColumn("height", F.round("height", 4))


@query("R6_area_average", cte("dem") + """, spread AS (SELECT d.dr AS row, e.dc AS col, height,
    (least(row * 8 + 8, d.dr * 10 + 10) - greatest(row * 8, d.dr * 10)) * (least(col * 8 + 8, e.dc * 10 + 10) - greatest(col * 8, e.dc * 10)) AS w
    FROM (SELECT *, unnest(range(CAST(floor(row * 8 / 10e0) AS BIGINT), CAST(floor((row * 8 + 7) / 10e0) AS BIGINT) + 1)) AS dr FROM fx_dem) d,
    LATERAL (SELECT unnest(range(CAST(floor(d.col * 8 / 10e0) AS BIGINT), CAST(floor((d.col * 8 + 7) / 10e0) AS BIGINT) + 1)) AS dc) e)
  SELECT row, col, round(sum(w * height) / sum(w), 6) AS height FROM spread WHERE height IS NOT NULL GROUP BY row, col""")
def r6(spark, sf):
    return ops.area_average(dem(spark, sf)).withColumn("height", F.round("height", 6))


@query("R7_tile_positions", cte("dem") + f"""SELECT row, col, height, CAST(row // {SMALL * 8} AS BIGINT) AS block_row,
  CAST(col // {SMALL * 8} AS BIGINT) AS block_col, CAST(row // {SMALL} AS BIGINT) AS tile_row, CAST(col // {SMALL} AS BIGINT) AS tile_col,
  row % {SMALL} AS px_row, col % {SMALL} AS px_col FROM fx_dem""")
def r7(spark, sf):
    return ops.tile_positions(dem(spark, sf), SMALL)


def _classed(spark, sf):
    found = ops.horn_slope(dem(spark, sf))
    return found.withColumn("class", ops.slope_class(F.col("slope"), F.col("height")))


@query("R8_tile_contents", cte("dem") + f""", {sql_slopes('sl', 'fx_dem')} SELECT CAST(row // {SMALL} AS BIGINT) AS tile_row,
  CAST(col // {SMALL} AS BIGINT) AS tile_col, count(height) AS known, count(*) FILTER (WHERE class > 0) AS steep, count(height) > 0 AS write_heights,
  count(*) FILTER (WHERE class > 0) > 0 AS write_slopes FROM sl GROUP BY 1, 2""")
def r8(spark, sf):
    return ops.tile_contents(_classed(spark, sf), SMALL)


@query("R9_coverage_mask", cte("dem") + f""", {sql_pixels(13)}
  SELECT x, y, px_row, px_col FROM pix JOIN fx_dem d ON d.row = floor(gy) AND d.col = floor(gx) WHERE height IS NOT NULL""")
def r9(spark, sf):
    known = dem(spark, sf).filter("height IS NOT NULL")
    return ops.nearest_warp(_pixels(spark, sf, 13), known, "height").drop("height")


@query("R10_overview_pyramid", cte("dem") + f""", {sql_slopes('sl', 'fx_dem')}
  SELECT z, CAST(row >> (13 - z) AS BIGINT) AS row, CAST(col >> (13 - z) AS BIGINT) AS col, max(class) AS class
  FROM sl, (SELECT CAST(unnest(range(7, 14)) AS INT) AS z) WHERE class > 0 GROUP BY 1, 2, 3""")
def r10(spark, sf):
    return ops.overview_pyramid(ops.slope_classes(dem(spark, sf)), 13, 7)


@query("R11_magnified_labels", cte("dem") + """SELECT row * 2 + dr AS row, col * 2 + dc AS col, height FROM fx_dem,
  (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(dr, dc)""")
def r11(spark, sf):
    return ops.magnified(dem(spark, sf), 1, "height")


# --------------------------------------------------------------- layers side by side

@query("J10_border_fill", cte("dem", "truth") + """SELECT row, col, coalesce(n.height, o.height) AS height
  FROM (SELECT * FROM fx_dem WHERE col < 70) n FULL OUTER JOIN (SELECT * FROM fx_truth WHERE col > 40) o USING (row, col)""")
def j10(spark, sf):
    return ops.border_fill(dem(spark, sf).filter("col < 70"), view(spark, sf, "truth").filter("col > 40").drop("datakilde"))


_TERRAIN = "(" + ", ".join(f"'{s}'" for s in fixed.TERRAIN_SOURCES) + ")"
SQL_COMPARED = f"""compared AS (SELECT d.row, d.col, datakilde, CASE WHEN t.height IS NULL THEN 'missing'
    WHEN datakilde NOT IN {_TERRAIN} THEN 'skipped' ELSE 'compared' END AS outcome,
    CASE WHEN t.height IS NOT NULL AND datakilde IN {_TERRAIN} THEN abs(t.height - d.height) END AS difference
  FROM fx_dem d LEFT JOIN fx_truth t USING (row, col) WHERE d.height IS NOT NULL)"""


@query("J11_compared_heights", cte("dem", "truth") + f", {SQL_COMPARED} SELECT * FROM compared")
def j11(spark, sf):
    return ops.compared_heights(dem(spark, sf), view(spark, sf, "truth"))


@query("A15_error_report", cte("dem", "truth") + f""", {SQL_COMPARED}, scoped AS (SELECT 'all' AS scope, difference FROM compared
    WHERE outcome = 'compared' UNION ALL SELECT datakilde, difference FROM compared WHERE outcome = 'compared')
  SELECT scope, count(*) AS n, round(quantile_cont(difference, 0.5), 6) AS median, round(quantile_cont(difference, 0.9), 6) AS p90,
    round(quantile_cont(difference, 0.99), 6) AS p99, max(difference) AS max,
    quantile_cont(difference, 0.5) <= 2 AND quantile_cont(difference, 0.9) <= 8 AS passed FROM scoped GROUP BY scope""")
def a15(spark, sf):
    report = ops.error_report(ops.compared_heights(dem(spark, sf), view(spark, sf, "truth")))
    return report.select("scope", "n", *[F.round(c, 6).alias(c) for c in ("median", "p90", "p99")], "max", "passed")


_COLOUR = {i: c for i, c in enumerate(fixed.PALETTE)}


def _sql_channel(k):
    cases = " ".join(f"WHEN {i} THEN {c[k]}" for i, c in _COLOUR.items())
    return (f"CASE WHEN (row * 120 + col) % 29 = 0 THEN {fixed.RUNOUT_COLOURS[0][k]} WHEN (row * 120 + col) % 31 = 0 THEN 17 "
            f"ELSE CASE class {cases} END END")


_PAINT = f"""SELECT row, col, {_sql_channel(0)} AS r, {_sql_channel(1)} AS g, {_sql_channel(2)} AS b,
    CASE WHEN class = 0 AND (row * 120 + col) % 29 <> 0 THEN 0 ELSE 255 END AS a, (row * 120 + col) % 5 <> 4 AS land FROM {{classes}}"""
_SQL_CLASS_OF = "CASE " + " ".join(
    f"WHEN r = {c[0]} AND g = {c[1]} AND b = {c[2]}{' AND a = 0' if i == 0 else ''} THEN {i}" for i, c in _COLOUR.items()) + " ELSE -1 END"
_SQL_RUNOUT = " OR ".join(f"(r = {c[0]} AND g = {c[1]} AND b = {c[2]})" for c in fixed.RUNOUT_COLOURS)
SQL_PAIRS = f"""{sql_slopes('sl', 'fx_dem')}, tcells AS (SELECT row, col, height FROM fx_truth), {sql_slopes('st', 'tcells')},
  painted AS ({_PAINT.format(classes='st')}),
  both_sides AS (SELECT sl.row // 32 AS tile_row, sl.col // 32 AS tile_col, sl.class AS our_class, {_SQL_CLASS_OF} AS their_class
    FROM sl JOIN painted p ON p.row = sl.row AND p.col = sl.col WHERE sl.height IS NOT NULL AND land AND NOT ({_SQL_RUNOUT}) AND {_SQL_CLASS_OF} >= 0),
  enough AS (SELECT tile_row, tile_col, count(*) AS usable FROM both_sides GROUP BY 1, 2 HAVING count(*) >= 500),
  matrix AS (SELECT their_class, our_class, count(*) AS n FROM both_sides JOIN enough USING (tile_row, tile_col) GROUP BY 1, 2)"""


def _pairs(spark, sf):
    ours = _classed(spark, sf).select("row", "col", "class", F.col("height").isNotNull().alias("covered"))
    theirs = spark.sql(_PAINT, classes=ops.slope_classes(view(spark, sf, "truth").drop("datakilde")))
    return ops.usable_pairs(ours, theirs, 32)


@query("J12_usable_class_pairs", cte("dem", "truth") + f""", {SQL_PAIRS} SELECT CAST(tile_row AS BIGINT) AS tile_row, CAST(tile_col AS BIGINT) AS tile_col,
  their_class, our_class, count(*) AS n, usable FROM both_sides JOIN enough USING (tile_row, tile_col) GROUP BY ALL""")
def j12(spark, sf):
    return _pairs(spark, sf)


@query("A16_confusion_matrix", cte("dem", "truth") + f", {SQL_PAIRS} SELECT their_class, our_class, n FROM matrix")
def a16(spark, sf):
    return ops.confusion(_pairs(spark, sf))


@query("A16_agreement", cte("dem", "truth") + f""", {SQL_PAIRS} SELECT CAST(sum(n) AS BIGINT) AS total,
  round(100e0 * sum(n) FILTER (WHERE their_class = our_class) / sum(n), 4) AS exact_pct,
  round(100e0 * sum(n) FILTER (WHERE abs(their_class - our_class) <= 1) / sum(n), 4) AS within_one_pct,
  round(100e0 * sum(n) FILTER (WHERE their_class > 0) / sum(n), 4) AS steep_theirs_pct,
  round(100e0 * sum(n) FILTER (WHERE our_class > 0) / sum(n), 4) AS steep_ours_pct,
  round(100e0 * sum(n) FILTER (WHERE their_class = our_class) / sum(n), 4) >= 85 AS passed FROM matrix""")
def a16b(spark, sf):
    return ops.agreement(ops.confusion(_pairs(spark, sf)))


@query("J13_colour_class", cte("pixels") + f"SELECT tile_id, px, sub, {_SQL_CLASS_OF} AS class FROM fx_pixels")
def j13(spark, sf):
    return view(spark, sf, "pixels").select("tile_id", "px", "sub", ops.colour_class(*[F.col(c) for c in "rgba"]).alias("class"))


_FILL = "(r > 250 AND g > 250 AND b BETWEEN 222 AND 240)"


@query("P14_recoloured_pixels", cte("pixels") + f"""SELECT tile_id, px, sub, {_FILL} AS changed,
  {', '.join(f'CASE WHEN {_FILL} THEN 0 ELSE {c} END AS {c}' for c in 'rgba')} FROM fx_pixels""")
def p14(spark, sf):
    return ops.recoloured(view(spark, sf, "pixels"))


@query("P14_changed_tiles", cte("pixels") + f"SELECT tile_id, bool_or({_FILL}) AS changed FROM fx_pixels GROUP BY tile_id")
def p14t(spark, sf):
    return ops.changed_tiles(view(spark, sf, "pixels"))


@query("A17_picked_overview", """SELECT o_orderkey, CAST(CASE WHEN best IS NOT NULL THEN list_position(f, best) - 1 END AS BIGINT) AS level FROM (
  SELECT o_orderkey, f, list_max(list_filter(f, lambda v: v <= 8)) AS best FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN [3, 6, 12]
    WHEN o_custkey % 5 = 1 THEN [16, 32] ELSE [2, 4, 8, 16, 32][1:o_orderkey % 6] END AS f FROM orders))""")
def a17(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", """CASE WHEN o_custkey % 5 = 0 THEN array(3, 6, 12)
        WHEN o_custkey % 5 = 1 THEN array(16, 32) ELSE slice(array(2, 4, 8, 16, 32), 1, cast(o_orderkey % 6 as int)) END AS f""")
    return rows.select("o_orderkey", ops.picked_overview(F.col("f")).alias("level"))


# --------------------------------------------------------------- samples

_EDGE_TILES = "SELECT DISTINCT z * 1000000 + x * 64 + server AS x, y * 7 + z AS y FROM {tiles}"


@query("W7_leading_edge", cte("region_tiles") + f""", t AS ({_EDGE_TILES.format(tiles='fx_region_tiles')}),
  k AS (SELECT greatest(1, 60 // count(DISTINCT y)) AS k, count(DISTINCT y) AS n FROM t),
  edge AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY x) AS rn FROM t), k WHERE rn <= k),
  numbered AS (SELECT *, row_number() OVER (ORDER BY y, x) - 1 AS i, count(*) OVER () AS total FROM edge)
  SELECT x, y FROM numbered WHERE total <= 60 OR i IN (SELECT CAST(floor(j * (total / 60e0)) AS BIGINT) FROM (SELECT unnest(range(0, 60)) AS j), (SELECT count(*) AS total FROM edge))""")
def w7(spark, sf):
    tiles = spark.sql(_EDGE_TILES, tiles=view(spark, sf, "region_tiles"))
    return ops.leading_edge(tiles, 60)


@query("W8_seeded_sample", cte("dem") + f""", known AS (SELECT row // {SMALL} AS tile_row, col // {SMALL} AS tile_col, row, col, height FROM fx_dem WHERE height IS NOT NULL),
  picked AS (SELECT tile_row, tile_col FROM (SELECT DISTINCT tile_row, tile_col FROM known)
    ORDER BY md5(concat('1/', tile_row, '/', tile_col)), tile_row, tile_col LIMIT 120)
  SELECT CAST(tile_row AS BIGINT) AS tile_row, CAST(tile_col AS BIGINT) AS tile_col, row, col, height FROM (SELECT k.*, row_number() OVER (PARTITION BY tile_row, tile_col
    ORDER BY md5(concat('1/', row, '/', col)), row, col) AS rn FROM known k JOIN picked USING (tile_row, tile_col)) WHERE rn <= 10""")
def w8(spark, sf):
    return ops.seeded_sample(dem(spark, sf), 120, 10, SMALL, 1)
