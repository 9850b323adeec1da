"""Route queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfell.functions import fixed, geo
from tarnfell.operators import routes as ops
from tarnfell.plans import sqlgeo
from tarnfell.plans.registry import query
from tarnfell.sources.tables import table
from tarnfell.sources.views import cte, view

SQL_SEGMENTS = """paired AS (SELECT route_id, seq, lat_e5 / 1e5 AS lat, lon_e5 / 1e5 AS lon, lag(lat_e5 / 1e5) OVER w AS lat0,
    lag(lon_e5 / 1e5) OVER w AS lon0 FROM fx_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
  """ + sqlgeo.geodesic_cte("measured", "paired", "lat0", "lon0", "lat", "lon") + """,
  segs AS MATERIALIZED (SELECT *, coalesce(metres, 0e0) AS segment,
    sum(coalesce(metres, 0e0)) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS travelled FROM measured)"""
_SPACING = "(CASE " + " ".join(f"WHEN total / {s}e0 <= 60 THEN {s}e0" for s in fixed.MARKER_SPACINGS) + " ELSE 100000e0 END)"
SQL_TOTAL = SQL_SEGMENTS + """, legs AS (SELECT *, travelled - segment AS before, max(travelled) OVER (PARTITION BY route_id) AS total,
    lead(seq) OVER (PARTITION BY route_id ORDER BY seq) IS NULL AS is_last FROM segs)"""
SQL_SAMPLES = SQL_TOTAL + """, stepped AS (SELECT *, greatest(25e0, total / 499) AS step FROM legs),
  reached AS (SELECT *, least(floor(total / step + 1e-9), 499) AS top FROM stepped),
  samples AS MATERIALIZED (
    SELECT route_id, 0 AS k, 0e0 AS distance, lat, lon FROM reached WHERE lat0 IS NULL
    UNION ALL SELECT route_id, k, k * step, lat0 + (lat - lat0) * ((k * step - before) / segment), lon0 + (lon - lon0) * ((k * step - before) / segment)
      FROM (SELECT *, unnest(range(CAST(floor(before / step + 1e-9) AS BIGINT) + 1, CAST(least(floor(travelled / step + 1e-9), 499) AS BIGINT) + 1)) AS k
        FROM reached WHERE segment > 0)
    UNION ALL SELECT route_id, CAST(top AS BIGINT) + 1, total, lat, lon FROM reached WHERE is_last AND total > 0 AND top + 1 < 500 AND total - top * step > 0.5)"""
SQL_PROFILE = SQL_SAMPLES + f""", keyed AS (SELECT *, CAST(floor(wy) AS BIGINT) % (SELECT max(row) + 1 FROM fx_dem) AS row, CAST(floor(wx) AS BIGINT) % (SELECT max(col) + 1 FROM fx_dem) AS col FROM (
    SELECT route_id, k, distance, (lon + 180e0) / 360e0 * 1048576e0 AS wx,
      (1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 1048576e0 AS wy FROM samples)),
  profile AS MATERIALIZED (SELECT route_id, k, distance, height FROM keyed LEFT JOIN fx_dem USING (row, col))"""


def points(spark, sf):
    return view(spark, sf, "points")


def profile(spark, sf):
    """Samples of every route with the height of the pixel under them, folded onto the extent of the grid."""
    samples = ops.resampled(points(spark, sf))
    pixel = geo.tile_pixel(F.col("lon"), F.col("lat"), 12)
    dem = view(spark, sf, "dem")
    rows, cols = (dem.agg(F.max(c) + 1).scalar() for c in ("row", "col"))
    row = (pixel["tile_y"] * 256 + pixel["px_row"]) % rows
    col = (pixel["tile_x"] * 256 + pixel["px_col"]) % cols
    return ops.sampled_heights(samples, dem, row, col)


@query("W1_segments", cte("points") + f", {SQL_SEGMENTS} SELECT route_id, seq, round(segment, 2) AS segment, round(travelled, 1) AS travelled FROM segs")
def w1(spark, sf):
    return ops.segments(points(spark, sf)).select("route_id", "seq", F.round("segment", 2).alias("segment"), F.round("travelled", 1).alias("travelled"))


@query("A19_route_lengths", cte("points") + f", {SQL_SEGMENTS} SELECT route_id, count(*) AS vertices, round(sum(segment), 1) AS metres FROM segs GROUP BY route_id")
def a19(spark, sf):
    return ops.route_lengths(points(spark, sf)).withColumn("metres", F.round("metres", 1))


@query("A22_route_boxes", cte("points") + """SELECT route_id, min(lat_e5) AS min_lat_e5, min(lon_e5) AS min_lon_e5, max(lat_e5) AS max_lat_e5,
  max(lon_e5) AS max_lon_e5 FROM fx_points GROUP BY route_id""")
def a22(spark, sf):
    return ops.route_boxes(points(spark, sf))


@query("W3_distance_markers", cte("points") + f""", {SQL_TOTAL}, stepped AS (SELECT *, {_SPACING} AS step FROM legs),
  marks AS (SELECT *, unnest(range(CAST(floor(before / step + 1e-9) AS BIGINT) + 1, CAST(floor(travelled / step + 1e-9) AS BIGINT) + 1)) AS k
    FROM stepped WHERE segment > 0 AND total >= step)
  SELECT route_id, k, k * step AS metres, round(lat0 + (lat - lat0) * ((k * step - before) / segment), 6) AS lat,
    round(lon0 + (lon - lon0) * ((k * step - before) / segment), 6) AS lon FROM marks""")
def w3(spark, sf):
    marks = ops.distance_markers(points(spark, sf))
    return marks.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query("W4_resampled", cte("points") + f""", {SQL_SAMPLES} SELECT route_id, CAST(k AS BIGINT) AS k, round(distance, 1) AS distance, round(lat, 6) AS lat,
  round(lon, 6) AS lon FROM samples""")
def w4(spark, sf):
    return ops.resampled(points(spark, sf)).select("route_id", "k", F.round("distance", 1).alias("distance"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("J1_sampled_heights", cte("points", "dem") + f", {SQL_PROFILE} SELECT route_id, CAST(k AS BIGINT) AS k, height FROM profile")
def j1(spark, sf):
    return profile(spark, sf).select("route_id", "k", "height")


SQL_CLIMB = """numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY k) AS i FROM profile),
  fold(route_id, i, ref, up, down) AS (SELECT route_id, i, height, 0e0, 0e0 FROM numbered WHERE i = 1
    UNION ALL SELECT n.route_id, n.i, CASE WHEN n.height IS NULL THEN NULL WHEN f.ref IS NULL OR abs(n.height - f.ref) >= 4 THEN n.height ELSE f.ref END,
      f.up + CASE WHEN n.height - f.ref >= 4 THEN n.height - f.ref ELSE 0e0 END, f.down + CASE WHEN f.ref - n.height >= 4 THEN f.ref - n.height ELSE 0e0 END
    FROM fold f JOIN numbered n ON n.route_id = f.route_id AND n.i = f.i + 1),
  climbs AS (SELECT route_id, max(up) AS ascent, max(down) AS descent FROM fold GROUP BY route_id)"""


@query("A21_ascent_descent", cte("points", "dem") + f", {SQL_PROFILE}, {SQL_CLIMB} SELECT * FROM climbs")
def a21(spark, sf):
    return ops.ascent_descent(profile(spark, sf))


@query("A20_profile_summary", cte("points", "dem") + f""", {SQL_PROFILE}, {SQL_CLIMB}, stats AS (SELECT route_id, count(*) AS points, count(height) / count(*) AS coverage,
    min(height) AS minimum, max(height) AS maximum, max(distance) AS metres FROM profile GROUP BY route_id)
  SELECT route_id, points, round(metres, 1) AS metres, minimum, maximum, coverage, coverage > 0 AND points >= 2 AS has_data,
    coverage > 0 AND points >= 2 AND coverage < 0.95 AS is_partial, round(minimum - greatest((maximum - minimum) * 0.15e0, 10e0), 4) AS axis_low,
    round(maximum + greatest((maximum - minimum) * 0.15e0, 10e0), 4) AS axis_high, ascent, descent FROM stats JOIN climbs USING (route_id)""")
def a20(spark, sf):
    summary = ops.profile_summary(profile(spark, sf))
    for column, digits in (("metres", 1), ("axis_low", 4), ("axis_high", 4)):
        summary = summary.withColumn(column, F.round(column, digits))
    return summary


@query("W2_minimum_spacing", cte("points") + """, numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS i FROM fx_points),
  fold(route_id, i, seq, lat_e5, lon_e5, klat, klon, kept) AS (SELECT route_id, i, seq, lat_e5, lon_e5, lat_e5, lon_e5, true FROM numbered WHERE i = 1
    UNION ALL SELECT n.route_id, n.i, n.seq, n.lat_e5, n.lon_e5,
      CASE WHEN pow(n.lat_e5 - f.klat, 2) + pow(n.lon_e5 - f.klon, 2) >= 2250000 THEN n.lat_e5 ELSE f.klat END,
      CASE WHEN pow(n.lat_e5 - f.klat, 2) + pow(n.lon_e5 - f.klon, 2) >= 2250000 THEN n.lon_e5 ELSE f.klon END,
      pow(n.lat_e5 - f.klat, 2) + pow(n.lon_e5 - f.klon, 2) >= 2250000
    FROM fold f JOIN numbered n ON n.route_id = f.route_id AND n.i = f.i + 1)
  SELECT route_id, seq, lat_e5, lon_e5 FROM fold WHERE kept""")
def w2(spark, sf):
    return ops.minimum_spacing(points(spark, sf), 1500)


@query("W5_stored_profile", """SELECT o_orderkey AS route_id, CAST(k AS INT) AS k, k * (CASE WHEN n > 1 THEN o_totalprice / (n - 1) ELSE 0e0 END) AS distance,
  CASE WHEN (o_custkey + k) % 7 = 0 THEN NULL ELSE CAST((o_custkey * (k + 1)) % 900 AS DOUBLE) END AS elevation
  FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, 1 + o_custkey % 6 AS n FROM orders))""")
def w5(spark, sf):
    routes = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS route_id", "o_totalprice AS metres",
        """transform(sequence(0, cast(o_custkey % 6 as int)), k -> IF((o_custkey + k) % 7 = 0, NULL,
             cast((o_custkey * (k + 1)) % 900 as double))) AS elevations""")
    return ops.stored_profile(routes)


@query("W6_simplified_lines", cte("points") + """, numbered AS MATERIALIZED (SELECT route_id, seq, lat_e5, lon_e5, CAST(lon_e5 AS DOUBLE) AS x, CAST(lat_e5 AS DOUBLE) AS y,
    row_number() OVER (PARTITION BY route_id ORDER BY seq) AS i FROM fx_points),
  spans(route_id, lo, hi) AS (SELECT route_id, CAST(1 AS BIGINT), max(i) FROM numbered GROUP BY route_id
    UNION ALL SELECT route_id, unnest([lo, cut]), unnest([cut, hi]) FROM (
      SELECT route_id, lo, hi, arg_max(i, {'off': off, 'turn': -i}) AS cut, max(off) AS worst FROM (
        SELECT *, sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) AS off FROM (
          SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM (
            SELECT s.route_id, s.lo, s.hi, p.i, p.x - a.x AS px, p.y - a.y AS py, b.x - a.x AS dx, b.y - a.y AS dy FROM spans s
              JOIN numbered a ON a.route_id = s.route_id AND a.i = s.lo JOIN numbered b ON b.route_id = s.route_id AND b.i = s.hi
              JOIN numbered p ON p.route_id = s.route_id AND p.i > s.lo AND p.i < s.hi)))
      GROUP BY route_id, lo, hi) WHERE worst > 600),
  kept AS (SELECT route_id, lo AS i FROM spans UNION SELECT route_id, hi FROM spans)
  SELECT route_id, seq, lat_e5, lon_e5 FROM numbered JOIN kept USING (route_id, i)""")
def w6(spark, sf):
    return ops.simplified(points(spark, sf), 600.0)


_LOG = """SELECT user_id AS route_id, event_id AS seq,
    CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_type IN ('click', 'error') THEN 'undo' ELSE 'append' END AS op,
    CAST(1 + event_id % 5 AS INT) AS size FROM {events}"""


@query("M5_surviving_strokes", f"""WITH RECURSIVE log AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS i FROM ({_LOG.format(events='events')})),
  fold(route_id, i, stack) AS (SELECT route_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(seq BIGINT, size INT)[]) FROM log GROUP BY route_id
    UNION ALL SELECT l.route_id, l.i, CASE WHEN op = 'clear' THEN CAST([] AS STRUCT(seq BIGINT, size INT)[])
      WHEN op = 'undo' THEN stack[1:len(stack) - 1] WHEN size >= 2 THEN list_append(stack, {{'seq': seq, 'size': size}}) ELSE stack END
    FROM fold f JOIN log l ON l.route_id = f.route_id AND l.i = f.i + 1),
  ended AS (SELECT route_id, stack FROM fold QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY i DESC) = 1)
  SELECT route_id, s.seq AS seq, s.size AS size FROM (SELECT route_id, unnest(stack) AS s FROM ended)""")
def m5(spark, sf):
    return ops.surviving_strokes(spark.sql(_LOG, events=table(spark, sf, "events")))


_CATALOGUE = """SELECT route_id, route_id % 97 + CAST(floor(n / 3.0) AS BIGINT) * 1000 AS catalogue_id, round(metres * (1 + (route_id % 5) / 200e0), 1) AS metres, n,
    CASE WHEN route_id % 7 = 0 THEN 0e0 ELSE 120e0 END AS ascent FROM {lengths}"""


@query("Q5_catalogue_problems", cte("points") + f""", {SQL_SEGMENTS}, lengths AS (SELECT route_id, count(*) AS n, sum(segment) AS metres FROM segs GROUP BY route_id),
  cat AS ({_CATALOGUE.format(lengths='lengths')}), j AS (SELECT c.*, l.n AS vertices, l.metres AS measured,
    count(*) OVER (PARTITION BY catalogue_id) AS copies FROM cat c JOIN lengths l USING (route_id))
  SELECT route_id, 'duplicate id' AS problem FROM j WHERE copies > 1 UNION ALL SELECT route_id, 'no geometry' FROM j WHERE vertices < 2
  UNION ALL SELECT route_id, 'length drift' FROM j WHERE vertices >= 2 AND coalesce(abs(measured - metres) / nullif(metres, 0) >= 0.01, true)
  UNION ALL SELECT route_id, 'stroke sizes' FROM j WHERE route_id % 11 = 0
  UNION ALL SELECT route_id, 'too many heights' FROM j WHERE 400 + route_id % 200 > 500
  UNION ALL SELECT route_id, 'no heights' FROM j WHERE route_id % 13 = 0 UNION ALL SELECT route_id, 'no ascent' FROM j WHERE ascent <= 0""")
def q5(spark, sf):
    vertices = points(spark, sf)
    lengths = ops.route_lengths(vertices).withColumnRenamed("vertices", "n")
    catalogue = spark.sql(_CATALOGUE, lengths=lengths).selectExpr(
        "*", "array(cast(n as int) - 1, IF(route_id % 11 = 0, 2, 1)) AS stroke_sizes",
        "array_repeat(IF(route_id % 13 = 0, cast(NULL as double), 300e0), cast(400 + route_id % 200 as int)) AS elevations")
    return ops.catalogue_problems(catalogue, vertices)
