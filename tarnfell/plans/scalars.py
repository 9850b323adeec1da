"""Geospatial scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfell.functions import fixed, geo
from tarnfell.operators import regions as region_ops
from tarnfell.plans import sqlgeo
from tarnfell.plans.registry import query
from tarnfell.sources.views import cte, view



def _lat():
    return F.col("lat_e5") / 1e5


def _lon():
    return F.col("lon_e5") / 1e5


SQL_LAT, SQL_LON = "(lat_e5 / 1e5)", "(lon_e5 / 1e5)"
SQL_REGIONS = """regions AS (SELECT adm, kind, min(lat_e5) AS lat0, max(lat_e5) AS lat1, min(lon_e5) AS lon0,
    max(lon_e5) AS lon1 FROM fx_places GROUP BY adm, kind)"""


@query("G1_tile_index", cte("points") + f"""SELECT seq, z, {sqlgeo.tile_x(SQL_LON, 'z')} AS x,
  {sqlgeo.tile_y(SQL_LAT, 'z')} AS y FROM (SELECT *, CAST(7 + seq % 8 AS INT) AS z FROM fx_points)""")
def g1(spark, sf):
    z = (7 + F.col("seq") % 8).cast("int")
    x, y = geo.tile_xy(_lon(), _lat(), z)
    return view(spark, sf, "points").select("seq", z.alias("z"), x.alias("x"), y.alias("y"))


@query("G2_tile_bounds", cte("region_tiles") + f"""SELECT z, x, y,
  round("left", 2) AS "left", round(top - span, 2) AS bottom, round("left" + span, 2) AS "right", round(top, 2) AS top,
  round(("left" + 0.5e0 * span / 256) / {sqlgeo.SPAN} * 180e0, 6) AS pixel_lon,
  round(degrees(2e0 * atan(exp((top - 0.5e0 * span / 256) / {sqlgeo.SPAN} * pi())) - pi() / 2e0), 6) AS pixel_lat
  FROM (SELECT *, x * span - {sqlgeo.SPAN} AS "left", {sqlgeo.SPAN} - y * span AS top
    FROM (SELECT DISTINCT z, x, y, 2e0 * {sqlgeo.SPAN} / pow(2, z) AS span FROM fx_region_tiles))""")
def g2(spark, sf):
    tiles = view(spark, sf, "region_tiles").select("z", "x", "y").distinct()
    bounds = geo.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    lon, lat = geo.pixel_centre(F.col("z"), F.col("x"), F.col("y"), F.lit(0), F.lit(0))
    return tiles.select("z", "x", "y", *[F.round(c, 2).alias(k) for k, c in bounds.items()],
                        F.round(lon, 6).alias("pixel_lon"), F.round(lat, 6).alias("pixel_lat"))


@query("G3_tile_pixel", cte("points") + f"""SELECT seq, tile_x, tile_y,
  CAST(greatest(least(floor(wy) - tile_y * 256, 255), 0) AS BIGINT) AS px_row,
  CAST(greatest(least(floor(wx) - tile_x * 256, 255), 0) AS BIGINT) AS px_col
  FROM (SELECT seq, {sqlgeo.tile_x(SQL_LON, '12')} AS tile_x, {sqlgeo.tile_y(SQL_LAT, '12')} AS tile_y,
    ({SQL_LON} + 180e0) / 360e0 * 1048576e0 AS wx,
    (1e0 - ln(tan(radians({SQL_LAT})) + 1e0 / cos(radians({SQL_LAT}))) / pi()) / 2e0 * 1048576e0 AS wy FROM fx_points)""")
def g3(spark, sf):
    return view(spark, sf, "points").select("seq", *[c.alias(k) for k, c in geo.tile_pixel(_lon(), _lat(), 12).items()])


@query("G4_projection", cte("places") + ", deg AS (SELECT place_id, lon_e5 / 1e5 AS lon0, lat_e5 / 1e5 AS lat0 FROM fx_places), "
       + sqlgeo.project_cte("prj", "deg", "lon0", "lat0") + ", " + sqlgeo.unproject_cte("back", "prj", "easting", "northing") +
       """ SELECT place_id, round(easting, 2) AS easting, round(northing, 2) AS northing, round(lon, 6) AS lon,
       round(lat, 6) AS lat FROM back""")
def g4(spark, sf):
    east, north = geo.project(_lon(), _lat())
    flat = view(spark, sf, "places").select("place_id", east.alias("easting"), north.alias("northing"))
    lon, lat = geo.unproject(F.col("easting"), F.col("northing"))
    return flat.select("place_id", F.round("easting", 2).alias("easting"), F.round("northing", 2).alias("northing"),
                       F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("G5_projected_bbox", cte("places") + f""", {SQL_REGIONS}, edge AS (SELECT adm, kind, lon0 / 1e5 AS x0, lon1 / 1e5 AS x1,
    lat0 / 1e5 AS y0, lat1 / 1e5 AS y1, i / 64e0 AS t FROM regions, (SELECT unnest(range(0, 65)) AS i)),
  rim AS (SELECT adm, kind, x0 + (x1 - x0) * t AS px, y0 AS py FROM edge UNION ALL
    SELECT adm, kind, x0 + (x1 - x0) * t, y1 FROM edge UNION ALL
    SELECT adm, kind, x0, y0 + (y1 - y0) * t FROM edge UNION ALL SELECT adm, kind, x1, y0 + (y1 - y0) * t FROM edge),
  {sqlgeo.project_cte('prj', 'rim', 'px', 'py')}
  SELECT adm, kind, round(min(easting), 2) AS min_x, round(min(northing), 2) AS min_y, round(max(easting), 2) AS max_x,
    round(max(northing), 2) AS max_y FROM prj GROUP BY adm, kind""")
def g5(spark, sf):
    boxes = region_ops.place_regions(view(spark, sf, "places"))
    return region_ops.projected_bbox(boxes, ["adm", "kind"], 64).select(
        "adm", "kind", *[F.round(c, 2).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query("G6_geodesic_distance", cte("points") + """, legs AS (SELECT seq, lat_e5 / 1e5 AS a1, lon_e5 / 1e5 AS o1,
    6523456 / 1e5 AS a2, 1812345 / 1e5 AS o2 FROM fx_points), """ + sqlgeo.geodesic_cte("dist", "legs", "a1", "o1", "a2", "o2") +
       " SELECT seq, round(metres, 2) AS metres FROM dist")
def g6(spark, sf):
    metres = geo.geodesic_m(_lat(), _lon(), F.lit(6523456) / 1e5, F.lit(1812345) / 1e5)
    return view(spark, sf, "points").select("seq", F.round(metres, 2).alias("metres"))


@query("G7_grid_window", cte("places") + """SELECT place_id, CAST(floor((l - 0) / 10e0) AS BIGINT) AS col,
  CAST(floor((8e6 - t) / 10e0) AS BIGINT) AS row, CAST(ceil(r / 10e0) - floor(l / 10e0) AS BIGINT) AS width,
  CAST(ceil((8e6 - b) / 10e0) - floor((8e6 - t) / 10e0) AS BIGINT) AS height
  FROM (SELECT place_id, lon_e5 / 4e0 AS l, lat_e5 / 1e0 AS b, lon_e5 / 4e0 + 333.3e0 * (1 + kind) AS r,
    lat_e5 + 777.7e0 * (1 + rank) AS t FROM fx_places)""")
def g7(spark, sf):
    boxes = view(spark, sf, "places").selectExpr(
        "place_id", "lon_e5 / 4e0 AS l", "lat_e5 / 1e0 AS b", "lon_e5 / 4e0 + 333.3e0 * (1 + kind) AS r",
        "lat_e5 + 777.7e0 * (1 + rank) AS t")
    window = geo.grid_window(F.col("l"), F.col("b"), F.col("r"), F.col("t"))
    return boxes.select("place_id", *[c.cast("long").alias(k) for k, c in window.items()])


_LEGS = """SELECT seq, lat_e5 / 1e5 AS lat1, lat_e5 / 1e5 + 0.5e0 AS lat2, (seq * 37001 % 360000) / 1e3 - 180e0 AS lon1,
    (seq * 91009 % 360000) / 1e3 - 180e0 AS lon2, (seq % 11) / 1e1 AS t FROM {points}"""


@query("G8_wrapped_points", cte("points") + f"""SELECT seq, round(lat1 + (lat2 - lat1) * t, 9) AS lat,
    round(CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END, 9) AS lon FROM (
      SELECT *, lon1 + (CASE WHEN lon2 - lon1 > 180 THEN lon2 - lon1 - 360 WHEN lon2 - lon1 < -180 THEN lon2 - lon1 + 360 ELSE lon2 - lon1 END) * t AS lon
      FROM ({_LEGS.format(points='fx_points')}))""")
def g8(spark, sf):
    legs = spark.sql(_LEGS, points=view(spark, sf, "points"))
    lat, lon = geo.wrapped_lerp(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2", "t")])
    return legs.select("seq", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("G9_zoom_and_scale", cte("places") + """SELECT place_id,
  round(CASE WHEN span > 0 AND w > 0 THEN log2(360e0 * (w / 256e0) / nullif(span, 0)) ELSE 0 END, 6) AS zoom,
  round(span * (cos(lat_e5 / 1e5 * pi() / 180e0) * 111319.5e0) / w, 4) AS metres_per_point
  FROM (SELECT *, (place_id % 400) / 100e0 AS span, 320e0 + kind * 40 AS w FROM fx_places)""")
def g9(spark, sf):
    places = view(spark, sf, "places").selectExpr("*", "(place_id % 400) / 100e0 AS span", "320e0 + kind * 40 AS w")
    span, width = F.col("span"), F.col("w")
    return places.select("place_id", F.round(geo.zoom_level(span, width), 6).alias("zoom"),
                         F.round(geo.metres_per_point(_lat(), span, width), 4).alias("metres_per_point"))


def _sql_spacing(m):
    whens = " ".join(f"WHEN {m} / {sqlgeo.num(s)} <= 60 THEN {sqlgeo.num(s)}" for s in fixed.MARKER_SPACINGS)
    return f"(CASE {whens} ELSE 100000e0 END)"


@query("G10_marker_spacing", cte("requests") + f"""SELECT request_id, {_sql_spacing('m')} AS by_length,
  greatest({_sql_spacing('m')}, CASE {' '.join(f'WHEN z < {a} THEN {sqlgeo.num(s)}' for a, s in fixed.ZOOM_SPACING)}
    ELSE 1000e0 END) AS at_zoom,
  coalesce((SELECT max(d) FROM (VALUES {', '.join(f'({sqlgeo.num(d)})' for d in fixed.NICE_DISTANCES)}) n(d)
    WHERE d <= mpp * 120e0), 20e0) AS scale_m
  FROM (SELECT request_id, z, seconds * 250000e0 AS m, seconds * 100e0 AS mpp FROM fx_requests)""")
def g10(spark, sf):
    rows = view(spark, sf, "requests").selectExpr("request_id", "z", "seconds * 250000e0 AS m", "seconds * 100e0 AS mpp")
    return rows.select("request_id", geo.marker_spacing(F.col("m")).alias("by_length"),
                       geo.marker_spacing_at_zoom(F.col("z"), F.col("m")).alias("at_zoom"),
                       geo.nice_scale(F.col("mpp")).alias("scale_m"))


@query("G11_region_bbox", cte("places") + f"""SELECT place_id, round(lat - d / 2, 6) AS min_lat, round(lat + d / 2, 6) AS max_lat,
  round(lon - d / 2, 6) AS min_lon, round(lon + d / 2, 6) AS max_lon,
  round((lon - d * 0.4e0) / 180e0 * {sqlgeo.SPAN}, 2) AS inset_left, round((lon + d * 0.4e0) / 180e0 * {sqlgeo.SPAN}, 2) AS inset_right,
  round(y0 + (y1 - y0) * 0.1e0, 2) AS inset_bottom, round(y1 - (y1 - y0) * 0.1e0, 2) AS inset_top
  FROM (SELECT *, ln(tan(radians(lat - d / 2)) + 1 / cos(radians(lat - d / 2))) / pi() * {sqlgeo.SPAN} AS y0,
    ln(tan(radians(lat + d / 2)) + 1 / cos(radians(lat + d / 2))) / pi() * {sqlgeo.SPAN} AS y1
    FROM (SELECT place_id, lat_e5 / 1e5 AS lat, lon_e5 / 1e5 AS lon, (1 + kind) / 20e0 AS d FROM fx_places))""")
def g11(spark, sf):
    centred = view(spark, sf, "places").select("place_id", _lat().alias("lat"), _lon().alias("lon"),
                                               ((1 + F.col("kind")) / 20.0).alias("span"))
    return region_ops.centred_regions(centred)


@query("G12_tile_ancestor", cte("region_tiles") + """SELECT server, z, x, y, x >> (z - 7) AS anc_x, y >> (z - 7) AS anc_y,
  x - ((x >> (z - 7)) << (z - 7)) AS sub_x, y - ((y >> (z - 7)) << (z - 7)) AS sub_y,
  (x - ((x >> (z - 7)) << (z - 7))) * (256 >> (z - 7)) AS crop_x,
  (y - ((y >> (z - 7)) << (z - 7))) * (256 >> (z - 7)) AS crop_y, CAST(256 >> (z - 7) AS BIGINT) AS crop_size
  FROM (SELECT DISTINCT server, z, x, y FROM fx_region_tiles)""")
def g12(spark, sf):
    tiles = view(spark, sf, "region_tiles").select("server", "z", "x", "y").distinct()
    up = geo.ancestor(F.col("z"), F.col("x"), F.col("y"), F.lit(7))
    return tiles.select("server", "z", "x", "y", *[c.alias(k) for k, c in up.items()])


@query("G13_height_packing", cte("dem") + """SELECT row, col, hi, lo, alpha,
  CASE WHEN alpha <> 0 THEN hi * 256 + lo - 32768 END AS unpacked FROM (
    SELECT row, col, CASE WHEN height IS NULL THEN 0 ELSE v >> 8 END AS hi, CASE WHEN height IS NULL THEN 0 ELSE v & 255 END AS lo,
      CASE WHEN height IS NULL THEN 0 ELSE 255 END AS alpha
    FROM (SELECT *, CAST(round_even(height + 0.5e0 - 120, 0) AS INT) + 32768 AS v FROM fx_dem))""")
def g13(spark, sf):
    shifted = F.col("height") + 0.5 - 120
    cells = view(spark, sf, "dem").select("row", "col", *[c.alias(k) for k, c in geo.pack_height(shifted).items()])
    return cells.withColumn("unpacked", geo.unpack_height(F.col("hi"), F.col("lo"), F.col("alpha")))
