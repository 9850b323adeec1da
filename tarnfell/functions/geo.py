"""Geospatial scalars as Column expressions: everything stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import fixed

PI = math.pi


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, high if isinstance(high, Column) else F.lit(high)),
                      low if isinstance(low, Column) else F.lit(low))


# --------------------------------------------------------------- tiles

def _world(lon: Column, lat: Column, scale: Column, latitude_limit: float) -> tuple[Column, Column]:
    """Position in a square world of side ``scale``, y down."""
    rad = F.radians(clamp(lat, -latitude_limit, latitude_limit))
    x = (lon + 180.0) / 360.0 * scale
    y = (1.0 - F.ln(F.tan(rad) + 1.0 / F.cos(rad)) / PI) / 2.0 * scale
    return x, y


def tile_xy(lon: Column, lat: Column, z: Column,
            latitude_limit: float = fixed.LATITUDE_LIMIT_SCRIPTS) -> tuple[Column, Column]:
    """Tile indices at zoom ``z``, clamped to the valid range."""
    n = F.pow(F.lit(2.0), z)
    x, y = _world(lon, lat, n, latitude_limit)
    top = n.cast("long") - 1
    return (clamp(F.floor(x).cast("long"), 0, top).cast("long"),
            clamp(F.floor(y).cast("long"), 0, top).cast("long"))


def tile_pixel(lon: Column, lat: Column, z: int, size: int = fixed.TILE_SIZE) -> dict[str, Column]:
    """Tile and the pixel inside it."""
    n = 1 << z
    x, y = _world(lon, lat, F.lit(float(n * size)), fixed.LATITUDE_LIMIT_SCRIPTS)
    tx = clamp(F.floor(x / size).cast("long"), 0, n - 1)
    ty = clamp(F.floor(y / size).cast("long"), 0, n - 1)
    return {"tile_x": tx.cast("long"), "tile_y": ty.cast("long"),
            "px_row": clamp(F.floor(y).cast("long") - ty * size, 0, size - 1).cast("long"),
            "px_col": clamp(F.floor(x).cast("long") - tx * size, 0, size - 1).cast("long")}


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """Web Mercator metres of a tile."""
    span = F.lit(2 * fixed.WEB_MERCATOR_SPAN) / F.pow(F.lit(2.0), z)
    left = x * span - fixed.WEB_MERCATOR_SPAN
    top = F.lit(fixed.WEB_MERCATOR_SPAN) - y * span
    return {"left": left, "bottom": top - span, "right": left + span, "top": top}


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    lon = x / fixed.WEB_MERCATOR_SPAN * 180.0
    lat = F.degrees(2.0 * F.atan(F.exp(y / fixed.WEB_MERCATOR_SPAN * PI)) - PI / 2.0)
    return lon, lat


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = lon / 180.0 * fixed.WEB_MERCATOR_SPAN
    rad = F.radians(lat)
    return x, F.ln(F.tan(rad) + 1.0 / F.cos(rad)) / PI * fixed.WEB_MERCATOR_SPAN


def pixel_centre(z: Column, x: Column, y: Column, row: Column, col: Column,
                 size: int = fixed.TILE_SIZE) -> tuple[Column, Column]:
    """Lon/lat of the centre of one pixel of a tile."""
    span = F.lit(2 * fixed.WEB_MERCATOR_SPAN) / F.pow(F.lit(2.0), z)
    mx = (x + (col + 0.5) / size) * span - fixed.WEB_MERCATOR_SPAN
    my = F.lit(fixed.WEB_MERCATOR_SPAN) - (y + (row + 0.5) / size) * span
    return mercator_to_lonlat(mx, my)


def ancestor(z: Column, x: Column, y: Column, target: Column, size: int = fixed.TILE_SIZE) -> dict[str, Column]:
    """Ancestor at zoom ``target`` and the window of the tile inside it."""
    n = F.pow(F.lit(2.0), z - target).cast("long")
    ax, ay = F.floor(x / n).cast("long"), F.floor(y / n).cast("long")
    sub_x, sub_y = x - ax * n, y - ay * n
    crop = F.floor(F.lit(size) / n).cast("long")
    return {"anc_x": ax, "anc_y": ay, "sub_x": sub_x, "sub_y": sub_y,
            "crop_x": sub_x * crop, "crop_y": sub_y * crop, "crop_size": crop}


# --------------------------------------------------------------- projection

_A, _F = 6378137.0, 1 / 298.257222101  # GRS80
_N = _F / (2 - _F)
RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
K0, FALSE_EASTING, CENTRAL_MERIDIAN = 0.9996, 500_000.0, 15.0
ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
         13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
         61 * _N**3 / 240 - 103 * _N**4 / 140,
         49561 * _N**4 / 161280]
BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
        _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
        17 * _N**3 / 480 - 37 * _N**4 / 840,
        4397 * _N**4 / 161280]
DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
         7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
         56 * _N**3 / 15 - 136 * _N**4 / 35,
         4279 * _N**4 / 630]
CONFORMAL = 2 * math.sqrt(_N) / (1 + _N)


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 lon/lat to easting/northing of the 33-zone metric grid (Krüger series)."""
    sin_lat = F.sin(F.radians(lat))
    dlon = F.radians(lon - CENTRAL_MERIDIAN)
    t = F.sinh(F.atanh(sin_lat) - CONFORMAL * F.atanh(CONFORMAL * sin_lat))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1.0 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return FALSE_EASTING + K0 * RECTIFYING * east, K0 * RECTIFYING * north


def with_projection(df: DataFrame, lon: Column, lat: Column, easting: str, northing: str) -> DataFrame:
    """``project`` in stages, for large tables.

    Each intermediate is a column of its own, evaluated once per row; as one
    expression the series would repeat them in a method too long to compile.
    """
    t = F.sinh(F.atanh(F.col("_sl")) - CONFORMAL * F.atanh(CONFORMAL * F.col("_sl")))
    staged = (df.withColumns({"_sl": F.sin(F.radians(lat)), "_dl": F.radians(lon - CENTRAL_MERIDIAN)})
              .withColumn("_t", t)
              .withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_dl")),
                            "_eta": F.atanh(F.sin("_dl") / F.sqrt(1.0 + F.col("_t") * F.col("_t")))}))
    east, north = F.col("_eta"), F.col("_xi")
    for j, a in enumerate(ALPHA, start=1):
        east = east + a * F.cos(2.0 * j * F.col("_xi")) * F.sinh(2.0 * j * F.col("_eta"))
        north = north + a * F.sin(2.0 * j * F.col("_xi")) * F.cosh(2.0 * j * F.col("_eta"))
    return staged.withColumns({easting: FALSE_EASTING + K0 * RECTIFYING * east, northing: K0 * RECTIFYING * north}).drop(
        "_sl", "_dl", "_t", "_xi", "_eta")


def unproject(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Easting/northing of the 33-zone metric grid to WGS84 lon/lat.

    Intermediates are bound once: inlined into a filter they would otherwise
    outgrow what one generated method may hold.
    """
    plane = F.struct((northing / (K0 * RECTIFYING)).alias("xi"),
                     ((easting - FALSE_EASTING) / (K0 * RECTIFYING)).alias("eta"))

    def primed(p):
        xi, eta = p["xi"], p["eta"]
        for j, b in enumerate(BETA, start=1):
            xi = xi - b * F.sin(2.0 * j * p["xi"]) * F.cosh(2.0 * j * p["eta"])
            eta = eta - b * F.cos(2.0 * j * p["xi"]) * F.sinh(2.0 * j * p["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def conformal(q):
        return F.struct(F.asin(F.sin(q["xi"]) / F.cosh(q["eta"])).alias("chi"),
                        (CENTRAL_MERIDIAN + F.degrees(F.atan2(F.sinh(q["eta"]), F.cos(q["xi"])))).alias("lon"))

    def geographic(c):
        lat = c["chi"]
        for j, d in enumerate(DELTA, start=1):
            lat = lat + d * F.sin(2.0 * j * c["chi"])
        return F.struct(c["lon"].alias("lon"), F.degrees(lat).alias("lat"))

    point = _let(plane, lambda p: _let(primed(p), lambda q: _let(conformal(q), geographic)))
    return point["lon"], point["lat"]


def grid_window(left: Column, bottom: Column, right: Column, top: Column,
                origin_x: float = fixed.GRID_ORIGIN_X, origin_y: float = fixed.GRID_ORIGIN_Y,
                res: float = fixed.GRID_RES) -> dict[str, Column]:
    """Bounding box snapped outward to whole cells."""
    col0, col1 = F.floor((left - origin_x) / res), F.ceil((right - origin_x) / res)
    row0, row1 = F.floor((origin_y - top) / res), F.ceil((origin_y - bottom) / res)
    return {"col": col0, "row": row0, "width": col1 - col0, "height": row1 - row0}


# --------------------------------------------------------------- distance

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
# Every round gains more than two digits away from antipodal pairs.
GEODESIC_ROUNDS = 6
# Up to here the closed form is within 0.1 mm of the iteration (under 1e-8 m at 1 km).
SHORT_LAT, SHORT_LON = 0.2, 0.4
_E2 = (WGS84_A**2 - WGS84_B**2) / WGS84_B**2


def _let(value: Column, body) -> Column:
    """Bind ``value`` once inside a higher-order function."""
    return F.transform(F.array(value), body)[0]


def _short_m(lat1: Column, lat2: Column, dlon: Column) -> Column:
    """Bowring's closed form for short geodesics: generated code, no iteration."""
    phi, dphi = F.radians(lat1), F.radians(lat2 - lat1)
    c = F.cos(phi)
    b2 = 1.0 + _E2 * c * c
    root = F.sqrt(b2)
    a = F.sqrt(1.0 + _E2 * c * c * c * c)
    w = a * F.radians(dlon) / 2.0
    d = dphi / (2.0 * root) * (1.0 + 3.0 * _E2 / (4.0 * b2) * dphi * F.sin(2.0 * phi + dphi * (2.0 / 3.0)))
    e = F.sin(d) * F.cos(w)
    f = F.sin(w) * (root * c * F.cos(d) - F.sin(phi) * F.sin(d)) / a
    return WGS84_A * math.sqrt(1.0 + _E2) / b2 * 2.0 * F.asin(F.sqrt(e * e + f * f))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on WGS84 in metres; null when a coordinate is null.

    Short pairs, which is what routes and duplicates are made of, take a closed
    form that stays in generated code; longer ones are solved by iteration.
    """
    raw = lon2 - lon1
    dlon = F.when(raw > 180, raw - 360.0).when(raw < -180, raw + 360.0).otherwise(raw)
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    short = (F.abs(lat2 - lat1) <= SHORT_LAT) & (F.abs(dlon) <= SHORT_LON)
    return (F.when(~known, F.lit(None).cast("double")).when(short, _short_m(lat1, lat2, dlon))
            .otherwise(_vincenty_m(lat1, lon1, lat2, lon2)))


def _vincenty_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Vincenty's inverse solution by a fixed number of rounds."""
    u1 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat1)))
    u2 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat2)))
    raw = lon2 - lon1
    dlon = F.radians(F.when(raw > 180, raw - 360.0).when(raw < -180, raw + 360.0).otherwise(raw))
    start = F.struct(F.sin(u1).alias("su1"), F.cos(u1).alias("cu1"), F.sin(u2).alias("su2"),
                     F.cos(u2).alias("cu2"), dlon.alias("l"))

    def angles(s, lam):
        sin_lam, cos_lam = F.sin(lam), F.cos(lam)
        p = s["cu2"] * sin_lam
        q = s["cu1"] * s["su2"] - s["su1"] * s["cu2"] * cos_lam
        return F.struct(F.sqrt(p * p + q * q).alias("ss"),
                        (s["su1"] * s["su2"] + s["cu1"] * s["cu2"] * cos_lam).alias("cs"),
                        (s["cu1"] * s["cu2"] * sin_lam).alias("pl"))

    def spread(s, a):
        sin_alpha = F.when(a["ss"] == 0, 0.0).otherwise(a["pl"] / F.nullif(a["ss"], F.lit(0.0)))
        c2a = 1.0 - sin_alpha * sin_alpha
        c2m = F.when(c2a == 0, 0.0).otherwise(
            a["cs"] - 2.0 * s["su1"] * s["su2"] / F.nullif(c2a, F.lit(0.0)))
        return F.struct(a["ss"].alias("ss"), a["cs"].alias("cs"), sin_alpha.alias("sa"),
                        c2a.alias("c2a"), c2m.alias("c2m"), F.atan2(a["ss"], a["cs"]).alias("sigma"))

    def next_lambda(s, m):
        c = WGS84_F / 16 * m["c2a"] * (4.0 + WGS84_F * (4.0 - 3.0 * m["c2a"]))
        return s["l"] + (1.0 - c) * WGS84_F * m["sa"] * (
            m["sigma"] + c * m["ss"] * (m["c2m"] + c * m["cs"] * (2.0 * m["c2m"] * m["c2m"] - 1.0)))

    def measure(s, lam):
        return _let(angles(s, lam), lambda a: spread(s, a))

    def metres(m):
        k = m["c2a"] * ((WGS84_A**2 - WGS84_B**2) / WGS84_B**2)
        big_a = 1.0 + k / 16384.0 * (4096.0 + k * (-768.0 + k * (320.0 - 175.0 * k)))
        big_b = k / 1024.0 * (256.0 + k * (-128.0 + k * (74.0 - 47.0 * k)))
        c2m2 = m["c2m"] * m["c2m"]
        correction = big_b * m["ss"] * (m["c2m"] + big_b / 4.0 * (
            m["cs"] * (2.0 * c2m2 - 1.0)
            - big_b / 6.0 * m["c2m"] * (4.0 * m["ss"] * m["ss"] - 3.0) * (4.0 * c2m2 - 3.0)))
        return WGS84_B * big_a * (m["sigma"] - correction)

    def solve(s):
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(GEODESIC_ROUNDS)), s["l"],
                          lambda acc, _i: _let(measure(s, acc), lambda m: next_lambda(s, m)))
        return _let(lam, lambda v: _let(measure(s, v), metres))

    return _let(start, solve)


def wrapped_lerp(lat1: Column, lon1: Column, lat2: Column, lon2: Column, t: Column) -> tuple[Column, Column]:
    """Point at fraction ``t``, the short way round the date line."""
    d = lon2 - lon1
    d = F.when(d > 180, d - 360.0).when(d < -180, d + 360.0).otherwise(d)
    lon = lon1 + d * t
    lon = F.when(lon > 180, lon - 360.0).when(lon < -180, lon + 360.0).otherwise(lon)
    return lat1 + (lat2 - lat1) * t, lon


def lerp(lat1: Column, lon1: Column, lat2: Column, lon2: Column, t: Column) -> tuple[Column, Column]:
    return lat1 + (lat2 - lat1) * t, lon1 + (lon2 - lon1) * t


# --------------------------------------------------------------- view helpers

def zoom_level(longitude_span: Column, width_points: Column) -> Column:
    level = F.log2(360.0 * (width_points / 256.0) / F.nullif(longitude_span, F.lit(0.0)))
    return F.when((longitude_span > 0) & (width_points > 0), level).otherwise(0.0)


def metres_per_point(lat: Column, longitude_span: Column, width_points: Column) -> Column:
    return longitude_span * (F.cos(lat * PI / 180.0) * fixed.METRES_PER_DEGREE_EQUATOR) / width_points


def marker_spacing(length_m: Column) -> Column:
    """First spacing that gives at most the allowed number of markers."""
    spacing = F.when(length_m / fixed.MARKER_SPACINGS[0] <= fixed.MAX_MARKERS, fixed.MARKER_SPACINGS[0])
    for s in fixed.MARKER_SPACINGS[1:]:
        spacing = spacing.when(length_m / s <= fixed.MAX_MARKERS, s)
    return spacing.otherwise(fixed.MARKER_SPACINGS[-1])


def marker_spacing_at_zoom(zoom: Column, length_m: Column) -> Column:
    """The larger of the zoom's spacing and the length's spacing."""
    by_zoom = F.when(zoom < fixed.ZOOM_SPACING[0][0], fixed.ZOOM_SPACING[0][1])
    for limit, s in fixed.ZOOM_SPACING[1:]:
        by_zoom = by_zoom.when(zoom < limit, s)
    return F.greatest(by_zoom.otherwise(fixed.ZOOM_SPACING_DEFAULT), marker_spacing(length_m))


def nice_scale(metres_per_pt: Column) -> Column:
    """Largest round distance that fits the scale bar, else the smallest one."""
    limit = metres_per_pt * fixed.SCALE_BAR_POINTS
    fitting = F.array_max(F.filter(F.array(*[F.lit(d) for d in fixed.NICE_DISTANCES]), lambda d: d <= limit))
    return F.coalesce(fitting, F.lit(fixed.NICE_DISTANCES[0]))


# --------------------------------------------------------------- heights

def pack_height(height: Column) -> dict[str, Column]:
    """Height in two 8-bit channels, alpha 0 = no data."""
    value = clamp(F.rint(height).cast("long") + fixed.HEIGHT_OFFSET, 0, 65535).cast("int")
    known = height.isNotNull()
    return {"hi": F.when(known, F.shiftright(value, 8)).otherwise(0),
            "lo": F.when(known, value.bitwiseAND(F.lit(255))).otherwise(0),
            "alpha": F.when(known, 255).otherwise(0)}


def unpack_height(hi: Column, lo: Column, alpha: Column) -> Column:
    value = clamp(hi * 256 + lo - fixed.HEIGHT_OFFSET, -32768, 32767)
    return F.when(alpha != 0, value.cast("int"))


def to_e5(degrees: Column) -> Column:
    """Fixed point 1e-5 degree, half to even."""
    return F.rint(degrees * float(fixed.COORD_SCALE)).cast("long")


def from_e5(value: Column) -> Column:
    return value / float(fixed.COORD_SCALE)
