"""DuckDB text of the geospatial formulas, for oracles only."""

from __future__ import annotations

import math

from tarnfell.functions import fixed
from tarnfell.functions import geo


def num(value: float) -> str:
    """A DOUBLE literal."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def tile_x(lon: str, z: str) -> str:
    n = f"pow(2, {z})"
    return f"CAST(greatest(least(floor(({lon} + 180e0) / 360e0 * {n}), {n} - 1), 0) AS BIGINT)"


def tile_y(lat: str, z: str, limit: float = fixed.LATITUDE_LIMIT_SCRIPTS) -> str:
    n = f"pow(2, {z})"
    rad = f"radians(greatest(least({lat}, {num(limit)}), {num(-limit)}))"
    return (f"CAST(greatest(least(floor((1e0 - ln(tan({rad}) + 1e0 / cos({rad})) / pi()) / 2e0 * {n}), "
            f"{n} - 1), 0) AS BIGINT)")


def project_cte(name: str, src: str, lon: str, lat: str) -> str:
    """CTEs ending in ``name`` = src columns + easting, northing."""
    c = num(geo.CONFORMAL)
    east = " + ".join(["eta"] + [f"{num(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)"
                                 for j, a in enumerate(geo.ALPHA, 1)])
    north = " + ".join(["xi"] + [f"{num(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)"
                                 for j, a in enumerate(geo.ALPHA, 1)])
    k = num(geo.K0 * geo.RECTIFYING)
    return f"""{name}_a AS (SELECT *, sin(radians({lat})) AS sl, radians({lon} - 15e0) AS dl FROM {src}),
      {name}_b AS (SELECT *, sinh(atanh(sl) - {c} * atanh({c} * sl)) AS tt FROM {name}_a),
      {name}_c AS (SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1e0 + tt * tt)) AS eta FROM {name}_b),
      {name} AS (SELECT * EXCLUDE (sl, dl, tt, xi, eta), 500000e0 + {k} * ({east}) AS easting,
        {k} * ({north}) AS northing FROM {name}_c)"""


def unproject_cte(name: str, src: str, easting: str, northing: str) -> str:
    """CTEs ending in ``name`` = src columns + lon, lat."""
    k = num(geo.K0 * geo.RECTIFYING)
    xp = "xi" + "".join(f" - {num(b)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(geo.BETA, 1))
    ep = "eta" + "".join(f" - {num(b)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(geo.BETA, 1))
    lat = "chi" + "".join(f" + {num(d)} * sin({2 * j} * chi)" for j, d in enumerate(geo.DELTA, 1))
    return f"""{name}_a AS (SELECT *, {northing} / {k} AS xi, ({easting} - 500000e0) / {k} AS eta FROM {src}),
      {name}_b AS (SELECT *, {xp} AS xip, {ep} AS etap FROM {name}_a),
      {name}_c AS (SELECT *, asin(sin(xip) / cosh(etap)) AS chi FROM {name}_b),
      {name} AS (SELECT * EXCLUDE (xi, eta, xip, etap, chi), 15e0 + degrees(atan2(sinh(etap), cos(xip))) AS lon,
        degrees({lat}) AS lat FROM {name}_c)"""


def geodesic_cte(name: str, src: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """CTEs ending in ``name`` = src columns + metres (Vincenty, same number of rounds)."""
    f, a, b = geo.WGS84_F, geo.WGS84_A, geo.WGS84_B
    ff, aa = num(f), num((a * a - b * b) / (b * b))
    ctes = [f"""{name}_0 AS (SELECT *, atan({num(1 - f)} * tan(radians({lat1}))) AS gu1,
        atan({num(1 - f)} * tan(radians({lat2}))) AS gu2, radians({lon2} - {lon1}) AS gl,
        radians({lon2} - {lon1}) AS glam, ({lat1} = {lat2} AND {lon1} = {lon2}) AS gsame FROM {src})"""]
    prev = f"{name}_0"

    def measured(prev: str, i: str) -> tuple[list[str], str]:
        one = f"{name}_{i}p"
        two = f"{name}_{i}q"
        return [f"""{one} AS (SELECT *, sqrt(pow(cos(gu2) * sin(glam), 2) + pow(cos(gu1) * sin(gu2)
            - sin(gu1) * cos(gu2) * cos(glam), 2)) AS gss,
            sin(gu1) * sin(gu2) + cos(gu1) * cos(gu2) * cos(glam) AS gcs FROM {prev})""",
                f"""{two} AS (SELECT *, coalesce(1e0 - pow(gsa, 2), 1e0) AS gc2a,
            CASE WHEN 1e0 - pow(gsa, 2) = 0 THEN 0e0 ELSE gcs - 2e0 * sin(gu1) * sin(gu2) / nullif(1e0 - pow(gsa, 2), 0) END AS gc2m,
            atan2(gss, gcs) AS gsig FROM (SELECT *, CASE WHEN gss = 0 THEN 0e0 ELSE
              cos(gu1) * cos(gu2) * sin(glam) / nullif(gss, 0) END AS gsa FROM {one}))"""], two

    scratch = "glam, gss, gcs, gsa, gc2a, gc2m, gsig"
    for i in range(1, geo.GEODESIC_ROUNDS + 1):
        more, two = measured(prev, str(i))
        ctes += more
        c = f"({ff} / 16e0 * gc2a * (4e0 + {ff} * (4e0 - 3e0 * gc2a)))"
        ctes.append(f"""{name}_{i} AS (SELECT * EXCLUDE ({scratch}), gl + (1e0 - {c}) * {ff} * gsa * (gsig + {c} * gss * (
            gc2m + {c} * gcs * (2e0 * gc2m * gc2m - 1e0))) AS glam FROM {two})""")
        prev = f"{name}_{i}"
    more, two = measured(prev, "z")
    ctes += more
    ctes.append(f"{name}_k AS (SELECT *, gc2a * {aa} AS gk FROM {two})")
    ctes.append(f"""{name}_m AS (SELECT *, 1e0 + gk / 16384e0 * (4096e0 + gk * (-768e0 + gk * (320e0 - 175e0 * gk))) AS gba,
        gk / 1024e0 * (256e0 + gk * (-128e0 + gk * (74e0 - 47e0 * gk))) AS gbb FROM {name}_k)""")
    e2 = num((a * a - b * b) / (b * b))
    c, dphi = f"cos(radians({lat1}))", f"radians({lat2} - {lat1})"
    ctes.append(f"""{name}_n AS (SELECT *, 1e0 + {e2} * {c} * {c} AS hb2, sqrt(1e0 + {e2} * {c} * {c}) AS hb,
        sqrt(1e0 + {e2} * {c} * {c} * {c} * {c}) AS ha FROM {name}_m)""")
    ctes.append(f"""{name}_o AS (SELECT *, ha * gl / 2e0 AS hw, {dphi} / (2e0 * hb) * (1e0 + 3e0 * {e2} / (4e0 * hb2) * {dphi}
        * sin(2e0 * radians({lat1}) + {dphi} * ({num(2 / 3)}))) AS hd FROM {name}_n)""")
    near = f"""{num(a * math.sqrt(1 + (a * a - b * b) / (b * b)))} / hb2 * 2e0 * asin(sqrt(pow(sin(hd) * cos(hw), 2)
        + pow(sin(hw) * (hb * {c} * cos(hd) - sin(radians({lat1})) * sin(hd)) / ha, 2)))"""
    ctes.append(f"""{name} AS (SELECT * EXCLUDE ({scratch}, gu1, gu2, gl, gsame, gk, gba, gbb, hb2, hb, ha, hw, hd),
        CASE WHEN gsame THEN 0e0 WHEN abs({lat2} - {lat1}) <= {geo.SHORT_LAT} AND abs({lon2} - {lon1}) <= {geo.SHORT_LON} THEN {near}
        ELSE {num(b)} * gba * (gsig - gbb * gss * (gc2m + gbb / 4e0 * (
          gcs * (2e0 * gc2m * gc2m - 1e0) - gbb / 6e0 * gc2m * (4e0 * gss * gss - 3e0) * (4e0 * gc2m * gc2m - 3e0)))) END
        AS metres FROM {name}_o)""")
    return ", ".join(ctes)


SPAN = num(fixed.WEB_MERCATOR_SPAN)
HALF_PI = num(math.pi / 2)
