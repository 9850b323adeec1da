"""Map-shaped views over the given tables.

The text of each view is valid in Spark SQL and DuckDB alike, so a plan and its
oracle start from the same rows. ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tarnfell.sources.tables import table

VIEWS: dict[str, str] = {
    # Route vertices around a base point of the user.
    "points": """
        SELECT user_id AS route_id, event_id AS seq, ts,
          5500000 + (user_id * 104729) % 1500000 + (event_id * 7919) % 2000 AS lat_e5,
          400000 + (user_id * 611953) % 2600000 + (event_id * 15485863) % 4000 AS lon_e5
        FROM {events}""",
    # Named places with name collisions.
    "places": """
        SELECT p_partkey + 1 AS place_id, p_name AS name, CAST(p_size % 10 AS INT) AS kind,
          CAST(p_size % 13 AS INT) AS rank, CAST(p_partkey % 2 AS INT) AS country,
          n_name AS adm, r_name AS region,
          6000000 + (p_partkey * 7919) % 20000 AS lat_e5, 1500000 + (p_partkey * 104729) % 40000 AS lon_e5
        FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25 JOIN {region} ON r_regionkey = n_regionkey""",
    # Tile request log.
    "requests": """
        SELECT event_id AS request_id, ts, CAST(user_id % 5 AS INT) AS server, CAST(5 + event_id % 14 AS INT) AS z,
          CASE event_id % 7 WHEN 0 THEN 'offlineStore' WHEN 1 THEN 'urlCache' WHEN 2 THEN 'network'
            WHEN 3 THEN 'upscaledAncestor' WHEN 4 THEN 'expectedNoData' WHEN 5 THEN 'unexpectedNoData'
            ELSE 'failure' END AS source,
          CAST(1 + event_id % 3 AS INT) AS attempts, value / 20 AS seconds
        FROM {events}""",
    # Height grid with holes, 120 columns wide.
    "dem": """
        SELECT CAST(o_orderkey % 120 AS INT) AS col, CAST(floor(o_orderkey / 120.0) AS INT) AS row,
          CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 2000) AS DOUBLE) END AS height
        FROM {orders}""",
    # Region to tile memberships with shared tiles.
    "region_tiles": """
        SELECT DISTINCT CAST(l_suppkey AS VARCHAR(20)) AS region_id, CAST(l_partkey % 5 AS INT) AS server,
          CAST(7 + l_partkey % 8 AS INT) AS z, l_partkey % 64 AS x, l_orderkey % 64 AS y
        FROM {lineitem}""",
    # App lifecycle and success events.
    "app_events": """
        SELECT user_id, event_id, ts,
          CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'background' WHEN 'signup' THEN 'measurement'
            WHEN 'purchase' THEN 'download_complete' ELSE 'download_failed' END AS kind, value * 40 AS meters,
          concat('1.', CAST(CAST(floor(event_id / 4000.0) AS INT) AS VARCHAR(20))) AS app_version
        FROM {events}""",
    # Reference heights for the cells of ``dem``.
    "truth": """
        SELECT CAST(o_orderkey % 120 AS INT) AS col, CAST(floor(o_orderkey / 120.0) AS INT) AS row,
          CASE o_orderkey % 5 WHEN 0 THEN 'dtm1' WHEN 1 THEN 'dom1' WHEN 2 THEN 'hoydekurver'
            WHEN 3 THEN 'innsjohoyde' ELSE 'dybdekurver' END AS datakilde,
          CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 2000) AS DOUBLE)
            + (o_orderkey % 17 - 8) * CAST(0.5 AS DOUBLE) END AS height
        FROM {orders}""",
    # Localised strings with gaps.
    "strings": """
        SELECT concat('k', CAST(CAST(doc_id % 40 AS INT) AS VARCHAR(20))) AS str_key, lang,
          max(text) AS value
        FROM {documents} GROUP BY 1, 2""",
    # Map pixels with colours.
    "pixels": """
        SELECT l_orderkey AS tile_id, CAST(l_linenumber AS INT) AS px, l_partkey AS sub,
          CAST(CASE l_partkey % 4 WHEN 0 THEN 255 WHEN 1 THEN 252 WHEN 2 THEN 115 ELSE 0 END AS INT) AS r,
          CAST(CASE l_suppkey % 6 WHEN 0 THEN 255 WHEN 1 THEN 253 WHEN 2 THEN 170 WHEN 3 THEN 85
            WHEN 4 THEN 251 ELSE 0 END AS INT) AS g,
          CAST(CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 230 WHEN 2 THEN 0 ELSE 222 END AS INT) AS b,
          CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 255 END AS INT) AS a
        FROM {lineitem}""",
    # First register: one name per row, codes, two kinds of coordinates.
    "register": """
        SELECT p_partkey + 1 AS native_id,
          CASE p_partkey % 37 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(' ', p_name, ' ') END AS ortnamn,
          CASE p_partkey % 14 WHEN 0 THEN 'BEBTÄTTX' WHEN 1 THEN 'BEBTX' WHEN 2 THEN 'TERRTX' WHEN 3 THEN 'VATTTX' WHEN 4 THEN 'VATTDELTX' WHEN 5 THEN 'VATTDRTX' WHEN 6 THEN 'SANKTX' WHEN 7 THEN 'GLACIÄRTX' WHEN 8 THEN 'NATTX' WHEN 9 THEN 'KULTURTX' WHEN 10 THEN 'KYRKATX' WHEN 11 THEN 'ANLTX' WHEN 12 THEN 'TRAKTTX' ELSE 'OKÄNDTX' END AS detaljtyp,
          CASE p_size % 9 WHEN 0 THEN 'SV' WHEN 1 THEN 'FI' WHEN 2 THEN 'TF' WHEN 3 THEN 'NS' WHEN 4 THEN 'LS' WHEN 5 THEN 'US' WHEN 6 THEN 'SS' WHEN 7 THEN 'XX' ELSE NULL END AS sprak,
          concat('k', CAST(p_partkey % 27 AS VARCHAR(20))) AS kommunkod,
          CASE p_size % 6 WHEN 0 THEN '01' WHEN 1 THEN '03' WHEN 2 THEN '19' WHEN 3 THEN '23' WHEN 4 THEN '25' ELSE '99' END AS lanskod,
          CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 300000e0 + (p_partkey * 104729) % 600000 END AS geom_x,
          CASE WHEN p_partkey % 5 IN (0, 1) THEN NULL ELSE 6200000e0 + (p_partkey * 7919) % 1400000 END AS geom_y,
          300500e0 + (p_partkey * 104729) % 600000 AS ekoordinat, 6200500e0 + (p_partkey * 7919) % 1400000 AS nkoordinat
        FROM {part}""",
    # Second register: groups, grade, and the spellings of a place as rows.
    "graded": """
        SELECT p_partkey + 1 AS native_id,
          CASE p_partkey % 9 WHEN 0 THEN 'bebyggelse' WHEN 1 THEN 'terreng' WHEN 2 THEN 'ferskvann' WHEN 3 THEN 'sjø' WHEN 4 THEN 'markslag' WHEN 5 THEN 'kultur' WHEN 6 THEN 'infrastruktur' WHEN 7 THEN 'offentligAdministrasjon' WHEN 8 THEN 'ukjent' ELSE NULL END AS main_group,
          CASE p_size % 11 WHEN 0 THEN 'rennendeVann' WHEN 1 THEN 'våtmark' WHEN 2 THEN 'isOgPermafrost' WHEN 3 THEN 'verne-OgBruksområder' WHEN 4 THEN 'bartFjell' WHEN 5 THEN 'løsmasseavsetninger' WHEN 6 THEN 'annet' ELSE NULL END AS sub_group,
          CASE p_partkey % 19 WHEN 17 THEN NULL WHEN 18 THEN 'vanlig' ELSE
            concat('viktighet', substring('ABCDEFGHIJKLMabcz', CAST(1 + p_partkey % 19 AS INT), 1)) END AS sorting,
          CASE p_size % 3 WHEN 0 THEN 'nordsamisk-norsk' WHEN 1 THEN 'norsk-kvensk' ELSE NULL END AS priority,
          300000e0 + (p_partkey * 104729) % 600000 AS x, 6600000e0 + (p_partkey * 7919) % 1200000 AS y,
          n_name AS adm, r_name AS region
        FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25 JOIN {region} ON r_regionkey = n_regionkey""",
    "spellings": """
        SELECT p_partkey + 1 AS place_id, s.status, s.lang, s.spelling,
          CASE s.k WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(p_brand, ' ', p_name)
            ELSE concat('old ', p_type) END AS written
        FROM {part} CROSS JOIN (VALUES (0,'hovednavn','norsk','godkjent'),(1,'sidenavn','nordsamisk','vedtatt'),
          (2,'undernavn','kvensk','uvurdert'),(3,'historisk','norsk','avslått')) AS s(k,status,lang,spelling)""",
}

_TABLE = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame."""
    text = VIEWS[name]
    inputs = {t: table(spark, sf_dir, t) for t in set(_TABLE.findall(text))}
    return spark.sql(text, **inputs)


def cte(*names: str) -> str:
    """The views as leading common table expressions ``fx_<name>`` of an oracle."""
    parts = [f"fx_{n} AS ({_TABLE.sub(lambda m: m.group(1), VIEWS[n])})" for n in names]
    return "WITH RECURSIVE " + ", ".join(parts) + " "
