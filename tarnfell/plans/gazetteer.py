"""Gazetteer queries: scans, row rules, names, ids, duplicates, bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfell.functions import fixed, geo
from tarnfell.operators import gazetteer as ops
from tarnfell.operators import search as search_ops
from tarnfell.plans import sqlgeo
from tarnfell.plans.registry import query
from tarnfell.session import materialised, scratch_path, spread
from tarnfell.sources import bundle
from tarnfell.sources.register_xml import read_register, write_register
from tarnfell.sources.tables import table
from tarnfell.sources.views import cte, view


def sql_case(column, mapping, default="NULL"):
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


FIRST_KIND = {k: ops.KIND_ID[v] for k, v in fixed.FIRST_REGISTER_KIND.items()}
GROUP_KIND = {k: ops.KIND_ID[v] for k, v in fixed.SECOND_REGISTER_GROUP_KIND.items()}
SUBGROUP_KIND = {k: ops.KIND_ID[v] for k, v in fixed.SECOND_REGISTER_SUBGROUP_KIND.items()}


@query("S1_register_scan", cte("register") + """SELECT native_id, trim(ortnamn) AS name, detaljtyp, sprak, kommunkod, lanskod
  FROM fx_register WHERE ortnamn IS NOT NULL AND ortnamn <> '' AND detaljtyp NOT IN ('TRAKTTX')""")
def s1(spark, sf):
    return ops.register_scan(view(spark, sf, "register")).select(
        "native_id", F.col("ortnamn").alias("name"), "detaljtyp", "sprak", "kommunkod", "lanskod")


@query("S3_point_choice", cte("register") + """SELECT native_id,
  CASE WHEN geom_x IS NULL OR geom_y IS NULL THEN ekoordinat ELSE geom_x END AS x,
  CASE WHEN geom_x IS NULL OR geom_y IS NULL THEN nkoordinat ELSE geom_y END AS y FROM fx_register""")
def s3(spark, sf):
    p = ops.chosen_point(*[F.col(c) for c in ("geom_x", "geom_y", "ekoordinat", "nkoordinat")]).alias("p")
    return view(spark, sf, "register").select("native_id", p).select("native_id", "p.x", "p.y")


@query("S4_extent_midpoint", cte("points") + """SELECT route_id, (min(lon_e5) + max(lon_e5)) / 2e0 AS x,
  (min(lat_e5) + max(lat_e5)) / 2e0 AS y FROM fx_points GROUP BY route_id""")
def s4(spark, sf):
    vertices = view(spark, sf, "points").selectExpr("route_id", "lon_e5 AS x", "lat_e5 AS y")
    return ops.extent_midpoint(vertices, "route_id")


@query("P1_category_map", cte("register") +
       f"SELECT native_id, {sql_case('detaljtyp', FIRST_KIND, '9')} AS kind FROM fx_register")
def p1(spark, sf):
    return view(spark, sf, "register").select("native_id", ops.first_register_kind(F.col("detaljtyp")).alias("kind"))


@query("P2_two_level_category", cte("graded") + f"""SELECT native_id, coalesce({sql_case('sub_group', SUBGROUP_KIND)},
  {sql_case('main_group', GROUP_KIND)}, 9) AS kind FROM fx_graded
  WHERE main_group NOT IN ('infrastruktur', 'offentligAdministrasjon')""")
def p2(spark, sf):
    rows = view(spark, sf, "graded").filter(~F.col("main_group").isin(fixed.SECOND_REGISTER_SKIP_GROUPS))
    kind = ops.second_register_kind(F.col("main_group"), F.coalesce("sub_group", F.lit("")))
    return rows.select("native_id", kind.alias("kind"))


_SQL_GRADE = """CASE WHEN starts_with(coalesce(sorting, ''), 'viktighet') AND length(sorting) = 10
  THEN CAST(greatest(0, least(12, ascii(upper(substr(sorting, 10, 1))) - 65)) AS INT) ELSE 7 END"""


@query("P3_importance_rank", cte("graded", "register") + f"""SELECT native_id, {_SQL_GRADE} AS graded,
  CASE detaljtyp WHEN 'BEBTÄTTX' THEN 0 WHEN 'KYRKATX' THEN 5 ELSE 3 END AS typed
  FROM fx_graded JOIN fx_register USING (native_id)""")
def p3(spark, sf):
    return view(spark, sf, "graded").join(view(spark, sf, "register"), "native_id").select(
        "native_id", ops.graded_rank(F.coalesce("sorting", F.lit(""))).alias("graded"),
        ops.first_register_rank(F.col("detaljtyp")).alias("typed"))


def _municipalities(spark, sf):
    return table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("code"),
                                             F.col("n_name").alias("adm"))


@query("P4_code_names", cte("register") + f"""SELECT native_id, n_name AS adm,
  {sql_case('lanskod', fixed.COUNTIES)} AS county, {sql_case('sprak', fixed.FIRST_REGISTER_LANGUAGE, "'sv'")} AS lang
  FROM fx_register LEFT JOIN nation ON kommunkod = concat('k', CAST(n_nationkey AS VARCHAR))""")
def p4(spark, sf):
    rows = view(spark, sf, "register").join(_municipalities(spark, sf), F.col("kommunkod") == F.col("code"), "left")
    return rows.select("native_id", "adm", fixed.lookup(F.col("lanskod"), fixed.COUNTIES).alias("county"),
                       fixed.lookup(F.coalesce("sprak", F.lit("")), fixed.FIRST_REGISTER_LANGUAGE, "sv").alias("lang"))


@query("P5_coordinate_range", cte("places") + """SELECT place_id FROM fx_places
  WHERE lat_e5 * 2 / 1e5 - 30 BETWEEN -90 AND 90.1 - 0.1 AND lon_e5 * 11 / 1e5 BETWEEN -180 AND 180""")
def p5(spark, sf):
    lat, lon = F.col("lat_e5") * 2 / 1e5 - 30, F.col("lon_e5") * 11 / 1e5
    return view(spark, sf, "places").filter(ops.in_range(lat, lon)).select("place_id")


@query("P6_fixed_point", cte("places") + """SELECT place_id, CAST(round_even(v * 1e5, 0) AS BIGINT) AS encoded,
  round_even(v * 1e5, 0) / 1e5 AS decoded FROM (SELECT place_id, lat_e5 / 1e5 + place_id % 8 / 1.6e6 AS v FROM fx_places)""")
def p6(spark, sf):
    v = F.col("lat_e5") / 1e5 + F.col("place_id") % 8 / 1.6e6
    encoded = geo.to_e5(v)
    return view(spark, sf, "places").select("place_id", encoded.alias("encoded"), geo.from_e5(encoded).alias("decoded"))


@query("P7_scope_filter", cte("places") + "SELECT place_id, kind FROM fx_places WHERE kind IN (1, 2, 5)")
def p7(spark, sf):
    return ops.in_scope(view(spark, sf, "places"), ["terrain", "water", "glacier"]).select("place_id", "kind")


@query("P8_subtitle", cte("places") + """SELECT place_id, CASE WHEN a IS NULL AND r IS NULL THEN '' WHEN a IS NULL THEN r
  WHEN r IS NULL OR r = a THEN a ELSE concat(a, ', ', r) END AS subtitle
  FROM (SELECT place_id, CASE WHEN place_id % 5 = 0 THEN NULL ELSE adm END AS a,
    CASE WHEN place_id % 7 = 0 THEN NULL WHEN place_id % 3 = 0 THEN adm ELSE region END AS r FROM fx_places)""")
def p8(spark, sf):
    rows = view(spark, sf, "places").selectExpr(
        "place_id", "CASE WHEN place_id % 5 = 0 THEN NULL ELSE adm END AS a",
        "CASE WHEN place_id % 7 = 0 THEN NULL WHEN place_id % 3 = 0 THEN adm ELSE region END AS r")
    return rows.select("place_id", ops.subtitle("a", "r").alias("subtitle"))


# --------------------------------------------------------------- names and ids

_STATUS = sql_case("status", fixed.NAME_STATUS_RANK)
_SPELLING = sql_case("spelling", fixed.SPELLING_RANK)
SQL_NAMES = f"""ranked AS (SELECT s.place_id, written, lang, {_STATUS} AS a,
    coalesce(nullif(list_position(string_split(coalesce(priority, 'norsk'), '-'), lang), 0) - 1,
      len(string_split(coalesce(priority, 'norsk'), '-'))) AS b, {_SPELLING} AS c
    FROM fx_spellings s JOIN fx_graded g ON g.native_id = s.place_id),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY place_id, lower(written) ORDER BY a, b, c, written, lang) AS dup
    FROM ranked WHERE a IS NOT NULL AND c IS NOT NULL AND written <> ''),
  names AS (SELECT place_id, written, {sql_case('lang', fixed.SECOND_REGISTER_LANGUAGE, "'no'")} AS lang,
    row_number() OVER (PARTITION BY place_id ORDER BY a, b, c, written, firsts.lang) - 1 AS position
    FROM firsts WHERE dup = 1)"""
SQL_ALIASES = SQL_NAMES + f""", aliases AS (SELECT {fixed.ALIAS_OFFSET} + row_number() OVER (ORDER BY place_id, position)
    AS alias_id, place_id, written AS name, lang FROM names WHERE position > 0)"""


def _spellings(spark, sf):
    """Places with their spellings as one array, as the second register nests them."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey + 1 AS place_id",
        """array(
          named_struct('name_status', 'hovednavn', 'language', 'norsk', 'spelling_status', 'godkjent', 'written', p_name),
          named_struct('name_status', 'sidenavn', 'language', 'nordsamisk', 'spelling_status', 'vedtatt', 'written', upper(p_name)),
          named_struct('name_status', 'undernavn', 'language', 'kvensk', 'spelling_status', 'uvurdert', 'written', concat(p_brand, ' ', p_name)),
          named_struct('name_status', 'historisk', 'language', 'norsk', 'spelling_status', 'avslått', 'written', concat('old ', p_type))
        ) AS spellings""",
        "CASE p_size % 3 WHEN 0 THEN 'nordsamisk-norsk' WHEN 1 THEN 'norsk-kvensk' ELSE NULL END AS priority")


def spelled_places(spark, sf):
    """Places with their ranked names as one array, ranked once.

    A file that one task reads holds many rows of much work, so they are dealt out first.
    """
    ranked = spread(_spellings(spark, sf), "place_id").select("place_id", ops.ranked_names(F.col("spellings"), F.col("priority")).alias("names"))
    return materialised(ranked, "spelled-places")


@query("A13_name_choice", cte("graded", "spellings") + ", " + SQL_ALIASES + """
  SELECT n.place_id, CAST(n.position AS INT) AS position, n.written AS name, n.lang, a.alias_id FROM names n
  LEFT JOIN aliases a ON a.place_id = n.place_id AND a.name = n.written AND n.position > 0""")
def a13(spark, sf):
    named = spelled_places(spark, sf)
    shown = named.select("place_id", F.lit(0).alias("position"), F.col("names")[0]["written"].alias("name"),
                         F.col("names")[0]["lang"].alias("lang"), F.lit(None).cast("long").alias("alias_id"))
    return shown.unionByName(ops.alias_rows(named).select(*shown.columns))


@query("U1_combined_registers", cte("register", "graded", "spellings") + ", " + SQL_NAMES + """, shown AS (
    SELECT place_id, max(CASE WHEN position = 0 THEN written END) AS name, count(*) AS n_names FROM names GROUP BY 1)
  SELECT country, native_id, row_number() OVER (ORDER BY country, native_id) AS place_id, name, n_names FROM (
    SELECT 0 AS country, native_id, trim(ortnamn) AS name, 1 AS n_names FROM fx_register
      WHERE ortnamn IS NOT NULL AND trim(ortnamn) <> '' AND detaljtyp <> 'TRAKTTX'
    UNION ALL SELECT 1, native_id, name, n_names FROM fx_graded JOIN shown ON shown.place_id = native_id
      WHERE coalesce(main_group, '') NOT IN ('infrastruktur', 'offentligAdministrasjon'))""")
def u1(spark, sf):
    first = ops.first_register_places(view(spark, sf, "register"), _municipalities(spark, sf))
    second = ops.second_register_places(view(spark, sf, "graded").join(_spellings(spark, sf).select(F.col("place_id").alias("native_id"), "spellings"), "native_id"))
    both = [df.select("country", "native_id", "names") for df in (first, second)]
    return ops.combined(*both).select("country", "native_id", "place_id", F.col("names")[0]["written"].alias("name"),
                                      F.size("names").cast("long").alias("n_names"))


@query("A9_interned_attributes", cte("places") + """, seen AS (SELECT country, adm, region, min(place_id) AS first_seen
    FROM (SELECT place_id, country, CASE WHEN place_id % 11 = 0 THEN NULL ELSE adm END AS adm,
      CASE WHEN place_id % 11 = 0 OR place_id % 3 = 0 THEN NULL ELSE region END AS region FROM fx_places)
    WHERE adm IS NOT NULL OR region IS NOT NULL GROUP BY 1, 2, 3),
  dim AS (SELECT *, row_number() OVER (ORDER BY first_seen) AS muni FROM seen)
  SELECT p.place_id, p.country, d.adm, d.region, d.muni FROM fx_places p LEFT JOIN dim d ON d.country = p.country
    AND d.adm IS NOT DISTINCT FROM CASE WHEN place_id % 11 = 0 THEN NULL ELSE p.adm END
    AND d.region IS NOT DISTINCT FROM CASE WHEN place_id % 11 = 0 OR place_id % 3 = 0 THEN NULL ELSE p.region END""")
def a9(spark, sf):
    rows = view(spark, sf, "places").selectExpr(
        "place_id", "country", "CASE WHEN place_id % 11 = 0 THEN NULL ELSE adm END AS adm",
        "CASE WHEN place_id % 11 = 0 OR place_id % 3 = 0 THEN NULL ELSE region END AS region")
    keys = ["country", "adm", "region"]
    dimension = ops.interned(rows, keys, "place_id", "muni")
    return ops.with_interned(rows, dimension, keys, "muni").select("place_id", *keys, "muni")


# --------------------------------------------------------------- duplicates

_SQL_WIDTH = f"""greatest(CAST(floor({ops.BAND_E5} / cos(radians(least(
    least(abs(band), abs(band + 1)) * {float(ops.BAND_E5)}e0 / 1e5, 89e0)))) AS BIGINT), 1)"""
SQL_PAIRS = f"""celled AS (SELECT place_id, name, rank, kind, lat_e5, lon_e5, band, CAST(floor(lon_e5 / {_SQL_WIDTH}) AS BIGINT) AS cell
    FROM (SELECT *, CAST(floor(lat_e5 / {ops.BAND_E5}) AS BIGINT) AS band FROM fx_places)),
  anchored AS (SELECT *, min(place_id) OVER (PARTITION BY name, band, cell) AS anchor FROM celled),
  boxed AS (SELECT a.place_id AS ida, b.place_id AS idb, a.anchor AS anca, b.anchor AS ancb, a.lat_e5 / 1e5 AS a1,
      a.lon_e5 / 1e5 AS o1, b.lat_e5 / 1e5 AS a2, b.lon_e5 / 1e5 AS o2
    FROM anchored a JOIN anchored b ON a.name = b.name AND a.place_id < b.place_id
      AND abs(a.lat_e5 - b.lat_e5) <= 901 AND abs(a.lon_e5 - b.lon_e5) <= 2501),
  {sqlgeo.geodesic_cte('dist', 'boxed', 'a1', 'o1', 'a2', 'o2')},
  pairs AS (SELECT * FROM dist WHERE metres <= 1000)"""
SQL_CLUSTERS = SQL_PAIRS + """, edges AS (SELECT ida AS u, idb AS v FROM pairs UNION SELECT idb, ida FROM pairs),
  reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v),
  labels AS (SELECT u AS place_id, least(u, min(v)) AS cluster FROM reach GROUP BY u),
  doomed AS (SELECT place_id, cluster, kept_id FROM (SELECT place_id, cluster,
      first_value(place_id) OVER (PARTITION BY cluster ORDER BY rank, kind, place_id) AS kept_id
    FROM labels JOIN fx_places USING (place_id)) WHERE place_id <> kept_id)"""


@query("J4_proximity_links", cte("places") + f""", {SQL_PAIRS}
  SELECT 'member' AS link, anchor AS left_id, place_id AS right_id FROM anchored WHERE anchor <> place_id
  UNION ALL SELECT DISTINCT 'cell', least(anca, ancb), greatest(anca, ancb) FROM pairs WHERE anca <> ancb""")
def j4(spark, sf):
    return ops.proximity_links(view(spark, sf, "places"))


@query("A11_duplicate_clusters", cte("places") + f", {SQL_CLUSTERS} SELECT place_id, cluster FROM labels")
def a11(spark, sf):
    return ops.clusters(view(spark, sf, "places"))


@query("A12_keep_best", cte("places") + f", {SQL_CLUSTERS} SELECT place_id, cluster, kept_id FROM doomed")
def a12(spark, sf):
    places = view(spark, sf, "places")
    return ops.doomed_places(places, ops.clusters(places))


_SQL_KEPT = """
  kept AS (SELECT * FROM fx_places WHERE place_id NOT IN (SELECT place_id FROM doomed)),
  kept_aliases AS (SELECT * FROM aliases WHERE place_id NOT IN (SELECT place_id FROM doomed))"""
_SQL_SUMMARY = """
  SELECT 'places' AS key, (SELECT count(*) FROM kept) AS value UNION ALL SELECT 'places_se', count(*) FROM kept WHERE country = 0
  UNION ALL SELECT 'places_no', count(*) FROM kept WHERE country = 1 UNION ALL SELECT 'coord_scale', 100000
  UNION ALL SELECT 'aliases', count(*) FROM kept_aliases UNION ALL SELECT 'removed', count(*) FROM doomed
  UNION ALL SELECT 'names', (SELECT count(*) FROM kept) + (SELECT count(*) FROM kept_aliases)"""


@query("A10_build_summary", cte("places", "graded", "spellings") + f", {SQL_CLUSTERS}, {SQL_ALIASES}, {_SQL_KEPT} {_SQL_SUMMARY}")
def a10(spark, sf):
    places = view(spark, sf, "places")
    doomed = ops.doomed_places(places, ops.clusters(places))
    aliases = ops.without(ops.alias_rows(spelled_places(spark, sf)), doomed)
    return ops.build_summary(ops.without(places, doomed), aliases, doomed)


@query("U2_index_input", cte("places", "graded", "spellings") + f", {SQL_CLUSTERS}, {SQL_ALIASES}" + """
  SELECT place_id AS owner_id, name FROM fx_places WHERE place_id NOT IN (SELECT place_id FROM doomed)
  UNION ALL SELECT alias_id, name FROM aliases WHERE place_id NOT IN (SELECT place_id FROM doomed)""")
def u2(spark, sf):
    places = view(spark, sf, "places")
    doomed = ops.doomed_places(places, ops.clusters(places))
    aliases = ops.without(ops.alias_rows(spelled_places(spark, sf)), doomed)
    return search_ops.index_input(ops.without(places, doomed), aliases)


# --------------------------------------------------------------- files

def _xml_records(spark, sf):
    """The second register's records in the nested shape of its file."""
    return view(spark, sf, "graded").join(
        table(spark, sf, "part").selectExpr("p_partkey + 1 AS native_id", "p_name", "p_brand"), "native_id").selectExpr(
        "native_id AS stedsnummer", "main_group AS navneobjekthovedgruppe", "sub_group AS navneobjektgruppe",
        "sorting AS sortering", "priority AS `språkprioritering`",
        """named_struct(
            'Point', IF(native_id % 2 = 0, named_struct('pos', concat_ws(' ', cast(x as string), cast(y as string))), NULL),
            'LineString', IF(native_id % 2 = 1, named_struct('posList', concat_ws(' ', cast(x - 10 as string), cast(y + 20 as string),
              cast(x + 10 as string), cast(y - 20 as string))), NULL)) AS posisjon""",
        "named_struct('Kommune', named_struct('kommunenavn', adm, 'fylkesnavn', region)) AS kommune",
        """array(
          named_struct('Stedsnavn', named_struct('navnestatus', 'hovednavn', 'språk', 'norsk', 'skrivemåte', array(
            named_struct('Skrivemåte', named_struct('komplettskrivemåte', p_name, 'skrivemåtestatus', 'godkjent')),
            named_struct('Skrivemåte', named_struct('komplettskrivemåte', upper(p_name), 'skrivemåtestatus', 'vedtatt'))))),
          named_struct('Stedsnavn', named_struct('navnestatus', 'sidenavn', 'språk', 'nordsamisk', 'skrivemåte', array(
            named_struct('Skrivemåte', named_struct('komplettskrivemåte', concat(p_brand, ' ', p_name), 'skrivemåtestatus', 'uvurdert')))))
        ) AS stedsnavn""")


@query("S2_xml_register_scan", cte("graded") + f"""SELECT native_id, {_SQL_GRADE} AS rank, x, y, adm, region,
  CASE WHEN starts_with(coalesce(priority, 'norsk'), 'nordsamisk') THEN 2 ELSE 2 END AS n_names,
  upper(p_name) AS display FROM fx_graded JOIN part ON p_partkey + 1 = native_id""")
def s2(spark, sf):
    path = scratch_path(spark, "register-xml")
    write_register(_xml_records(spark, sf), path)
    places = read_register(spark, path)
    names = places.withColumn("names", ops.ranked_names(F.col("spellings"), F.col("priority")))
    return names.select("native_id", ops.graded_rank(F.coalesce("sorting", F.lit(""))).alias("rank"), "x", "y", "adm", "region",
                        F.size("names").alias("n_names"), F.col("names")[0]["written"].alias("display"))


@query("S11_bundle_sink", cte("places", "graded", "spellings") + f", {SQL_CLUSTERS}, {SQL_ALIASES}, {_SQL_KEPT}" + r""",
  named AS (SELECT place_id AS owner_id, name FROM kept UNION ALL SELECT alias_id, name FROM kept_aliases),
  terms AS (SELECT DISTINCT owner_id, unnest(string_split_regex(strip_accents(lower(name)), '[^\p{L}\p{N}]+')) AS term FROM named),
  munis AS (SELECT *, row_number() OVER (ORDER BY seen) AS muni FROM (SELECT country, adm, region, min(place_id) AS seen FROM fx_places GROUP BY ALL)),
  langs AS (SELECT *, row_number() OVER (ORDER BY seen) AS lang_id FROM (SELECT lang, min(alias_id) AS seen FROM aliases GROUP BY ALL))
  SELECT 'place' AS part, CAST(place_id AS BIGINT) AS key, concat_ws('|', kind, rank, lat_e5, lon_e5, country, muni, name) AS content
    FROM kept JOIN munis USING (country, adm, region)
  UNION ALL SELECT 'alias', alias_id, concat_ws('|', place_id, name, lang_id) FROM kept_aliases JOIN langs USING (lang)
  UNION ALL SELECT 'municipality', muni, concat_ws('|', country, adm, region) FROM munis
  UNION ALL SELECT 'language', lang_id, lang FROM langs
  UNION ALL SELECT 'term', owner_id, term FROM terms WHERE term <> ''
  UNION ALL SELECT 'meta', 0, concat_ws('|', key, value) FROM (""" + f"{_SQL_SUMMARY})")
def s11(spark, sf):
    places = view(spark, sf, "places")
    doomed = ops.doomed_places(places, ops.clusters(places))
    path = scratch_path(spark, "bundle")
    bundle.write_bundle(places, ops.alias_rows(spelled_places(spark, sf)), doomed, path)
    return bundle.bundle_rows(bundle.read_bundle(spark, path))
