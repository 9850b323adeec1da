"""Document, configuration and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfell.operators import documents as ops
from tarnfell.operators.ordered import counted_chunks
from tarnfell.plans.registry import query
from tarnfell.session import scratch_path
from tarnfell.sources import documents as docs
from tarnfell.sources.tables import table
from tarnfell.sources.views import cte, view

_DOCS = """SELECT o_orderkey, concat('{{"id":"r', CAST(o_orderkey AS VARCHAR(20)), '","createdAt":"2024-01-0', CAST(1 + o_orderkey % 9 AS VARCHAR(20)),
    'T10:00:00Z","meters":', CAST(o_custkey AS VARCHAR(20)), CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(',"name":"n', CAST(o_custkey AS VARCHAR(20)), '"') END,
    ',"elevations":[100.0,null,', CAST(o_custkey % 900 AS VARCHAR(20)), '.5],"coordinates":[{{"lat":60.5,"lon":', CAST(o_custkey % 30 AS VARCHAR(20)), '.25}}]',
    CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '}}' END) AS doc FROM {orders}"""


@query("S5_document_scan", """SELECT concat('r', o_orderkey) AS id, o_custkey * 1e0 AS meters, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('n', o_custkey) END AS name,
  3 AS n_heights, o_custkey % 900 + 0.5e0 AS last_height, o_custkey % 30 + 0.25e0 AS lon, CAST(NULL AS INT) AS schema_version FROM orders WHERE o_orderkey % 6 <> 0""")
def s5(spark, sf):
    path = scratch_path(spark, "documents")
    texts = spark.sql(_DOCS, orders=table(spark, sf, "orders")).select("doc")
    docs.write_lines(texts, path)
    texts.write.mode("append").text(path)  # other files in the directory are not documents
    found = docs.read_documents(spark, path, docs.SAVED_ROUTE, multi_line=False)
    return found.select("id", "meters", "name", F.size("elevations").alias("n_heights"), F.col("elevations")[2].alias("last_height"),
                        F.col("coordinates")[0]["lon"].alias("lon"), F.col("schemaVersion").alias("schema_version"))


@query("S6_catalogue_scan", """SELECT concat(p_name, '-', p_partkey, '-', k) AS id, p_name AS name, 2 AS n_pairs, p_retailprice AS first_lat, p_size + 0.5e0 AS last_lon
  FROM part, (VALUES (0), (1)) AS t(k)""")
def s6(spark, sf):
    path = scratch_path(spark, "catalogue")
    table(spark, sf, "part").selectExpr("1 AS schemaVersion", """transform(array(0, 1), k -> named_struct(
        'id', concat_ws('-', p_name, p_partkey, k), 'name', p_name, 'meters', p_retailprice,
        'coordinates', array(array(p_retailprice, 1.5D), array(2.5D), array(1D, 2D, 3D), array(7.5D, p_size + 0.5D)))) AS routes"""
                                        ).write.json(path)
    found = docs.read_catalogue(spark, path, multi_line=False)
    return found.select("id", "name", F.size("coordinates").alias("n_pairs"), F.col("coordinates")[0]["lat"].alias("first_lat"),
                        F.element_at("coordinates", -1)["lon"].alias("last_lon"))


_TEMPLATED = """SELECT DISTINCT server, z, x, y, CASE server WHEN 0 THEN 'https://tiles.example/{{z}}/{{x}}/{{y}}.png' WHEN 1 THEN 'ftp://tiles.example/{{z}}'
    WHEN 2 THEN 'HTTP://tiles.example:80/{{y}}?x={{x}}' WHEN 3 THEN 'https:///{{z}}' ELSE 'https://tiles.example/a b/{{z}}' END AS template FROM {tiles}"""


@query("P9_rendered_urls", cte("region_tiles") + f"""SELECT server, z, x, y, CASE WHEN regexp_matches(u, '(?i)^https?://[^/?#\\s]+\\S*$') THEN u
    ELSE concat('https://fallback.example/', z, '/', y, '/', x) END AS url
  FROM (SELECT *, replace(replace(replace(template, '{{z}}', CAST(z AS VARCHAR)), '{{x}}', CAST(x AS VARCHAR)), '{{y}}', CAST(y AS VARCHAR)) AS u
    FROM ({_TEMPLATED.format(tiles='fx_region_tiles')}))""")
def p9(spark, sf):
    rows = spark.sql(_TEMPLATED, tiles=view(spark, sf, "region_tiles"))
    url = ops.rendered_url(F.col("template"), F.lit("https://fallback.example/{z}/{y}/{x}"), F.col("z"), F.col("x"), F.col("y"))
    return rows.select("server", "z", "x", "y", url.alias("url"))


_CONFIGS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN '1.2' WHEN 1 THEN '1.2.3' WHEN 2 THEN '1' WHEN 3 THEN '1.2.3.4' WHEN 4 THEN '1.٢' ELSE '10.0' END AS version,
    concat(CASE WHEN page_id % 7 = 0 THEN replace(url, 'http', 'gopher') ELSE url END, CASE page_id % 5 WHEN 0 THEN '/{{z}}/{{x}}' ELSE '/{{z}}/{{x}}/{{y}}' END) AS template,
    CASE WHEN page_id % 11 = 0 THEN NULL ELSE 'https://b.example/{{z}}{{x}}{{y}}' END AS second FROM {pages}"""


@query("P10_valid_configurations", f"""SELECT page_id, regexp_full_match(version, '[0-9]+\\.[0-9]+(\\.[0-9]+)?') AND contains(template, '{{z}}') AND contains(template, '{{x}}')
    AND contains(template, '{{y}}') AND regexp_matches(template, '(?i)^https?://[^/?#\\s]+\\S*$') AND second IS NOT NULL AS valid FROM ({_CONFIGS.format(pages='pages')})""")
def p10(spark, sf):
    rows = spark.sql(_CONFIGS, pages=table(spark, sf, "pages"))
    return rows.select("page_id", ops.valid_configuration(F.col("version"), [F.col("template"), F.col("second")]).alias("valid"))


_NAMED = "CASE o_orderkey % 4 WHEN 0 THEN '   ' WHEN 1 THEN NULL ELSE concat(' ', o_orderpriority, ' ') END"


@query("P12_titles", f"""SELECT o_orderkey, nullif(trim(n), '') AS name, coalesce(nullif(trim(n), ''), strftime(o_orderdate, '%Y-%m-%d %H:%M')) AS route_title,
  coalesce(nullif(trim(n), ''), '') AS pin_title FROM (SELECT *, {_NAMED} AS n FROM orders)""")
def p12(spark, sf):
    n = F.expr(_NAMED)
    return table(spark, sf, "orders").select("o_orderkey", ops.normalised_name(n).alias("name"),
                                             ops.route_title(n, F.col("o_orderdate")).alias("route_title"), ops.pin_title(n).alias("pin_title"))


@query("P13_distance_labels", cte("requests") + """SELECT request_id, CASE WHEN m < 1000 THEN concat(CAST(round(m) AS BIGINT), ' m')
  ELSE printf('%.2f km', m / 1000) END AS label, concat(CAST(round(m / 1000) AS BIGINT), ' km') AS marker FROM (SELECT request_id, seconds * 7013.7e0 AS m FROM fx_requests)""")
def p13(spark, sf):
    m = F.col("seconds") * 7013.7
    return view(spark, sf, "requests").select("request_id", ops.distance_label(m).alias("label"), ops.marker_label(m).alias("marker"))


@query("P15_stable_ids", """SELECT p_partkey, concat(d[1:8], '-', d[9:12], '-', d[13:16], '-', d[17:20], '-', d[21:32]) AS id FROM (
  SELECT p_partkey, rpad(substr(lower(hex(encode(concat(p_name, 'å', p_brand)))), 1, 32), 32, '0') AS d FROM part)""")
def p15(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ops.stable_id(F.concat("p_name", F.lit("å"), "p_brand")).alias("id"))


_TIMELINE = """SELECT user_id % 3 AS channel, event_id, ts, CASE WHEN event_type = 'signup' THEN concat('1.', CAST(event_id AS VARCHAR(20))) END AS version,
    event_type = 'signup' AND event_id % 5 <> 0 AS valid FROM {events}"""


@query("J14_configuration_in_effect", f"""SELECT channel, event_id, coalesce(last_value(CASE WHEN valid THEN version END IGNORE NULLS) OVER (PARTITION BY channel
  ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '1.0') AS in_effect FROM ({_TIMELINE.format(events='events')})""")
def j14(spark, sf):
    timeline = counted_chunks(spark.sql(_TIMELINE, events=table(spark, sf, "events")), ["channel"], ["ts", "event_id"])
    found = ops.configuration_in_effect(timeline, "channel", ["ts", "event_id"], "_chunk", "1.0")
    return found.select("channel", "event_id", "in_effect")


@query("W9_latest_documents", """SELECT o_custkey AS id, o_orderkey AS write_id, strftime(o_orderdate, '%Y-%m-%d') AS created, o_totalprice AS metres FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def w9(spark, sf):
    writes = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("write_id"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("metres"))
    latest = ops.latest_per_id(writes, "id", ["created", "write_id"])
    return ops.newest_first(latest, ["created", "id"]).withColumn("created", F.date_format("created", "yyyy-MM-dd"))


@query("A25_free_route_number", """WITH taken AS (SELECT DISTINCT o_custkey, 1 + o_orderkey % 6 AS n FROM orders WHERE o_orderkey % 9 <> 0),
  every AS (SELECT DISTINCT o_custkey FROM orders) SELECT o_custkey, min(c.n) AS free_number FROM every, (SELECT unnest(range(CAST(1 AS BIGINT), 9)) AS n) c
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.o_custkey = every.o_custkey AND t.n = c.n) GROUP BY o_custkey""")
def a25(spark, sf):
    named = table(spark, sf, "orders").selectExpr(
        "o_custkey", "IF(o_orderkey % 9 = 0, 'My trip', concat('Route ', 1 + o_orderkey % 6)) AS title")
    number = F.coalesce(F.regexp_extract("title", r"^Route (\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    return ops.smallest_free_number(named.select("o_custkey", number.alias("n")), "o_custkey", "n")
