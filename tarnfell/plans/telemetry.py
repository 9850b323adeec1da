"""Queries over the tile request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfell.functions import fixed
from tarnfell.operators import telemetry as ops
from tarnfell.plans.registry import query
from tarnfell.sources.tables import table
from tarnfell.sources.views import cte, view

SQL_LAYERS = "layers(server, name, max_z, offline_min_z, offline_max_z, is_slope, is_data) AS (VALUES " + ", ".join(
    f"({s}, '{n}', {m}, {lo}, {hi}, {sl}, {da})" for s, n, m, lo, hi, sl, da in fixed.LAYERS) + ")"
SQL_BUCKET = "CASE " + " ".join(
    f"WHEN seconds * 1000 <= {b} THEN {i}" for i, b in enumerate(fixed.LATENCY_BOUNDS_MS)) + " ELSE 9 END"
SQL_BUCKET_COUNTS = ", ".join(f"count(*) FILTER (WHERE bucket = {i}) AS b{i}" for i in range(10))
SQL_HISTOGRAMS = f"""bucketed AS (SELECT server, source, {SQL_BUCKET} AS bucket FROM fx_requests),
  hist AS (SELECT server, coalesce(source, 'all') AS source, {SQL_BUCKET_COUNTS}
    FROM bucketed GROUP BY GROUPING SETS ((server, source), (server))) """


def _sql_names(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _sql_percentile(p):
    """Percentile of a histogram as window sums over its long form."""
    return f"""(SELECT server, source, min(CASE WHEN seen >= greatest(ceil(total * {p}e0), 1) THEN bucket END) AS i
      FROM cum GROUP BY server, source)"""


SQL_LONG = """long AS (SELECT server, source, bucket, count(*) AS n FROM bucketed GROUP BY 1, 2, 3
    UNION ALL SELECT server, 'all', bucket, count(*) FROM bucketed GROUP BY 1, 3),
  cum AS (SELECT server, source, bucket, sum(n) OVER (PARTITION BY server, source ORDER BY bucket) AS seen,
    sum(n) OVER (PARTITION BY server, source) AS total FROM long) """
_BOUND = "CASE least({i}, 8) " + " ".join(
    f"WHEN {i} THEN {b}" for i, b in enumerate(fixed.LATENCY_BOUNDS_MS)) + " END"


def _sql_bound(i):
    return _BOUND.replace("{i}", i)


@query("A1_request_counters", cte("requests") +
       "SELECT server, z, source, count(*) AS n FROM fx_requests GROUP BY ALL")
def a1(spark, sf):
    return ops.request_counters(view(spark, sf, "requests"))


@query("A2_layer_rollup", cte("requests") + f""", {SQL_LAYERS}, g AS (
    SELECT server, z, source, count(*) AS n FROM fx_requests
    GROUP BY GROUPING SETS ((server, source), (server, z, source)))
  SELECT l.server, name, z, source, coalesce(n, 0) AS n FROM layers l LEFT JOIN g ON g.server = l.server""")
def a2(spark, sf):
    return ops.layer_rollup(view(spark, sf, "requests"), fixed.layers(spark))


@query("A3_latency_histograms", cte("requests") + ", " + SQL_HISTOGRAMS + "SELECT * FROM hist")
def a3(spark, sf):
    return ops.latency_histograms(view(spark, sf, "requests"))


@query("A4_histogram_percentiles", cte("requests") + ", " + SQL_HISTOGRAMS + ", " + SQL_LONG + f"""
  SELECT a.server, a.source, CAST(t.total AS BIGINT) AS samples,
    {_sql_bound('a.i')} AS p50_ms, a.i > 8 AS p50_overflow, {_sql_bound('b.i')} AS p95_ms, b.i > 8 AS p95_overflow,
    {_sql_bound('c.i')} AS p99_ms, c.i > 8 AS p99_overflow
  FROM {_sql_percentile(0.5)} a JOIN {_sql_percentile(0.95)} b USING (server, source)
  JOIN {_sql_percentile(0.99)} c USING (server, source)
  JOIN (SELECT DISTINCT server, source, total FROM cum) t USING (server, source)""")
def a4(spark, sf):
    histograms = ops.latency_histograms(view(spark, sf, "requests"))
    return ops.latency_percentiles(histograms, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("A5_histogram_repair", "SELECT event_id, " + ", ".join(
    f"CAST(coalesce(h[{i + 1}], 0) AS BIGINT) AS b{i}" for i in range(10)) + """,
    CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS kept_sources
  FROM (SELECT event_id, list_transform(range(1, 2 + event_id % 14), lambda i: (event_id * i) % 50) AS h FROM events)""")
def a5(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id",
        F.expr("transform(sequence(1, 1 + event_id % 14), i -> (event_id * i) % 50)").alias("h"),
        F.expr("""map_from_arrays(
            array(IF(event_id % 3 = 0, 'network', 'legacyA'), IF(event_id % 2 = 0, 'failure', 'legacyB')),
            array(array(1L), array(2L)))""").alias("by_source"))
    fixed_up = raw.select("event_id", ops.repaired_histogram(F.col("h")).alias("h"),
                          F.size(ops.known_sources(F.col("by_source"))).alias("kept_sources"))
    return fixed_up.select("event_id", *[F.col("h")[i].alias(f"b{i}") for i in range(10)], "kept_sources")


@query("A6_service_rates", cte("requests") + f"""
  SELECT server, z, count(*) FILTER (WHERE source IN {_sql_names(fixed.SERVED)}) AS served,
    count(*) FILTER (WHERE source <> 'expectedNoData') AS considered,
    count(*) FILTER (WHERE source IN {_sql_names(fixed.SERVED_LOCALLY)})
      / nullif(count(*) FILTER (WHERE source IN {_sql_names(fixed.SERVED)}), 0) AS local_hit_rate,
    count(*) FILTER (WHERE source IN {_sql_names(fixed.FAULTS)})
      / nullif(count(*) FILTER (WHERE source <> 'expectedNoData'), 0) AS fault_rate
  FROM fx_requests GROUP BY server, z""")
def a6(spark, sf):
    return ops.service_rates(view(spark, sf, "requests"), ["server", "z"])


@query("A7_retry_accounting", cte("requests") + """
  SELECT server, z, count(*) FILTER (WHERE attempts > 1) AS retried_requests,
    CAST(coalesce(sum(attempts - 1) FILTER (WHERE attempts > 1), 0) AS BIGINT) AS retry_attempts
  FROM fx_requests GROUP BY server, z""")
def a7(spark, sf):
    return ops.retry_accounting(view(spark, sf, "requests"), ["server", "z"])


@query("A8_source_report", cte("requests") + ", " + SQL_HISTOGRAMS + ", " + SQL_LONG + f"""
  SELECT a.server, a.source, CAST(t.total AS BIGINT) AS n, round(t.total * 100e0 / w.total, 4) AS share_pct,
    CASE WHEN t.total >= 10 THEN {_sql_bound('a.i')} END AS p50_ms, CASE WHEN t.total >= 10 THEN a.i > 8 END AS p50_overflow,
    CASE WHEN t.total >= 10 THEN {_sql_bound('b.i')} END AS p95_ms, CASE WHEN t.total >= 10 THEN b.i > 8 END AS p95_overflow
  FROM {_sql_percentile(0.5)} a JOIN {_sql_percentile(0.95)} b USING (server, source)
  JOIN (SELECT DISTINCT server, source, total FROM cum) t USING (server, source)
  JOIN (SELECT DISTINCT server, total FROM cum WHERE source = 'all') w ON w.server = a.server
  WHERE a.source <> 'all'""")
def a8(spark, sf):
    return ops.source_report(view(spark, sf, "requests"))


_ATTEMPTS = """SELECT CAST(floor(event_id / 3.0) AS BIGINT) AS request_id, CAST(1 + event_id % 3 AS INT) AS attempt,
    CASE (event_id * 7 + user_id) % 8 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 429
      WHEN 4 THEN 400 WHEN 5 THEN NULL WHEN 6 THEN 204 ELSE 301 END AS status,
    CASE user_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' ELSE NULL END AS mime FROM {events}"""


@query("P11_request_outcomes", f"""SELECT request_id, attempt AS attempts,
    CASE WHEN status BETWEEN 200 AND 299 AND coalesce(mime, '') LIKE 'image/%' THEN 'network'
      WHEN status BETWEEN 200 AND 299 THEN 'unexpectedNoData' WHEN status = 404 THEN 'expectedNoData'
      WHEN status IS NULL OR status = 429 OR status >= 500 THEN 'failure' ELSE 'unexpectedNoData' END AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC) AS rn
        FROM ({_ATTEMPTS.format(events='events')})) WHERE rn = 1""")
def p11(spark, sf):
    attempts = spark.sql(_ATTEMPTS, events=table(spark, sf, "events"))
    return ops.request_outcomes(attempts)
