"""App engagement queries."""

from __future__ import annotations

from tarnfell.operators import engagement as ops
from tarnfell.plans.registry import query
from tarnfell.sources.tables import table
from tarnfell.sources.views import cte, view

PROMPT_GAP_DAYS = 5

_EDITS = """SELECT user_id, event_id, ts, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN ' b ' ELSE concat(event_type, props) END AS text FROM {events}"""


@query("W10_debounced_edits", f"""SELECT user_id, event_id, CASE WHEN length(trim(text)) >= 2 THEN text END AS query
  FROM (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM ({_EDITS.format(events='events')}))
  WHERE nxt IS NULL OR nxt - epoch_us(ts) >= 14400000000""")
def w10(spark, sf):
    return ops.debounced(spark.sql(_EDITS, events=table(spark, sf, "events")), 4 * 3600 * 1_000_000)


# The reference's state machine as a recursive fold over each user's events in order.
SQL_MACHINE = f"""ordered AS MATERIALIZED (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM fx_app_events),
  machine(user_id, i, event_id, us, kind, app_version, meters, launched, bg, opens, downloads, measurements, is_open, last_version, last_us, number, prompted, eligible) AS (
    SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0e0, false, CAST(NULL AS BIGINT), 0, 0, 0, false,
      CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), 0, false, false FROM ordered GROUP BY user_id
    UNION ALL SELECT user_id, i, event_id, us, kind, app_version, meters, launched, bg, opens, downloads, measurements, is_open,
      CASE WHEN prompted THEN app_version ELSE last_version END, CASE WHEN prompted THEN us ELSE last_us END,
      CASE WHEN prompted THEN number + 1 ELSE number END, prompted, eligible FROM (
      SELECT *, eligible AND (last_version IS NULL OR last_version <> app_version) AND (last_us IS NULL OR us - last_us >= {PROMPT_GAP_DAYS} * 86400000000) AS prompted FROM (
      SELECT *, success AND opens >= 3 AND (downloads >= 1 OR measurements >= 3) AS eligible FROM (
      SELECT o.user_id, o.i, o.event_id, o.us, o.kind, o.app_version, o.meters, m.launched OR o.kind = 'active' AS launched,
        CASE WHEN o.kind = 'background' THEN o.us WHEN o.kind = 'active' AND m.launched THEN NULL ELSE m.bg END AS bg,
        m.opens + CASE WHEN o.kind = 'active' AND (NOT m.launched OR (m.bg IS NOT NULL AND o.us - m.bg >= 1800000000)) THEN 1 ELSE 0 END AS opens,
        o.kind = 'active' AND (NOT m.launched OR (m.bg IS NOT NULL AND o.us - m.bg >= 1800000000)) AS is_open,
        m.downloads + CASE WHEN o.kind = 'download_complete' THEN 1 ELSE 0 END AS downloads,
        m.measurements + CASE WHEN o.kind = 'measurement' AND o.meters >= 500 THEN 1 ELSE 0 END AS measurements,
        o.kind = 'download_complete' OR (o.kind = 'measurement' AND o.meters >= 500) AS success, m.last_version, m.last_us, m.number
      FROM machine m JOIN ordered o ON o.user_id = m.user_id AND o.i = m.i + 1))))"""


@query("W11_app_opens", cte("app_events") + f", {SQL_MACHINE} SELECT user_id, event_id, us, is_open FROM machine WHERE kind = 'active'")
def w11(spark, sf):
    return ops.app_opens(view(spark, sf, "app_events"))


@query("W12_eligible_moments", cte("app_events") + f""", {SQL_MACHINE} SELECT user_id, event_id, us, app_version, CAST(opens AS BIGINT) AS opens,
  CAST(downloads AS BIGINT) AS downloads, CAST(measurements AS BIGINT) AS measurements, eligible FROM machine
  WHERE kind = 'download_complete' OR (kind = 'measurement' AND meters >= 500)""")
def w12(spark, sf):
    return ops.eligible_moments(view(spark, sf, "app_events"))


@query("W13_prompts", cte("app_events") + f", {SQL_MACHINE} SELECT user_id, event_id, us, app_version, number FROM machine WHERE prompted")
def w13(spark, sf):
    return ops.prompts(ops.eligible_moments(view(spark, sf, "app_events")), PROMPT_GAP_DAYS)
