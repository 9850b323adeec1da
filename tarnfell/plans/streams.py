"""Streaming queries: each drains the table as a file stream and returns what the stream produced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.operators import documents as document_ops
from tarnfell.plans.engagement import PROMPT_GAP_DAYS, SQL_MACHINE
from tarnfell.plans.registry import query
from tarnfell.plans.routes import _LOG
from tarnfell.plans.telemetry import SQL_BUCKET
from tarnfell.session import scratch_path
from tarnfell.sources import documents as docs
from tarnfell.sources.tables import is_folder, remove_folder, table
from tarnfell.sources.views import VIEWS, cte
from tarnfell.streaming import metrics, sinks, stateful

RESETS = ["2024-01-10 00:00:00", "2024-01-20 12:00:00"]


def event_stream(spark: SparkSession, sf: str, files_per_trigger: int = 1000) -> DataFrame:
    """The events table as a stream of files: those in its folder, or the one file it is."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = f"{sf}/events.parquet"
    return stream.parquet(path) if is_folder(spark, path) else stream.option("pathGlobFilter", "events.parquet").parquet(sf)


def view_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name], events=event_stream(spark, sf))


def drained(spark: SparkSession, stream: DataFrame, label: str, mode: str) -> DataFrame:
    """Rows the stream emitted; update mode keeps the batch number to tell old from new."""
    path = scratch_path(spark, label)
    sinks.drain(stream, f"{path}/rows", f"{path}/checkpoint", mode)
    rows = sinks.emitted(spark, f"{path}/rows", stream.schema)
    return rows if mode == "update" else rows.drop("batch_id")


@query("M1_running_metrics", cte("requests") + f"""SELECT CASE WHEN ts >= TIMESTAMP '{RESETS[1]}' THEN 2 WHEN ts >= TIMESTAMP '{RESETS[0]}' THEN 1 ELSE 0 END AS epoch,
  server, z, source, count(*) AS n, count(*) FILTER (WHERE attempts > 1) AS retried_requests, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retry_attempts,
  {', '.join(f'count(*) FILTER (WHERE bucket = {i}) AS b{i}' for i in range(10))} FROM (SELECT *, {SQL_BUCKET} AS bucket FROM fx_requests) GROUP BY 1, 2, 3, 4""")
def m1(spark, sf):
    updates = drained(spark, metrics.running_metrics(view_stream(spark, sf, "requests"), RESETS), "m1", "update")
    return sinks.latest_state(updates, metrics.RUNNING_KEYS)


@query("M2_windowed_metrics", cte("requests") + """SELECT * FROM (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, server, source, count(*) AS n FROM fx_requests GROUP BY 1, 2, 3)
  WHERE start_us + 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM fx_requests)""")
def m2(spark, sf):
    return drained(spark, metrics.windowed_metrics(view_stream(spark, sf, "requests")), "m2", "append")


#: Polls that the events come in, and how many seconds late an event comes at most.
_POLLS, _LATE_SECONDS = 4, 86_400
#: What the watermark has passed at the end; the stream has it in milliseconds.
_PASSED = f"us <= (SELECT max(epoch_ms(ts)) - {_LATE_SECONDS * 1000} FROM fx_app_events) * 1000"


def fed_late(spark: SparkSession, sf: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream emits of a view whose events come late, up to ``_LATE_SECONDS``, and so in mixed order over several polls."""
    events, base = table(spark, sf, "events"), scratch_path(spark, "late")
    delay = F.pmod(F.hash("event_id"), F.lit(_LATE_SECONDS)).cast("long") * 1_000_000
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + delay
    first, last = events.select(F.min(arrival), F.max(arrival)).first()
    first, last = first or 0, last or 0
    poll = F.least(F.floor((arrival - F.lit(first)) / F.lit(max(last - first, 1)) * _POLLS), F.lit(_POLLS - 1))
    for number in range(_POLLS):
        events.filter(poll == number).write.mode("append").parquet(f"{base}/in")
        given = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        stream = build(spark.sql(VIEWS[name], events=given))
        sinks.drain(stream, f"{base}/rows", f"{base}/checkpoint", "append")
    return sinks.emitted(spark, f"{base}/rows", stream.schema).drop("batch_id")


@query("M3_open_sessions", cte("app_events") + f", {SQL_MACHINE} SELECT user_id, event_id, us, is_open FROM machine WHERE kind = 'active' AND {_PASSED}")
def m3(spark, sf):
    sinks.use_rocksdb(spark)
    return fed_late(spark, sf, "app_events", lambda s: stateful.open_sessions(s, lateness=f"{_LATE_SECONDS} seconds"))


@query("M4_prompt_machine", cte("app_events") + f", {SQL_MACHINE} SELECT user_id, event_id, us, app_version, number FROM machine WHERE prompted AND {_PASSED}")
def m4(spark, sf):
    sinks.use_rocksdb(spark)
    return fed_late(spark, sf, "app_events", lambda s: stateful.prompt_machine(s, PROMPT_GAP_DAYS, lateness=f"{_LATE_SECONDS} seconds"))


@query("M5_stroke_stream", f"""WITH RECURSIVE log AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS i FROM ({_LOG.format(events='events')})),
  fold(route_id, i, seq, stack) AS (SELECT route_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS INT[]) FROM log GROUP BY route_id
    UNION ALL SELECT l.route_id, l.i, l.seq, CASE WHEN op = 'clear' THEN CAST([] AS INT[]) WHEN op = 'undo' THEN stack[1:len(stack) - 1]
      WHEN size >= 2 THEN list_append(stack, size) ELSE stack END FROM fold f JOIN log l ON l.route_id = f.route_id AND l.i = f.i + 1)
  SELECT route_id, CAST(len(stack) AS INT) AS n_strokes, CAST(coalesce(list_sum(stack), 0) AS INT) AS n_vertices, seq AS last_seq FROM fold
  QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY i DESC) = 1""")
def m5s(spark, sf):
    sinks.use_rocksdb(spark)
    log = spark.sql(_LOG, events=event_stream(spark, sf))
    return sinks.latest_state(drained(spark, stateful.stroke_logs(log), "m5", "update"), ["route_id"])


#: Files of the feed, and which of them are deleted, or rewritten with the writes since the day.
_FEED_FILES, _FEED_DAY = 20, "1997-01-01"
_FEED_GONE, _FEED_AGAIN = "file % 5 = 0", "file % 3 = 1"


@query("M6_document_feed", f"""SELECT id, write_id, metres FROM (SELECT concat('r', o_custkey) AS id, o_orderkey AS write_id, o_totalprice AS metres, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM (SELECT *, o_custkey % {_FEED_FILES} AS file FROM orders)
  WHERE NOT ({_FEED_GONE}) AND ({_FEED_AGAIN} OR o_orderdate < DATE '{_FEED_DAY}')) WHERE rn = 1""")
def m6(spark, sf):
    path, log = scratch_path(spark, "feed"), scratch_path(spark, "feed-log")
    writes = table(spark, sf, "orders").selectExpr(
        "concat('r', o_custkey) AS id", "cast(o_orderdate AS timestamp) AS createdAt", "o_totalprice AS meters",
        "cast(o_orderkey AS int) AS schemaVersion", f"o_custkey % {_FEED_FILES} AS file")

    def put(rows: DataFrame) -> None:
        """Write files anew, and only those that have rows."""
        rows.hint("rebalance", "file").write.partitionBy("file").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)

    put(writes.filter(f"createdAt < '{_FEED_DAY}'"))
    docs.poll(spark, path, docs.SAVED_ROUTE, log, 0, multi_line=False)
    put(writes.filter(_FEED_AGAIN))
    for file in range(_FEED_FILES):
        if file % 5 == 0:
            remove_folder(spark, f"{path}/file={file}")
    docs.poll(spark, path, docs.SAVED_ROUTE, log, 1, multi_line=False)
    current = document_ops.latest_per_id(
        docs.fed_documents(spark, docs.SAVED_ROUTE, log).select("id", "createdAt", "schemaVersion", "meters"), "id", ["createdAt", "schemaVersion"])
    return current.select("id", F.col("schemaVersion").cast("long").alias("write_id"), F.col("meters").alias("metres"))
