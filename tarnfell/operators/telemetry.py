"""Tile-request telemetry: counters, latency histograms, rates and reports.

All of these are groupings with map-side partial aggregation; a source or a
layer that holds most of the log costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import fixed

BUCKETS = len(fixed.LATENCY_BOUNDS_MS) + 1
BUCKET_COLUMNS = [f"b{i}" for i in range(BUCKETS)]


def latency_bucket(ms: Column) -> Column:
    """Index of the right-closed latency bucket."""
    bucket = F.when(ms <= fixed.LATENCY_BOUNDS_MS[0], 0)
    for i, bound in enumerate(fixed.LATENCY_BOUNDS_MS[1:], start=1):
        bucket = bucket.when(ms <= bound, i)
    return bucket.otherwise(BUCKETS - 1)


def outcome_class(status: Column, mime: Column) -> Column:
    """Source label of a request from its final attempt; no status = transport error."""
    success = status.between(200, 299)
    return (F.when(success & mime.startswith("image/"), "network")
            .when(success, "unexpectedNoData")
            .when(status == 404, "expectedNoData")
            .when(status.isNull() | (status == 429) | (status >= 500), "failure")
            .otherwise("unexpectedNoData"))


def request_outcomes(attempts: DataFrame) -> DataFrame:
    """One row per request: outcome of its last attempt and the attempt count."""
    last = F.max_by(F.struct("status", "mime"), "attempt").alias("last")
    final = attempts.groupBy("request_id").agg(last, F.max("attempt").alias("attempts"))
    outcome = outcome_class(F.col("last.status"), F.coalesce(F.col("last.mime"), F.lit("")))
    return final.select("request_id", "attempts", outcome.alias("source"))


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests per layer, zoom and source."""
    return requests.groupBy("server", "z", "source").agg(F.count("*").alias("n"))


def layer_rollup(requests: DataFrame, layers: DataFrame) -> DataFrame:
    """Totals per layer and source (``z`` null) and by zoom; layers without requests stay."""
    sets = requests.groupingSets([["server", "source"], ["server", "z", "source"]], "server", "z", "source")
    counts = sets.agg(F.count("*").alias("n"))
    return (layers.select("server", "name").join(counts, "server", "left")
            .select("server", "name", "z", "source", F.coalesce("n", F.lit(0)).alias("n")))


def latency_histograms(requests: DataFrame) -> DataFrame:
    """Ten bucket counts per layer and source, and blended (``source`` = 'all')."""
    bucketed = requests.select("server", "source", latency_bucket(F.col("seconds") * 1000).alias("bucket"))
    counts = [F.count(F.when(F.col("bucket") == i, 1)).alias(c) for i, c in enumerate(BUCKET_COLUMNS)]
    sets = bucketed.groupingSets([["server", "source"], ["server"]], "server", "source")
    return sets.agg(*counts).withColumn("source", F.coalesce("source", F.lit("all")))


def repaired_histogram(histogram: Column) -> Column:
    """Padded with zeros or cut to the current number of buckets."""
    return F.slice(F.concat(histogram, F.array_repeat(F.lit(0).cast("long"), BUCKETS)), 1, BUCKETS)


def known_sources(by_source: Column) -> Column:
    """Histograms by source, without source names that are no longer known."""
    return F.map_filter(by_source, lambda name, _h: name.isin(fixed.SOURCES))


def histogram_percentile(histogram: Column, p: float) -> Column:
    """``struct(bound_ms, overflow)`` of the bucket holding the p-th sample; null when empty."""
    samples = F.aggregate(histogram, F.lit(0).cast("long"), lambda acc, n: acc + n)
    target = F.greatest(F.ceil(samples * F.lit(p)), F.lit(1))
    below = F.aggregate(
        histogram,
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("index")),
        lambda acc, n: F.struct(
            (acc["seen"] + n).alias("seen"),
            (acc["index"] + F.when(acc["seen"] + n < target, 1).otherwise(0)).alias("index")),
    )["index"]
    bounds = F.array(*[F.lit(b) for b in fixed.LATENCY_BOUNDS_MS])
    last = len(fixed.LATENCY_BOUNDS_MS)
    found = F.struct(
        F.element_at(bounds, F.least(below, F.lit(last - 1)) + 1).alias("bound_ms"),
        (below >= last).alias("overflow"))
    return F.when(samples > 0, found)


def latency_percentiles(histograms: DataFrame, ps: dict[str, float]) -> DataFrame:
    """Bound and overflow flag of each percentile, from bucket columns."""
    buckets = F.array(*BUCKET_COLUMNS)
    out = histograms.select("server", "source", buckets.alias("h"))
    for name, p in ps.items():
        out = out.withColumn(name, histogram_percentile(F.col("h"), p))
    flat = [c for name in ps for c in (F.col(f"{name}.bound_ms").alias(f"{name}_ms"),
                                       F.col(f"{name}.overflow").alias(f"{name}_overflow"))]
    samples = F.aggregate("h", F.lit(0).cast("long"), lambda acc, n: acc + n)
    return out.select("server", "source", samples.alias("samples"), *flat)


def service_rates(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Local hit rate over served requests, fault rate without expected gaps; null on nothing."""
    source = F.col("source")

    def count(names):
        return F.count(F.when(source.isin(names), 1))

    rates = requests.groupBy(*keys).agg(
        count(fixed.SERVED).alias("served"), count(fixed.SERVED_LOCALLY).alias("local"),
        count(fixed.FAULTS).alias("faults"),
        F.count(F.when(source != "expectedNoData", 1)).alias("considered"))
    return rates.select(
        *keys, "served", "considered",
        (F.col("local") / F.nullif("served", F.lit(0))).alias("local_hit_rate"),
        (F.col("faults") / F.nullif("considered", F.lit(0))).alias("fault_rate"))


def retry_accounting(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that needed a retry and the retries beyond the first attempt."""
    retried = F.col("attempts") > 1
    return requests.groupBy(*keys).agg(
        F.count(F.when(retried, 1)).alias("retried_requests"),
        F.coalesce(F.sum(F.when(retried, F.col("attempts").cast("long") - 1)), F.lit(0)).alias("retry_attempts"))


def source_report(requests: DataFrame) -> DataFrame:
    """Count, share and p50/p95 per layer and source; percentiles hidden under ten samples."""
    latencies = latency_percentiles(latency_histograms(requests), {"p50": 0.5, "p95": 0.95})
    totals = latencies.filter("source = 'all'").select("server", F.col("samples").alias("total"))
    rows = latencies.filter("source <> 'all'").join(totals, "server")
    enough = F.col("samples") >= fixed.MIN_REPORT_SAMPLES
    return rows.select(
        "server", "source", F.col("samples").alias("n"),
        F.round(F.col("samples") * 100.0 / F.col("total"), 4).alias("share_pct"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("p50_ms", "p50_overflow", "p95_ms", "p95_overflow")])
