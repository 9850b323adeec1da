"""Brute force, skewed inputs, and stream = batch."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.functions import geo
from tarnfell.operators import components, engagement, gazetteer, ordered, raster, routes, skew
from tarnfell.session import scratch_path
from tarnfell.streaming import metrics, sinks, stateful


def test_projection_round_trip(spark):
    rows = spark.range(2000).select((5 + F.col("id") % 50 / 2).alias("lon"), (55 + F.col("id") / 125.0).alias("lat"))
    staged = geo.with_projection(rows, F.col("lon"), F.col("lat"), "e", "n")
    direct = geo.project(F.col("lon"), F.col("lat"))
    lon, lat = geo.unproject(F.col("e"), F.col("n"))
    worst = staged.select(
        F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat"))),
        F.max(F.abs(direct[0] - F.col("e"))), F.max(F.abs(direct[1] - F.col("n")))).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9 and worst[2] < 1e-6 and worst[3] < 1e-6


def brute_clusters(spark, rows, radius=1000.0):
    """Union-find over all same-name pairs, distances from the iterative solution."""
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1:] if a[1] == b[1] and abs(a[2] - b[2]) <= 950]
    measured = spark.createDataFrame([(a[0], b[0], a[2], a[3], b[2], b[3]) for a, b in pairs], "i long, j long, a long, b long, c long, d long")
    near = measured.filter(geo._vincenty_m(F.col("a") / 1e5, F.col("b") / 1e5, F.col("c") / 1e5, F.col("d") / 1e5) <= radius)
    parent = {}

    def find(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            n = parent[n]
        return n

    for r in near.select("i", "j").collect():
        a, b = find(r["i"]), find(r["j"])
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(parent)}


@pytest.mark.parametrize("lat0", [6_000_000, 100, 7_800_000, -3_300_000])
def test_clusters_equal_all_pairs(spark, lat0):
    rng = random.Random(lat0)
    rows = [(i + 1, rng.choice("ab"), lat0 + rng.randrange(12_000), 1_500_000 + rng.randrange(30_000)) for i in range(260)]
    rows += [(1000 + i, "a", lat0 + 1700 * i // 2, 1_560_000) for i in range(20)]  # a chain at the reach of the radius
    places = spark.createDataFrame(rows, "place_id long, name string, lat_e5 long, lon_e5 long")
    found = {r["place_id"]: r["cluster"] for r in gazetteer.clusters(places).collect()}
    expected = brute_clusters(spark, [r for r in rows])
    assert found == expected


def test_copies_of_one_place_are_linked_once_each(spark):
    copies = spark.range(30_000).select((F.col("id") + 1).alias("place_id"), F.lit("Storvatnet").alias("name"),
                                        (F.lit(6_000_000) + F.col("id") % 3).alias("lat_e5"), F.lit(1_500_000).alias("lon_e5"))
    links = gazetteer.proximity_links(copies)
    assert links.count() == 29_999


def test_components_of_a_long_chain(spark):
    chain = spark.range(3000).select((F.col("id") * 7 % 3001).alias("left_id"), ((F.col("id") + 1) * 7 % 3001).alias("right_id"))
    labels = components.min_labels(chain)
    assert labels.select("label").distinct().collect()[0][0] == 0 and labels.count() == 3001


def test_ordered_helpers_equal_plain_windows_on_a_hot_key(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"), F.floor(F.col("id") / 512).alias("c"))
    plain = Window.partitionBy("k").orderBy("o")
    upto = plain.rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1)
    total = ordered.running_totals(rows, ["k"], "c", ["o"], {"n": one}).select("k", "o", "n")
    assert total.exceptAll(rows.select("k", "o", F.count("*").over(upto).alias("n"))).isEmpty()
    before = ordered.previous_value(rows, ["k"], "c", ["o"], F.col("v"), "p").select("k", "o", "p")
    assert before.exceptAll(rows.select("k", "o", F.lag("v").over(plain).alias("p"))).isEmpty()
    last = ordered.previous_value(rows, ["k"], "c", ["o"], F.col("v"), "p", skip_null=True, include_current=True).select("k", "o", "p")
    assert last.exceptAll(rows.select("k", "o", F.last("v", ignorenulls=True).over(upto).alias("p"))).isEmpty()
    after = ordered.next_value(rows, ["k"], "c", ["o"], F.col("o"), "p").select("k", "o", "p")
    assert after.exceptAll(rows.select("k", "o", F.lead("o").over(plain).alias("p"))).isEmpty()


def test_dense_ids(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5003).alias("native"), (F.col("id") % 2).alias("country"))
    numbered = ordered.dense_ids(rows, "native", "n", major=["country"], width=64)
    expected = rows.withColumn("n", F.row_number().over(Window.orderBy("country", "native")))
    assert numbered.select("native", "country", "n").exceptAll(expected.select("native", "country", F.col("n").cast("long"))).isEmpty()


def test_exact_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = {k: rng.normal(10, 5, n) for k, n in (("a", 1001), ("b", 7), ("c", 1))}
    frame = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    ps = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    for row in raster.exact_percentiles(frame, ["k"], "v", ps).collect():
        for name, p in ps.items():
            assert row[name] == pytest.approx(np.percentile(values[row["k"]], p * 100), abs=1e-9)


def test_slope_of_blocks_equals_one_block(spark):
    rng = np.random.default_rng(5)
    cells = [(int(r), int(c), None if rng.random() < 0.05 else float(rng.integers(0, 200))) for r in range(40) for c in range(37)]
    frame = spark.createDataFrame(cells, "row int, col int, height double")
    small, large = raster.horn_slope(frame, block=8), raster.horn_slope(frame, block=64)
    assert small.count() == len(cells) and small.exceptAll(large).isEmpty()


def test_pyramid_parents_are_not_below_children(spark):
    classes = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"),
                                          (F.hash("id") % 6).cast("int").alias("class")).filter("class >= 0")
    levels = raster.overview_pyramid(classes, 13, 10)
    child = levels.select((F.col("z") - 1).alias("z"), F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col"), F.col("class").alias("child"))
    joined = child.filter("z >= 10").join(levels, ["z", "row", "col"], "left")
    assert joined.filter("class IS NULL OR class < child").isEmpty()


def plain_simplify(points, tolerance):
    def distance(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        if dx == 0 and dy == 0:
            return math.hypot(p[0] - a[0], p[1] - a[1])
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    if len(points) < 3:
        return points
    d = [distance(p, points[0], points[-1]) for p in points[1:-1]]
    if max(d) <= tolerance:
        return [points[0], points[-1]]
    cut = d.index(max(d)) + 1
    return plain_simplify(points[:cut + 1], tolerance)[:-1] + plain_simplify(points[cut:], tolerance)


def test_simplified_lines_equal_recursion(spark):
    rng = random.Random(2)
    lines = {r: [(rng.randrange(3000), rng.randrange(3000)) for _ in range(n)] for r, n in ((1, 60), (2, 2), (3, 1), (4, 15))}
    lines[5] = [(i * 100, 0) for i in range(20)]
    frame = spark.createDataFrame([(r, i, y, x) for r, ps in lines.items() for i, (x, y) in enumerate(ps)],
                                  "route_id long, seq long, lat_e5 long, lon_e5 long")
    found = {}
    for row in routes.simplified(frame, 400.0).orderBy("route_id", "seq").collect():
        found.setdefault(row["route_id"], []).append((row["lon_e5"], row["lat_e5"]))
    assert found == {r: plain_simplify(ps, 400.0) for r, ps in lines.items()}


def test_resampling_does_not_depend_on_vertex_density(spark):
    ends = [(1, 0, 6_000_000, 1_500_000), (1, 1, 6_004_000, 1_500_000)]
    dense = [(2, i, 6_000_000 + i * 100, 1_500_000) for i in range(41)]
    frame = spark.createDataFrame(ends + dense, "route_id long, seq long, lat_e5 long, lon_e5 long")
    rows = routes.resampled(frame).orderBy("route_id", "k").collect()
    sparse, thick = ([(r["distance"], r["lat"]) for r in rows if r["route_id"] == i] for i in (1, 2))
    assert len(sparse) == len(thick)
    assert all(abs(a[0] - b[0]) < 1e-3 and abs(a[1] - b[1]) < 1e-6 for a, b in zip(sparse, thick))


# --------------------------------------------------------------- streams

def app_log(spark, n=3000):
    """A log in which one user owns a third of the events."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 17).cast("long").alias("user_id"), F.col("id").alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 613)").alias("ts"),
        F.element_at(F.array(*[F.lit(k) for k in ("active", "background", "measurement", "download_complete", "download_failed")]),
                     (F.pmod(F.hash("id"), F.lit(5)) + 1).cast("int")).alias("kind"),
        (F.col("id") % 40 * 40.0).alias("meters"), F.concat(F.lit("1."), F.floor(F.col("id") / 700).cast("string")).alias("app_version"))


def staged(spark, log, parts):
    """The log cut along time into parts, to be fed to a stream one after the other."""
    size = log.count() // parts + 1
    return [log.filter(F.floor(F.col("event_id") / size) == i) for i in range(parts)]


def feed(spark, log, build, mode, parts=3):
    """Run the stream once per part with the same checkpoint, as restarts would."""
    base = scratch_path(spark, "feed")
    for part in staged(spark, log, parts):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(log.schema).parquet(f"{base}/in"))
        sinks.drain(stream, f"{base}/out", f"{base}/checkpoint", mode)
    return sinks.emitted(spark, f"{base}/out", stream.schema)


def passed(log, rows, lateness_ms=86_400_000):
    """Rows up to where the watermark is after the whole log."""
    latest = log.select(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    return rows.filter(F.col("us") <= (latest - lateness_ms) * 1000)


def test_open_sessions_survive_restarts(spark):
    sinks.use_rocksdb(spark)
    log = app_log(spark)
    streamed = feed(spark, log, stateful.open_sessions, "append").drop("batch_id")
    batch = passed(log, engagement.app_opens(log))
    assert streamed.count() == batch.count() > 500 and streamed.exceptAll(batch).isEmpty()


def test_prompt_machine_survives_restarts(spark):
    sinks.use_rocksdb(spark)
    log = app_log(spark)
    streamed = feed(spark, log, lambda s: stateful.prompt_machine(s, 2), "append").drop("batch_id")
    batch = passed(log, engagement.prompts(engagement.eligible_moments(log), 2))
    assert streamed.count() == batch.count() > 0 and streamed.exceptAll(batch).isEmpty()


@pytest.mark.parametrize("buckets", [1, 3])
def test_users_of_a_bucket_do_not_mix(spark, buckets):
    sinks.use_rocksdb(spark)
    log = app_log(spark, 1500)
    for build, batch in ((lambda s: stateful.open_sessions(s, buckets=buckets), engagement.app_opens(log)),
                         (lambda s: stateful.prompt_machine(s, 2, buckets=buckets), engagement.prompts(engagement.eligible_moments(log), 2))):
        streamed, want = feed(spark, log, build, "append").drop("batch_id"), passed(log, batch)
        assert streamed.count() == want.count() > 0 and streamed.exceptAll(want).isEmpty()


def fed(spark, parts, build):
    """What a stream emits of parts that come in the given order, each with an extra column that is not asked for."""
    base = scratch_path(spark, "parts")
    for part in parts:
        part.withColumn("held", F.lit("x")).coalesce(2).write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(parts[0].withColumn("held", F.lit("x")).schema).parquet(f"{base}/in"))
        sinks.drain(stream, f"{base}/out", f"{base}/checkpoint", "append")
    return sinks.emitted(spark, f"{base}/out", stream.schema).drop("batch_id")


def test_parts_in_any_order_give_the_batch_result(spark):
    sinks.use_rocksdb(spark)
    log = app_log(spark, 1500)
    # Eleven days in all: with twelve allowed nothing is late, and one event far ahead lets everything pass.
    parts = [staged(spark, log, 4)[i] for i in (2, 0, 3, 1)]
    ahead = log.limit(1).select(F.lit(99).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.expr("timestamp_ntz'2024-03-01 00:00:00'").alias("ts"),
                                F.lit("active").alias("kind"), F.lit(0.0).alias("meters"), F.lit("9").alias("app_version"))
    opens = fed(spark, [*parts, ahead], lambda s: stateful.open_sessions(s, lateness="12 days"))
    batch = engagement.app_opens(log)
    assert opens.count() == batch.count() > 200 and opens.exceptAll(batch).isEmpty()
    prompts = fed(spark, [*parts, ahead], lambda s: stateful.prompt_machine(s, 2, lateness="12 days"))
    batch = engagement.prompts(engagement.eligible_moments(log), 2)
    assert prompts.count() == batch.count() > 0 and prompts.exceptAll(batch).isEmpty()


def test_late_events_are_dropped_and_the_stream_goes_on(spark):
    sinks.use_rocksdb(spark)
    schema = "user_id long, event_id long, ts timestamp_ntz, kind string, meters double, app_version string"

    def part(*rows):
        return spark.createDataFrame([(1, i, day and datetime(2024, 1, day), kind, None, None) for i, day, kind in rows], schema)

    parts = [part((1, 1, "active"), (2, 5, "background"), (3, 9, "active"), (10, None, "active")),
             part((4, 2, "active"), (5, 8, None), (6, 12, "active")), part(), part((7, 30, "background"))]
    got = fed(spark, parts, stateful.open_sessions).orderBy("us").collect()
    assert [(r["event_id"], r["is_open"]) for r in got] == [(1, True), (3, True), (6, False)]
    assert fed(spark, parts, stateful.prompt_machine).isEmpty()


@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["active", "background", None])), max_size=25), st.integers(1, 24))
def test_opens_of_a_stretch_equal_the_walk(steps, cut):
    us = np.cumsum([s for s, _ in steps]).astype(np.int64)
    kinds = np.array([k for _, k in steps], dtype=object)
    want, launched, background = [], False, None
    for i, (now, kind) in enumerate(zip(us.tolist(), kinds)):
        if kind == "background":
            background = now
        elif kind == "active":
            want.append((i, not launched or (background is not None and now - background >= 5)))
            background, launched = (background if not launched else None), True
    got, state = [], (False, None)
    for low, high in ((0, cut), (cut, len(us))):
        if low < min(high, len(us)):
            at, opened, *state = stateful.opens_of(us[low:high], kinds[low:high], *state, 5)
            got += [(int(i) + low, bool(o)) for i, o in zip(at, opened)]
    assert got == want and tuple(state) == (launched, background)


def test_running_metrics_survive_restarts(spark):
    log = app_log(spark).select(
        "event_id", "ts", F.lit(0).alias("server"), F.lit(9).alias("z"), F.lit("network").alias("source"),
        (F.col("event_id") % 3).cast("int").alias("attempts"), (F.col("event_id") / 1000).alias("seconds"))
    resets = ["2024-01-05 00:00:00"]
    streamed = sinks.latest_state(feed(spark, log, lambda s: metrics.running_metrics(s, resets), "update"), metrics.RUNNING_KEYS)
    batch = metrics.running_metrics(log, resets)
    assert streamed.count() == 2 and streamed.exceptAll(batch).isEmpty()


def test_windows_drop_late_rows(spark):
    base = scratch_path(spark, "late")
    schema = "ts timestamp_ntz, server int, source string"

    def run(rows):
        spark.createDataFrame(rows, "ts string, server int, source string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = metrics.windowed_metrics(spark.readStream.schema(schema).parquet(f"{base}/in"))
        sinks.drain(stream, f"{base}/out", f"{base}/checkpoint", "append")
        return stream.schema

    run([("2024-01-01 10:05:00", 0, "network"), ("2024-01-01 12:30:00", 0, "network")])
    schema_out = run([("2024-01-01 10:06:00", 0, "network"), ("2024-01-01 15:00:00", 0, "network")])
    rows = sinks.emitted(spark, f"{base}/out", schema_out).orderBy("start_us").collect()
    assert [r["n"] for r in rows] == [1, 1]


def test_join_groups_equals_plain_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = skew.sized(rows, ["k"], "n", F.max("id").alias("m"))
    found = skew.join_groups(rows, groups, ["k"], "n")
    assert found.count() == 3000 and found.exceptAll(rows.join(groups, "k").select(*found.columns)).isEmpty()
