"""Route analytics on vertex tables ``(route_id, seq, lat_e5, lon_e5)``.

Lengths, markers and samples are computed on stretches of a route: windows run
inside ``(route, stretch)`` and one summary row per stretch is ordered per
route, so a route that holds a third of all vertices is spread like any other.
Line simplification and the minimum spacing look at a route as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.functions import fixed, geo
from tarnfell.operators.ordered import previous_value
from tarnfell.session import materialised


def _by_seq(*frame: int):
    """Window over a route in vertex order, with an optional row frame."""
    window = Window.partitionBy("route_id").orderBy("seq")
    return window.rowsBetween(*frame) if frame else window


_UP_TO = (Window.unboundedPreceding, Window.currentRow)
_FROM = (Window.currentRow, Window.unboundedFollowing)
# Guards against a last-digit difference dropping the sample at the very end.
_EPS = 1e-9


# --------------------------------------------------------------- lengths

# Vertex numbers of one stretch.
_STRETCH = 1 << 16


def _legs(points: DataFrame) -> DataFrame:
    """``segments`` with the route's ``total`` and ``is_last``, stretch by stretch."""
    lat, lon = F.col("lat_e5") / 1e5, F.col("lon_e5") / 1e5
    placed = points.select("route_id", "seq", lat.alias("lat"), lon.alias("lon"), F.floor(F.col("seq") / _STRETCH).alias("_stretch"))
    before = F.struct("lat", "lon")
    paired = previous_value(placed, ["route_id"], "_stretch", ["seq"], before, "_before")
    paired = paired.select(*placed.columns, F.col("_before.lat").alias("lat0"), F.col("_before.lon").alias("lon0"))
    metres = F.coalesce(geo.geodesic_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), F.lit(0.0))
    measured = paired.withColumn("segment", metres)
    sums = measured.groupBy("route_id", "_stretch").agg(F.sum("segment").alias("_sum"), F.max("seq").alias("_end"))
    route = Window.partitionBy("route_id")
    earlier = F.sum("_sum").over(route.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    whole = sums.select("route_id", "_stretch", F.coalesce(earlier, F.lit(0.0)).alias("_carry"),
                        F.sum("_sum").over(route).alias("total"), F.max("_end").over(route).alias("_last"))
    inside = F.sum("segment").over(Window.partitionBy("route_id", "_stretch").orderBy("seq").rowsBetween(*_UP_TO))
    legs = measured.withColumn("_inside", inside).join(whole, ["route_id", "_stretch"])
    return legs.select("route_id", "seq", "lat", "lon", "lat0", "lon0", "segment", (F.col("_carry") + F.col("_inside")).alias("travelled"),
                       "total", (F.col("seq") == F.col("_last")).alias("is_last"))


def segments(points: DataFrame) -> DataFrame:
    """Each vertex with its predecessor, segment length and distance travelled."""
    return _legs(points).drop("total", "is_last")


def route_lengths(points: DataFrame) -> DataFrame:
    """Length as the sum of geodesic segments, connectors between strokes included."""
    return _legs(points).groupBy("route_id").agg(F.count("*").alias("vertices"), F.sum("segment").alias("metres"))


def route_boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("route_id").agg(
        F.min("lat_e5").alias("min_lat_e5"), F.min("lon_e5").alias("min_lon_e5"),
        F.max("lat_e5").alias("max_lat_e5"), F.max("lon_e5").alias("max_lon_e5"))


def _with_total(points: DataFrame) -> DataFrame:
    return _legs(points).withColumn("before", F.col("travelled") - F.col("segment"))


def distance_markers(points: DataFrame, spacing: float | None = None) -> DataFrame:
    """Points at every multiple of the spacing along the route; none on shorter routes."""
    legs = _with_total(points)
    step = F.lit(spacing) if spacing else geo.marker_spacing(F.col("total"))
    legs = legs.withColumn("step", step).filter((F.col("segment") > 0) & (F.col("total") >= F.col("step")))
    first = F.floor(F.col("before") / F.col("step") + _EPS) + 1
    last = F.floor(F.col("travelled") / F.col("step") + _EPS)
    marks = legs.filter(first <= last).select("*", F.explode(F.sequence(first, last)).alias("k"))
    at = marks.withColumn("metres", F.col("k") * F.col("step"))
    t = (F.col("metres") - F.col("before")) / F.col("segment")
    lat, lon = geo.wrapped_lerp(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"), t)
    return at.select("route_id", "k", "metres", lat.alias("lat"), lon.alias("lon"))


def resampled(points: DataFrame, spacing: float = fixed.SAMPLE_SPACING_M,
              max_samples: int = fixed.MAX_SAMPLES) -> DataFrame:
    """Samples at a fixed spacing, widened on long routes so that a cap holds; both ends included.

    The start belongs to the first vertex, the far end to the last one, so one
    pass over the segments emits every sample.
    """
    legs = _with_total(points)
    step = F.greatest(F.lit(spacing), F.col("total") / (max_samples - 1))
    legs = legs.withColumn("step", step).withColumn("is_first", F.col("lat0").isNull())
    first = F.floor(F.col("before") / F.col("step") + _EPS) + 1
    last = F.least(F.floor(F.col("travelled") / F.col("step") + _EPS), F.lit(max_samples - 1).cast("long"))
    steps = F.when((F.col("segment") > 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    inside = F.transform(steps, lambda k: F.struct(
        k.alias("k"), (k * F.col("step")).alias("distance"),
        ((k * F.col("step") - F.col("before")) / F.col("segment")).alias("t")))
    reached = F.least(F.floor(F.col("total") / F.col("step") + _EPS), F.lit(max_samples - 1).cast("long"))
    none = F.array().cast("array<struct<k:bigint,distance:double,t:double>>")
    start = F.when(F.col("is_first"), F.array(F.struct(
        F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("t")))).otherwise(none)
    end_due = (F.col("is_last") & (F.col("total") > 0) & (reached + 1 < max_samples)
               & (F.col("total") - reached * F.col("step") > 0.5))
    end = F.when(end_due, F.array(F.struct(
        (reached + 1).alias("k"), F.col("total").alias("distance"), F.lit(1.0).alias("t")))).otherwise(none)
    rows = legs.select("route_id", "lat0", "lon0", "lat", "lon", F.explode(F.concat(start, inside, end)).alias("s"))
    lat, lon = geo.lerp(F.coalesce("lat0", "lat"), F.coalesce("lon0", "lon"), F.col("lat"), F.col("lon"), F.col("s.t"))
    return rows.select("route_id", F.col("s.k").alias("k"), F.col("s.distance").alias("distance"),
                       lat.alias("lat"), lon.alias("lon"))


# --------------------------------------------------------------- profiles

def sampled_heights(samples: DataFrame, cells: DataFrame, row: Column, col: Column) -> DataFrame:
    """Height under each sample; null where the cell or its value is missing.

    Samples meet cells by key, so a tile is read once however many samples it
    serves; a crowded cell is split by the adaptive skew join.
    """
    keyed = samples.withColumn("row", row).withColumn("col", col)
    return keyed.join(cells.select("row", "col", "height"), ["row", "col"], "left")


def stored_profile(routes: DataFrame) -> DataFrame:
    """Distance of the i-th stored height: the spacing follows from the stored length."""
    step = F.when(F.size("elevations") > 1, F.col("metres") / (F.size("elevations") - 1)).otherwise(0.0)
    return routes.select("route_id", step.alias("_step"), F.posexplode("elevations").alias("k", "elevation")).select(
        "route_id", "k", (F.col("k") * F.col("_step")).alias("distance"), "elevation")


def climb(heights: Column, hysteresis: float = fixed.HYSTERESIS_M) -> Column:
    """``struct(ascent, descent)`` of heights in order; small wobbles and gaps do not count."""
    state = "struct<ref:double,up:double,down:double>"
    start = F.struct(F.lit(None).cast("double").alias("ref"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down")).cast(state)

    def step(acc, h):
        delta = h - acc["ref"]
        moved = delta.isNotNull() & (F.abs(delta) >= hysteresis)
        ref = F.when(h.isNull(), F.lit(None).cast("double")).when(acc["ref"].isNull() | moved, h).otherwise(acc["ref"])
        return F.struct(ref.alias("ref"),
                        (acc["up"] + F.when(moved & (delta > 0), delta).otherwise(0.0)).alias("up"),
                        (acc["down"] - F.when(moved & (delta < 0), delta).otherwise(0.0)).alias("down")).cast(state)

    return F.aggregate(heights, start, step, lambda acc: F.struct(acc["up"].alias("ascent"), acc["down"].alias("descent")))


def _ordered_heights() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("k", "height"))), lambda s: s["height"])


def ascent_descent(profile: DataFrame) -> DataFrame:
    """Climb per route; at most ``MAX_SAMPLES`` heights of a route are gathered."""
    gathered = profile.groupBy("route_id").agg(_ordered_heights().alias("h"))
    return gathered.select("route_id", climb(F.col("h")).alias("c")).select("route_id", "c.ascent", "c.descent")


def profile_summary(profile: DataFrame) -> DataFrame:
    """Everything a profile shows: extremes, coverage, flags, padded axis, climb."""
    stats = profile.groupBy("route_id").agg(
        F.count("*").alias("points"), F.count("height").alias("known"), F.min("height").alias("minimum"),
        F.max("height").alias("maximum"), F.max("distance").alias("metres"), _ordered_heights().alias("h"))
    coverage = F.col("known") / F.col("points")
    has_data = (coverage > 0) & (F.col("points") >= 2)
    padding = F.greatest((F.col("maximum") - F.col("minimum")) * 0.15, F.lit(10.0))
    return stats.withColumn("c", climb(F.col("h"))).select(
        "route_id", "points", "metres", "minimum", "maximum", coverage.alias("coverage"), has_data.alias("has_data"),
        (has_data & (coverage < 0.95)).alias("is_partial"), (F.col("minimum") - padding).alias("axis_low"),
        (F.col("maximum") + padding).alias("axis_high"), "c.ascent", "c.descent")


# --------------------------------------------------------------- vertex filters

def minimum_spacing(points: DataFrame, spacing_e5: int) -> DataFrame:
    """Vertices at least ``spacing_e5`` from the last kept one (plane distance); the first stays.

    Each choice depends on the one before, so a route is walked once, as an
    array in Python, many routes in one Arrow batch.
    """

    @F.pandas_udf("array<int>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x: np.ndarray, y: np.ndarray) -> list[int]:
            keep = []
            for i, (px, py) in enumerate(zip(x.tolist(), y.tolist())):
                if not keep or (px - x0) ** 2 + (py - y0) ** 2 >= spacing_e5 ** 2:
                    keep.append(i)
                    x0, y0 = px, py
            return keep

        return pd.Series([one(np.asarray(x), np.asarray(y)) for x, y in zip(xs, ys)])

    return _chosen(points, kept)


def _chosen(points: DataFrame, kept) -> DataFrame:
    """The vertices of each route whose positions ``kept(longitudes, latitudes)`` names."""
    vertex = F.struct("seq", "lat_e5", "lon_e5")
    routes = points.groupBy("route_id").agg(F.sort_array(F.collect_list(vertex)).alias("v"))
    flagged = routes.withColumn("kept", kept(F.col("v.lon_e5"), F.col("v.lat_e5")))
    chosen = F.transform("kept", lambda i: F.col("v")[i])
    return flagged.select("route_id", F.explode(chosen).alias("p")).select("route_id", "p.*")


# Vertices of a span that are simplified in one go, as an array.
_SPAN = 1_024


def _offset(point: Column, a: Column, b: Column) -> Column:
    """Plane distance of a vertex from the segment between two, clamped to its ends."""
    px, py = (point["lon_e5"] - a["lon_e5"]).cast("double"), (point["lat_e5"] - a["lat_e5"]).cast("double")
    dx, dy = (b["lon_e5"] - a["lon_e5"]).cast("double"), (b["lat_e5"] - a["lat_e5"]).cast("double")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / square))).otherwise(0.0)
    return F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))


def _kept_of(tolerance_e5: float):
    """Positions of the vertices of a short span that stay, both ends left out."""

    @F.pandas_udf("array<int>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x: np.ndarray, y: np.ndarray) -> list[int]:
            keep: set[int] = set()
            waiting = [(0, len(x) - 1)]
            while waiting:
                low, high = waiting.pop()
                if high - low < 2:
                    continue
                px, py = x[low + 1:high] - x[low], y[low + 1:high] - y[low]
                dx, dy = x[high] - x[low], y[high] - y[low]
                square = dx * dx + dy * dy
                t = np.clip((px * dx + py * dy) / square, 0.0, 1.0) if square else np.zeros(len(px))
                off = np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)
                far = int(off.argmax())
                if off[far] > tolerance_e5:
                    keep.add(low + 1 + far)
                    waiting += [(low, low + 1 + far), (low + 1 + far, high)]
            return sorted(keep)

        return pd.Series([one(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(xs, ys)])

    return kept


def simplified(points: DataFrame, tolerance_e5: float, span: int = _SPAN) -> DataFrame:
    """Simplified line per route (farthest vertex of a span stays if it is off by more than the tolerance, and cuts the span in two); both ends stay.

    Rounds over a table of spans: every vertex knows the span it lies in, the farthest of each span is found
    by one grouping with partial aggregation, and spans that are near enough leave with their vertices. A span of at
    most ``span`` vertices is finished at once, as an array of that many; a route that
    holds a third of all vertices is a large span only, never an array.
    """
    vertex = F.struct("seq", "lat_e5", "lon_e5")
    ends = materialised(points.groupBy("route_id").agg(F.min(vertex).alias("a"), F.max(vertex).alias("b"), F.count("*").alias("_n")), "route-ends")
    kept = [ends.select("route_id", "a.*"), ends.filter("_n > 1").select("route_id", "b.*")]
    inner = points.join(ends, "route_id").filter((F.col("seq") > F.col("a.seq")) & (F.col("seq") < F.col("b.seq")))
    waiting = inner.select("route_id", vertex.alias("p"), "a", "b", (F.col("_n") - 2).alias("_n"))
    short = []
    while True:
        waiting = materialised(waiting, "route-spans")
        short.append(waiting.filter(F.col("_n") <= span))
        large = waiting.filter(F.col("_n") > span)
        if large.isEmpty():
            break
        off = _offset(F.col("p"), F.col("a"), F.col("b"))
        # Of equally far vertices the first.
        worst = large.groupBy("route_id", F.col("a.seq").alias("_from")).agg(
            F.max(F.struct(off.alias("off"), (-F.col("p.seq")).alias("turn"), F.col("p").alias("cut"))).alias("w"))
        cuts = materialised(worst.filter(F.col("w.off") > tolerance_e5).select("route_id", "_from", "w.cut"), "route-cuts")
        kept.append(cuts.select("route_id", "cut.*"))
        halves = large.withColumn("_from", F.col("a.seq")).join(cuts, ["route_id", "_from"]).filter(F.col("p.seq") != F.col("cut.seq"))
        left = F.col("p.seq") < F.col("cut.seq")
        halves = materialised(halves.select("route_id", "p", F.when(left, F.col("a")).otherwise(F.col("cut")).alias("a"),
                                            F.when(left, F.col("cut")).otherwise(F.col("b")).alias("b")), "route-halves")
        sizes = materialised(halves.groupBy("route_id", F.col("a.seq").alias("_from")).agg(F.count("*").alias("_n")), "route-sizes")
        waiting = halves.withColumn("_from", F.col("a.seq")).join(sizes, ["route_id", "_from"]).drop("_from")
    rest = short[0]
    for more in short[1:]:
        rest = rest.unionByName(more)
    arrays = rest.groupBy("route_id", "a", "b").agg(F.sort_array(F.collect_list("p")).alias("_inner"))
    arrays = arrays.select("route_id", F.concat(F.array("a"), "_inner", F.array("b")).alias("v"))
    found = arrays.withColumn("_at", _kept_of(tolerance_e5)(F.col("v.lon_e5"), F.col("v.lat_e5")))
    kept.append(found.select("route_id", F.explode(F.transform("_at", lambda i: F.col("v")[i])).alias("p")).select("route_id", "p.*"))
    lines = kept[0]
    for more in kept[1:]:
        lines = lines.unionByName(more)
    return lines.select("route_id", "seq", "lat_e5", "lon_e5")


# --------------------------------------------------------------- edit log

def surviving_strokes(log: DataFrame) -> DataFrame:
    """Strokes left after replaying ``append`` / ``undo`` / ``clear`` per route.

    ``log(route_id, seq, op, size)``. Undo takes the last surviving stroke, like
    a closing bracket; strokes of fewer than two points are not strokes. A stretch of
    the log is summarised in two numbers, the undos left over and the strokes it leaves open. Such summaries
    combine like brackets, so what follows a stretch is known from summaries alone:
    a stroke survives unless the undos left over after it reach its depth. Windows run
    inside stretches, and one summary row per stretch is ordered per route.
    """
    cut = log.withColumn("_stretch", F.floor(F.col("seq") / _STRETCH))
    clears = cut.filter("op = 'clear'").groupBy("route_id").agg(F.max("seq").alias("_clear"))
    live = cut.join(materialised(clears, "route-clears"), "route_id", "left").filter(F.col("_clear").isNull() | (F.col("seq") > F.col("_clear")))
    live = live.filter((F.col("op") == "undo") | ((F.col("op") == "append") & (F.col("size") >= 2))).drop("_clear")
    step = F.when(F.col("op") == "append", 1).otherwise(-1)
    inside = Window.partitionBy("route_id", "_stretch").orderBy("seq")
    walked = live.withColumn("_sum", F.sum(step).over(inside.rowsBetween(*_UP_TO)))
    lowest = F.least(F.min("_sum").over(inside.rowsBetween(*_UP_TO)), F.lit(0))
    walked = materialised(walked.withColumn("_open", F.col("_sum") - lowest), "stroke-walks")
    # Undos left over: how far the running sum falls below zero. Strokes open: what remains above its lowest point.
    stretches = walked.groupBy("route_id", "_stretch").agg(
        F.greatest(-F.min("_sum"), F.lit(0)).alias("_undos"), F.sum(step).alias("_total"))
    stretches = materialised(stretches.withColumn("_strokes", F.col("_total") + F.col("_undos")), "stroke-stretches")
    later = Window.partitionBy("route_id").orderBy("_stretch").rowsBetween(1, Window.unboundedFollowing)
    # Undos that reach back over a run of stretches: its lowest running sum. From each stretch on, sums start at its own total.
    up_to = F.sum("_total").over(Window.partitionBy("route_id").orderBy("_stretch").rowsBetween(*_UP_TO))
    fallen = stretches.withColumn("_end", up_to).withColumn("_floor", F.col("_end") - F.col("_total") - F.col("_undos"))
    fallen = fallen.withColumn("_reach", F.greatest(F.col("_end") - F.min("_floor").over(later), F.lit(0)))
    known = materialised(fallen.select("route_id", "_stretch", F.coalesce("_reach", F.lit(0)).alias("_reach"), "_strokes"), "stroke-reach")
    placed = walked.join(known, ["route_id", "_stretch"])
    after = F.min("_open").over(inside.rowsBetween(*_FROM))
    left = placed.withColumn("_lowest", after).filter((F.col("op") == "append") & (F.col("_lowest") >= F.col("_open")))
    # ``_open`` is the stroke's depth among those its stretch leaves open.
    return left.filter(F.col("_open") <= F.col("_strokes") - F.col("_reach")).select("route_id", "seq", "size")


# --------------------------------------------------------------- catalogue checks

def catalogue_problems(routes: DataFrame, points: DataFrame) -> DataFrame:
    """One row per route and broken rule.

    ``routes(route_id, catalogue_id, metres, stroke_sizes, elevations, ascent)``.
    """
    copies = routes.groupBy("catalogue_id").agg(F.count("*").alias("_copies"))
    measured = route_lengths(points).select("route_id", "vertices", F.col("metres").alias("_measured"))
    rows = routes.join(copies, "catalogue_id").join(measured, "route_id", "left")
    strokes = F.aggregate("stroke_sizes", F.lit(0).cast("long"), lambda acc, n: acc + n)
    vertices = F.coalesce("vertices", F.lit(0))
    drift = F.abs(F.col("_measured") - F.col("metres")) / F.nullif("metres", F.lit(0.0))
    rules = {
        "duplicate id": F.col("_copies") > 1,
        "no geometry": vertices < 2,
        "length drift": (vertices >= 2) & F.coalesce(drift >= 0.01, F.lit(True)),
        "stroke sizes": strokes != vertices,
        "too many heights": F.size("elevations") > fixed.MAX_SAMPLES,
        "no heights": ~F.exists("elevations", lambda h: h.isNotNull()),
        "no ascent": F.coalesce(F.col("ascent") <= 0, F.lit(True)),
    }
    broken = F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))
    return rows.select("route_id", F.explode(broken).alias("problem"))
