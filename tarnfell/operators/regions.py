"""Rectangular regions: boxes, insets and boxes seen through the projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import fixed, geo


def place_regions(places: DataFrame, keys: tuple[str, ...] = ("adm", "kind")) -> DataFrame:
    """Bounding box of the places of each group, in degrees."""
    return places.groupBy(*keys).agg(
        (F.min("lat_e5") / 1e5).alias("min_lat"), (F.min("lon_e5") / 1e5).alias("min_lon"),
        (F.max("lat_e5") / 1e5).alias("max_lat"), (F.max("lon_e5") / 1e5).alias("max_lon"))


def centred_regions(centred: DataFrame, inset: float = 0.1) -> DataFrame:
    """Box around a centre, and its inset in Web Mercator metres."""
    half = F.col("span") / 2
    box = centred.select(
        "place_id", (F.col("lat") - half).alias("min_lat"), (F.col("lat") + half).alias("max_lat"),
        (F.col("lon") - half).alias("min_lon"), (F.col("lon") + half).alias("max_lon"))
    x0, y0 = geo.lonlat_to_mercator(F.col("min_lon"), F.col("min_lat"))
    x1, y1 = geo.lonlat_to_mercator(F.col("max_lon"), F.col("max_lat"))
    return box.select(
        "place_id", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")],
        F.round(x0 + (x1 - x0) * inset, 2).alias("inset_left"), F.round(x1 - (x1 - x0) * inset, 2).alias("inset_right"),
        F.round(y0 + (y1 - y0) * inset, 2).alias("inset_bottom"), F.round(y1 - (y1 - y0) * inset, 2).alias("inset_top"))


def projected_bbox(boxes: DataFrame, keys: list[str], steps: int, to_grid: bool = True) -> DataFrame:
    """Envelope of a box in the other system, walking its perimeter.

    Edges bow under the projection, so corners alone would under-cover. The
    perimeter is ``4 * (steps + 1)`` rows per box and is reduced map-side.
    """
    t = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")
    edge = boxes.select(*keys, "min_lon", "max_lon", "min_lat", "max_lat", t)
    at = F.col("i") / float(steps)
    x = F.col("min_lon") + (F.col("max_lon") - F.col("min_lon")) * at
    y = F.col("min_lat") + (F.col("max_lat") - F.col("min_lat")) * at
    rim = F.explode(F.array(
        F.struct(x.alias("px"), F.col("min_lat").alias("py")), F.struct(x.alias("px"), F.col("max_lat").alias("py")),
        F.struct(F.col("min_lon").alias("px"), y.alias("py")), F.struct(F.col("max_lon").alias("px"), y.alias("py"))))
    points = edge.select(*keys, rim.alias("p")).select(*keys, "p.px", "p.py")
    convert = geo.project if to_grid else geo.unproject
    a, b = convert(F.col("px"), F.col("py"))
    moved = points.select(*keys, a.alias("qx"), b.alias("qy"))
    return moved.groupBy(*keys).agg(F.min("qx").alias("min_x"), F.min("qy").alias("min_y"),
                                    F.max("qx").alias("max_x"), F.max("qy").alias("max_y"))
