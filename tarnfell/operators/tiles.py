"""Tile collections: scans, keys, plans, tiers, deletes, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import fixed, geo
from tarnfell.operators.skew import join_groups, sized
from tarnfell.session import spread

TILE = ["server", "z", "x", "y"]


# --------------------------------------------------------------- scans and keys

def zoom_scan(tiles: DataFrame, min_z: int, max_z: int) -> DataFrame:
    """Tiles of a zoom range, coarse zooms first."""
    return tiles.filter(F.col("z").between(min_z, max_z)).orderBy("z", "y", "x", "server")


def zoom_count(tiles: DataFrame, min_z: int, max_z: int) -> DataFrame:
    return tiles.filter(F.col("z").between(min_z, max_z)).groupBy("z").agg(F.count("*").alias("n"))


def coordinate_scan(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tiles of an explicit coordinate set."""
    return tiles.join(wanted.select("z", "x", "y"), ["z", "x", "y"], "left_semi")


_KEY_TEXT = r"^\s*z?(\d+)[/:]y?(\d+)[/:]x?(\d+)\s*$"


def parsed_keys(keys: DataFrame, column: str) -> DataFrame:
    """``z, x, y`` of key texts (z, then row, then column); ``ok`` is false on malformed text."""
    parts = F.split(F.regexp_replace(column, _KEY_TEXT, "$1,$2,$3"), ",")
    numbers = F.when(F.size(parts) == 3, F.transform(parts, lambda p: p.try_cast("int")))
    parsed = keys.withColumn("_n", numbers).select(
        "*", F.col("_n")[0].alias("z"), F.col("_n")[2].alias("x"), F.col("_n")[1].alias("y")).drop("_n")
    return parsed.withColumn("ok", F.col("z").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())


def tile_key(prefix: str) -> Column:
    return F.concat_ws("/", F.lit(prefix), F.col("z"), F.col("y"), F.concat(F.col("x").cast("string"), F.lit(".png")))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tile sink laid out as z/y; rows of a tile row are gathered so that it is few files.

    A range partitioning keeps a crowded row in several tasks instead of one.
    """
    tiles.repartitionByRange("z", "y", "x").write.partitionBy("z", "y").parquet(path)


def unpublished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not listed yet."""
    return work.join(done.select(*keys), keys, "left_anti")


# --------------------------------------------------------------- enumeration and size

def region_tile_ranges(regions: DataFrame, keys: list[str], min_z: int = fixed.PYRAMID_MIN_ZOOM,
                       max_z: int = fixed.PYRAMID_MAX_ZOOM) -> DataFrame:
    """Inclusive tile index range of each region at each zoom."""
    zoomed = regions.select(*keys, "min_lat", "min_lon", "max_lat", "max_lon",
                            F.explode(F.sequence(F.lit(min_z), F.lit(max_z))).alias("z"))
    limit = fixed.LATITUDE_LIMIT_APP
    x0, y1 = geo.tile_xy(F.col("min_lon"), F.greatest("min_lat", F.lit(-limit)), F.col("z"), limit)
    x1, y0 = geo.tile_xy(F.col("max_lon"), F.least("max_lat", F.lit(limit)), F.col("z"), limit)
    return zoomed.select(*keys, "z", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")).filter(
        "x0 <= x1 AND y0 <= y1")


def region_jobs(regions: DataFrame, keys: list[str], layers: DataFrame) -> DataFrame:
    """One row per region, layer and tile, where the layer is kept at that zoom.

    Columns of tiles are spread over the cluster before their rows are listed,
    so a region of continental size is not enumerated by one task.
    """
    zooms = layers.select("server", F.explode(F.sequence("offline_min_z", "offline_max_z")).alias("z"))
    covered = region_tile_ranges(regions, keys).join(zooms, "z")
    columns = covered.select(*keys, "server", "z", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1")
    return spread(columns, *keys, "server", "z", "x").select(*keys, "server", "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def job_order(jobs: DataFrame) -> DataFrame:
    """Low zooms first, so that a partial run is still useful."""
    return jobs.orderBy("z", "y", "x", "server")


def base_bytes(z: Column) -> Column:
    """Measured below its lowest zoom by halving per level."""
    low = min(fixed.BASE_BYTES)
    return (F.when(z < low, fixed.BASE_BYTES[low] / F.pow(F.lit(2.0), low - z))
            .otherwise(fixed.lookup(F.least(z, F.lit(max(fixed.BASE_BYTES))), fixed.BASE_BYTES)))


def slope_bytes(z: Column) -> Column:
    top = fixed.SLOPE_BYTES[max(fixed.SLOPE_BYTES)]
    return F.coalesce(fixed.lookup(z, fixed.SLOPE_BYTES), F.lit(top)) * fixed.SLOPE_COVERAGE


def elevation_bytes(z: Column) -> Column:
    data = next(layer for layer in fixed.LAYERS if layer[6])
    return F.when(z.between(data[3], data[4]), fixed.ELEVATION_BYTES * fixed.ELEVATION_COVERAGE).otherwise(0.0)


def download_estimate(regions: DataFrame, keys: list[str], free_bytes: Column) -> DataFrame:
    """Tile count and bytes per region, by arithmetic on index ranges."""
    positions = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    z = F.col("z")
    n_layers = sum((F.when(z.between(lo, hi), 1).otherwise(0) for _s, _n, _m, lo, hi, _sl, _d in fixed.LAYERS), F.lit(0))
    sized = region_tile_ranges(regions, keys).select(
        *keys, (positions * n_layers).alias("tiles"),
        (positions * (base_bytes(z) + slope_bytes(z) + elevation_bytes(z))).alias("bytes"))
    totals = sized.groupBy(*keys).agg(F.sum("tiles").alias("tile_count"), F.floor(F.sum("bytes")).alias("bytes"))
    return totals.select(*keys, "tile_count", "bytes", (F.col("bytes") > fixed.MAX_DOWNLOAD_BYTES).alias("over_limit"),
                         (F.col("bytes") > free_bytes).alias("over_free"))


# --------------------------------------------------------------- stored tiles

def refcounted_delete(memberships: DataFrame, doomed: Column) -> DataFrame:
    """Stored tiles and whether they go when the doomed regions go.

    One grouping with partial aggregation decides: a tile goes when no
    surviving region owns it.
    """
    return memberships.groupBy(*TILE).agg(
        F.count("*").alias("owners"), F.count(F.when(~doomed, 1)).alias("remaining")).withColumn(
        "deleted", F.col("remaining") == 0)


def nearest_ancestors(wanted: DataFrame, stored: DataFrame, floor_z: int = fixed.PYRAMID_MIN_ZOOM) -> DataFrame:
    """Deepest stored tile strictly above each wanted tile.

    Each distinct tile is looked up once, however many requests name it.
    """
    distinct = wanted.select(*TILE).distinct().filter(F.col("z") > floor_z)
    level = F.explode(F.sequence(F.lit(floor_z), F.col("z") - 1)).alias("anc_z")
    climbed = distinct.select(*TILE, level)
    up = F.pow(F.lit(2.0), F.col("z") - F.col("anc_z"))
    climbed = climbed.withColumn("anc_x", F.floor(F.col("x") / up)).withColumn("anc_y", F.floor(F.col("y") / up))
    held = stored.select("server", F.col("z").alias("anc_z"), F.col("x").alias("anc_x"), F.col("y").alias("anc_y")).distinct()
    met = climbed.join(held, ["server", "anc_z", "anc_x", "anc_y"], "left_semi")
    best = met.groupBy(*TILE).agg(F.max(F.struct("anc_z", "anc_x", "anc_y")).alias("a"))
    return best.select(*TILE, "a.*")


def tiered_lookup(requests: DataFrame, store: DataFrame, cache: DataFrame, layers: DataFrame) -> DataFrame:
    """Exactly one source per request: store, cache, network outcome, or a magnified ancestor.

    ``requests(request_id, server, z, x, y, outcome)``: outcome is the network
    answer the request would get. Tiers are resolved per distinct tile.
    """
    tiles = sized(requests, TILE, "n")
    held = store.select(*TILE).distinct().withColumn("in_store", F.lit(True))
    cached = cache.select(*TILE).distinct().withColumn("in_cache", F.lit(True))
    ancestors = nearest_ancestors(tiles, store)
    known = tiles.join(held, TILE, "left").join(cached, TILE, "left").join(ancestors, TILE, "left")
    full = join_groups(requests, known, TILE, "n").join(layers.select("server", "offline_max_z"), "server")
    rescued = (F.col("outcome") != "network") & (F.col("z") > F.col("offline_max_z")) & F.col("anc_z").isNotNull()
    source = (F.when(F.col("in_store"), "offlineStore").when(F.col("in_cache"), "urlCache")
              .when(rescued, "upscaledAncestor").otherwise(F.col("outcome")))
    return full.select("request_id", source.alias("source"), F.when(source == "upscaledAncestor", F.col("anc_z")).alias("anc_z"))


def region_rollup(jobs: DataFrame, regions: DataFrame) -> DataFrame:
    """Progress and status per region; failed tiles count as done.

    ``jobs(region_id, state, bytes)``, ``regions(region_id, tile_total,
    write_failed, cancelled)``.
    """
    done = jobs.groupBy("region_id").agg(
        F.count(F.when(F.col("state").isin("stored", "failed"), 1)).alias("tile_done"),
        F.coalesce(F.sum(F.when(F.col("state") == "stored", F.col("bytes"))), F.lit(0)).alias("bytes"))
    rows = regions.join(done, "region_id", "left")
    n_done = F.coalesce("tile_done", F.lit(0))
    status = F.when(F.col("write_failed"), "failed").when(F.col("cancelled"), "paused").otherwise("complete")
    return rows.select("region_id", "tile_total", n_done.alias("tile_done"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
                       F.when(F.col("tile_total") > 0, n_done / F.col("tile_total")).otherwise(1.0).alias("fraction"),
                       status.alias("status"))


def stored_bytes(memberships: DataFrame) -> DataFrame:
    """Bytes of distinct stored tiles per layer; a shared tile counts once."""
    return (memberships.groupBy(*TILE).agg(F.max("bytes").alias("bytes"))
            .groupBy("server").agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes")))


# --------------------------------------------------------------- rasters on a block grid

def overlapping_blocks(windows: DataFrame, extents: DataFrame, block: int) -> DataFrame:
    """Window and extent pairs that share cells, and the shared half-open cell box.

    Both sides are listed on a grid of ``block`` cells and met on the grid key;
    a pair is reported only in the block of its shared upper-left corner, so it
    appears once without a distinct.
    """
    def listed(df, names):
        box = {n: F.col(n) for n in names}
        c0, r0, w, h = names
        rows = df.filter((box[w] > 0) & (box[h] > 0)).select(
            "*", F.explode(F.sequence(F.floor(box[r0] / block), F.floor((box[r0] + box[h] - 1) / block))).alias("_br"))
        return rows.select("*", F.explode(F.sequence(
            F.floor(box[c0] / block), F.floor((box[c0] + box[w] - 1) / block))).alias("_bc"))

    left = listed(windows.select("window_id", "col", "row", "width", "height"), ("col", "row", "width", "height"))
    right = listed(extents.select("extent_id", F.col("col").alias("scol"), F.col("row").alias("srow"),
                                  F.col("width").alias("swidth"), F.col("height").alias("sheight")),
                   ("scol", "srow", "swidth", "sheight"))
    met = left.join(right, ["_br", "_bc"])
    c0, r0 = F.greatest("col", "scol"), F.greatest("row", "srow")
    c1 = F.least(F.col("col") + F.col("width"), F.col("scol") + F.col("swidth"))
    r1 = F.least(F.col("row") + F.col("height"), F.col("srow") + F.col("sheight"))
    corner = (F.floor(c0 / block) == F.col("_bc")) & (F.floor(r0 / block) == F.col("_br"))
    return met.filter((c0 < c1) & (r0 < r1) & corner).select(
        "window_id", "extent_id", c0.alias("col0"), r0.alias("row0"), c1.alias("col1"), r1.alias("row1"))


def mosaic_bounds(extents: DataFrame) -> DataFrame:
    return extents.agg(F.min("col").alias("col0"), F.min("row").alias("row0"),
                       F.max(F.col("col") + F.col("width")).alias("col1"),
                       F.max(F.col("row") + F.col("height")).alias("row1"))
