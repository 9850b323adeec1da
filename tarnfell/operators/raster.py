"""Rasters as cells ``(row, col, height)``; a null height means no data.

Cells of one raster are unique per position (``mosaic`` makes them so). The
stencil works on square blocks with a one-cell halo: every cell is shuffled
about once and a block has a fixed number of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.functions import fixed, geo
from tarnfell.operators.ordered import dense_ids, running_totals
from tarnfell.operators.regions import projected_bbox
from tarnfell.session import cut_lineage, spread

CELL = ["row", "col"]
BLOCK = 256


# --------------------------------------------------------------- mosaic and slope

def mosaic(parts: DataFrame) -> DataFrame:
    """Overlapping rasters pasted in path order: the last one wins, even with no data."""
    last = F.max_by(F.struct("height"), "path").alias("last")
    return parts.groupBy(*CELL).agg(last).select(*CELL, F.col("last.height").alias("height"))


def horn_slope(cells: DataFrame, resolution: float = fixed.GRID_RES, block: int = BLOCK) -> DataFrame:
    """Slope in degrees by the 3x3 Horn operator; null when a neighbour has no data."""

    def near(axis: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(axis) + d) / block).cast("long") for d in (-1, 0, 1)])))

    haloed = cells.select("row", "col", "height", near("row").alias("br")).select("*", near("col").alias("bc"))

    def stencil(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = key
        z = np.full((block + 2, block + 2), np.nan)
        r = pdf["row"].to_numpy() - br * block + 1
        c = pdf["col"].to_numpy() - bc * block + 1
        z[r, c] = pdf["height"].to_numpy(dtype="float64")
        east = (z[:-2, 2:] + 2 * z[1:-1, 2:] + z[2:, 2:]) - (z[:-2, :-2] + 2 * z[1:-1, :-2] + z[2:, :-2])
        south = (z[2:, :-2] + 2 * z[2:, 1:-1] + z[2:, 2:]) - (z[:-2, :-2] + 2 * z[:-2, 1:-1] + z[:-2, 2:])
        dx, dy = east / (8 * resolution), south / (8 * resolution)
        slope = np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy)))
        own = (r >= 1) & (r <= block) & (c >= 1) & (c <= block)
        out = pdf.loc[own, ["row", "col", "height"]].copy()
        out["slope"] = slope[r[own] - 1, c[own] - 1]
        return out

    found = haloed.groupBy("br", "bc").applyInPandas(stencil, "row long, col long, height double, slope double")
    return found.select("row", "col", F.nanvl("height", F.lit(None)).alias("height"),
                        F.nanvl("slope", F.lit(None)).alias("slope"))


def slope_class(slope: Column, height: Column) -> Column:
    """Left-closed class 0-5; 0 when undefined or the centre has no data."""
    value = F.when(slope.isNull() | height.isNull(), 0)
    for index in range(len(fixed.SLOPE_BREAKS), 0, -1):
        value = value.when(slope >= fixed.SLOPE_BREAKS[index - 1], index)
    return value.otherwise(0)


def slope_classes(cells: DataFrame) -> DataFrame:
    return horn_slope(cells).select("row", "col", slope_class(F.col("slope"), F.col("height")).alias("class"))


# --------------------------------------------------------------- warps

def candidate_tiles(extents: DataFrame, z: int, origin_x: float, origin_y: float,
                    res: float = fixed.GRID_RES) -> DataFrame:
    """Distinct tiles that overlap any extent."""
    boxes = extents.select(
        "extent_id", (F.lit(origin_x) + F.col("col") * res).alias("min_lon"),
        (F.lit(origin_x) + (F.col("col") + F.col("width")) * res).alias("max_lon"),
        (F.lit(origin_y) - (F.col("row") + F.col("height")) * res).alias("min_lat"),
        (F.lit(origin_y) - F.col("row") * res).alias("max_lat"))
    around = projected_bbox(boxes, ["extent_id"], 21, to_grid=False)
    x0, y0 = geo.tile_xy(F.col("min_x"), F.col("max_y"), F.lit(z))
    x1, y1 = geo.tile_xy(F.col("max_x"), F.col("min_y"), F.lit(z))
    columns = around.select(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")).select(
        F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1")
    return columns.select("x", F.explode(F.sequence("y0", "y1")).alias("y")).distinct()


def tile_pixels(tiles: DataFrame, z: int, origin_x: float, origin_y: float,
                res: float = fixed.GRID_RES, size: int = fixed.TILE_SIZE) -> DataFrame:
    """Every pixel of the tiles with its fractional position on the metric grid.

    Pixel rows are spread first, so that few tiles still use all executors.
    """
    rows = tiles.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("px_row"))
    pixels = spread(rows, "x", "y", "px_row").select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("px_col"))
    lon, lat = geo.pixel_centre(F.lit(z), F.col("x"), F.col("y"), F.col("px_row"), F.col("px_col"), size)
    placed = geo.with_projection(pixels, lon, lat, "easting", "northing")
    return placed.select("x", "y", "px_row", "px_col", ((F.col("easting") - origin_x) / res).alias("gx"),
                         ((F.lit(origin_y) - F.col("northing")) / res).alias("gy"))


def _cell_key(position: Column) -> Column:
    """Cell index as a join key that is never null.

    A nullable key would be tested for null before the join, and that test is
    pushed below the staged projection with the whole series written out again.
    """
    return F.coalesce(F.floor(position), F.lit(-(1 << 62)))


def _sorted_join(pixels: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join of pixels and cells that never broadcasts either.

    The size of pixels is estimated from the tiles they are made of, tens of thousands of times
    too small, so that all of them would be sent to the driver.
    """
    return pixels.hint("merge").join(cells, keys)


def nearest_warp(pixels: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """The value of the cell under each pixel centre; pixels off the raster are left out."""
    keyed = pixels.select("x", "y", "px_row", "px_col", _cell_key(F.col("gy")).alias("row"), _cell_key(F.col("gx")).alias("col"))
    return _sorted_join(keyed, cells.select("row", "col", value), CELL).drop(*CELL)


def bilinear_warp(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """Bilinear height per pixel over the known ones of its four cells.

    The four cells are gathered once per cell, not once per pixel: each known
    cell joins four quads, and a pixel then needs a single equi-join.
    """
    corners = F.explode(F.array(*[
        F.struct((F.col("row") - dr).alias("r0"), (F.col("col") - dc).alias("c0"), F.lit(2 * dr + dc).alias("corner"))
        for dr in (0, 1) for dc in (0, 1)])).alias("q")
    quads = cells.filter("height IS NOT NULL").select("height", corners).groupBy("q.r0", "q.c0").agg(
        *[F.max(F.when(F.col("q.corner") == i, F.col("height"))).alias(f"h{i}") for i in range(4)])
    fx, fy = F.col("gx") - 0.5, F.col("gy") - 0.5
    keyed = pixels.select("x", "y", "px_row", "px_col", _cell_key(fy).alias("r0"), _cell_key(fx).alias("c0"),
                          (fx - F.floor(fx)).alias("u"), (fy - F.floor(fy)).alias("v"))
    weights = [(1 - F.col("u")) * (1 - F.col("v")), F.col("u") * (1 - F.col("v")),
               (1 - F.col("u")) * F.col("v"), F.col("u") * F.col("v")]
    zero = F.lit(0.0)
    total = sum((F.when(F.col(f"h{i}").isNotNull(), w).otherwise(zero) for i, w in enumerate(weights)), zero)
    value = sum((F.coalesce(F.col(f"h{i}") * w, zero) for i, w in enumerate(weights)), zero)
    return _sorted_join(keyed, quads, ["r0", "c0"]).filter(total > 0).select(
        "x", "y", "px_row", "px_col", (value / total).alias("height"))


def area_average(cells: DataFrame, source_res: int = 8, target_res: int = 10) -> DataFrame:
    """Mean of the overlapping source cells by overlap area, no data ignored."""

    def overlaps(axis: str) -> Column:
        lo, hi = F.col(axis) * source_res, (F.col(axis) + 1) * source_res
        first, last = F.floor(lo / target_res), F.floor((hi - 1) / target_res)
        return F.explode(F.transform(F.sequence(first, last), lambda d: F.struct(
            d.alias("i"), (F.least(hi, (d + 1) * target_res) - F.greatest(lo, d * target_res)).alias("w"))))

    known = cells.filter("height IS NOT NULL")
    shared = known.select("height", overlaps("row").alias("r"), "col").select("height", "r", overlaps("col").alias("c"))
    weight = F.col("r.w") * F.col("c.w")
    return shared.groupBy(F.col("r.i").alias("row"), F.col("c.i").alias("col")).agg(
        (F.sum(weight * F.col("height")) / F.sum(weight)).alias("height"))


# --------------------------------------------------------------- tiles of cells

def tile_positions(cells: DataFrame, size: int = fixed.TILE_SIZE, tiles_per_block: int = 8) -> DataFrame:
    """Block, tile and pixel of every cell, by whole-number arithmetic."""
    span = size * tiles_per_block

    def part(axis: str, divisor: int) -> Column:
        return F.floor(F.col(axis) / divisor)

    return cells.select(
        "*", part("row", span).alias("block_row"), part("col", span).alias("block_col"),
        part("row", size).alias("tile_row"), part("col", size).alias("tile_col"),
        F.pmod("row", F.lit(size)).alias("px_row"), F.pmod("col", F.lit(size)).alias("px_col"))


def tile_contents(classes: DataFrame, size: int = fixed.TILE_SIZE) -> DataFrame:
    """Known and steep cells per tile, and whether each product has anything to write."""
    tiled = tile_positions(classes, size)
    counts = tiled.groupBy("tile_row", "tile_col").agg(
        F.count("height").alias("known"), F.count(F.when(F.col("class") > 0, 1)).alias("steep"))
    return counts.select("*", (F.col("known") > 0).alias("write_heights"), (F.col("steep") > 0).alias("write_slopes"))


def overview_pyramid(classes: DataFrame, base_z: int, min_z: int) -> DataFrame:
    """Each coarser cell is the maximum of its 2x2 children; empty cells are left out.

    A level is a quarter of the one below and is written before it is used
    again, so the base is aggregated once and not once per zoom.
    """
    level = classes.filter(F.col("class") > 0).select(
        F.lit(base_z).alias("z"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "class")
    # The base feeds the first level and the output, and what it comes from (a stencil, a warp) is dear.
    level = cut_lineage(level)
    out = level
    for z in range(base_z - 1, min_z - 1, -1):
        level = level.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(
            F.max("class").alias("class")).select(F.lit(z).alias("z"), "row", "col", "class")
        if z > min_z:
            level = cut_lineage(level)
        out = out.unionByName(level)
    return out


def magnified(cells: DataFrame, levels: int, value: str) -> DataFrame:
    """Labels of the deeper zoom: every cell covers a square of ``2**levels`` cells, unblended."""
    n = 1 << levels
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    rows = cells.select("row", "col", value, F.explode(steps).alias("dr"))
    both = rows.select("*", F.explode(steps).alias("dc"))
    return both.select((F.col("row") * n + F.col("dr")).alias("row"), (F.col("col") * n + F.col("dc")).alias("col"), value)


# --------------------------------------------------------------- layers side by side

def border_fill(new: DataFrame, previous: DataFrame) -> DataFrame:
    """New cells, their no data filled from the previous layer."""
    old = previous.select(*CELL, F.col("height").alias("_old"))
    return new.join(old, CELL, "full_outer").select(*CELL, F.coalesce("height", "_old").alias("height"))


def colour_class(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Palette class of a colour, -1 for any other; class 0 also has to be transparent."""
    packed = r * 65536 + g * 256 + b
    known = {pr * 65536 + pg * 256 + pb: i for i, (pr, pg, pb) in enumerate(fixed.PALETTE)}
    found = F.coalesce(fixed.lookup(packed.cast("int"), known), F.lit(-1))
    return F.when((found == 0) & (a != 0), -1).otherwise(found)


def is_runout(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).isin([pr * 65536 + pg * 256 + pb for pr, pg, pb in fixed.RUNOUT_COLOURS])


def recoloured(pixels: DataFrame) -> DataFrame:
    """The no-data fill of the base map made transparent, and whether a pixel changed."""
    fill = (F.col("r") > 250) & (F.col("g") > 250) & F.col("b").between(222, 240)
    return pixels.withColumn("changed", fill).select(
        *[c for c in pixels.columns if c not in ("r", "g", "b", "a")],
        *[F.when(fill, 0).otherwise(F.col(c)).alias(c) for c in ("r", "g", "b", "a")], "changed")


def changed_tiles(pixels: DataFrame) -> DataFrame:
    return recoloured(pixels).groupBy("tile_id").agg(F.bool_or("changed").alias("changed"))


def compared_heights(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """Samples against reference heights: missing, skipped (not terrain) or compared."""
    ref = reference.select(*CELL, "datakilde", F.col("height").alias("_ref"))
    joined = samples.filter("height IS NOT NULL").join(ref, CELL, "left")
    terrain = F.coalesce(F.col("datakilde").isin(fixed.TERRAIN_SOURCES), F.lit(False))
    outcome = F.when(F.col("_ref").isNull(), "missing").when(~terrain, "skipped").otherwise("compared")
    return joined.select(*CELL, "datakilde", outcome.alias("outcome"),
                         F.when(outcome == "compared", F.abs(F.col("_ref") - F.col("height"))).alias("difference"))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float],
                      width: float = 1.0) -> DataFrame:
    """Exact linear-interpolated percentiles without holding a group in one task.

    Equal values are counted first; ranks are running totals of the counts in
    chunks of ``width`` value units, so the largest group is as parallel as any.
    """
    freq = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    chunked = freq.withColumn("_chunk", F.floor(F.col(value) / width))
    ranked = running_totals(chunked, keys, "_chunk", [value], {"_seen": F.col("_n")})
    totals = freq.groupBy(*keys).agg(F.sum("_n").alias("n"), F.max(value).alias("max"))
    placed = ranked.join(totals, keys)
    aggs = []
    for name, p in ps.items():
        at = (F.col("n") - 1) * F.lit(p)
        aggs += [F.min(F.when(F.col("_seen") > F.floor(at), F.col(value))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_seen") > F.ceil(at), F.col(value))).alias(f"_hi_{name}")]
    found = placed.groupBy(*keys, "n", "max").agg(*aggs)
    out = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * ((F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p)))).alias(n)
           for n, p in ps.items()]
    return found.select(*keys, "n", *out, "max")


def error_report(compared: DataFrame, max_median: float = 2.0, max_p90: float = 8.0) -> DataFrame:
    """Median, p90, p99 and maximum difference overall and per source, with the verdict."""
    valid = compared.filter("outcome = 'compared'").select(
        F.explode(F.array(F.lit("all"), F.col("datakilde"))).alias("scope"), "difference")
    stats = exact_percentiles(valid, ["scope"], "difference", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return stats.withColumn("passed", (F.col("median") <= max_median) & (F.col("p90") <= max_p90))


def usable_pairs(ours: DataFrame, theirs: DataFrame, size: int, min_cells: int = 500) -> DataFrame:
    """Class pairs of two layers in tiles with enough comparable cells.

    ``ours(row, col, class, covered)``; ``theirs(row, col, r, g, b, a, land)``.
    """
    their_class = colour_class(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    known = theirs.filter(F.col("land") & ~is_runout(F.col("r"), F.col("g"), F.col("b"))).select(
        *CELL, their_class.alias("their_class")).filter("their_class >= 0")
    pairs = ours.filter(F.col("covered") & (F.col("class") >= 0)).select(*CELL, F.col("class").alias("our_class")).join(known, CELL)
    counted = (pairs.groupBy(F.floor(F.col("row") / size).alias("tile_row"), F.floor(F.col("col") / size).alias("tile_col"),
                             "their_class", "our_class").agg(F.count("*").alias("n")))
    enough = counted.groupBy("tile_row", "tile_col").agg(F.sum("n").alias("usable")).filter(F.col("usable") >= min_cells)
    return counted.join(enough, ["tile_row", "tile_col"])


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("their_class", "our_class").agg(F.sum("n").alias("n"))


def agreement(matrix: DataFrame, min_agreement: float = 85.0) -> DataFrame:
    """Exact and within-one agreement, steep share of each side, verdict."""
    a, b, n = F.col("their_class"), F.col("our_class"), F.col("n")

    def share(test: Column) -> Column:
        return F.round(100.0 * F.sum(F.when(test, n).otherwise(0)) / F.sum(n), 4)

    return matrix.agg(F.sum(n).alias("total"), share(a == b).alias("exact_pct"),
                      share(F.abs(a - b) <= 1).alias("within_one_pct"), share(a > 0).alias("steep_theirs_pct"),
                      share(b > 0).alias("steep_ours_pct")).withColumn("passed", F.col("exact_pct") >= min_agreement)


def picked_overview(factors: Column, wanted: int = 8) -> Column:
    """Index of the largest overview factor that is not above ``wanted``; null = full resolution."""
    best = F.array_max(F.filter(factors, lambda f: f <= wanted))
    return F.when(best.isNotNull(), F.array_position(factors, best) - 1)


# --------------------------------------------------------------- samples

def leading_edge(tiles: DataFrame, sample: int) -> DataFrame:
    """The westernmost tiles of each row, thinned evenly when there are too many.

    Only the number of rows travels to the driver. Thinning is needed only when
    rows outnumber the sample, and then each row has one tile.
    """
    n_rows = tiles.agg(F.countDistinct("y")).first()[0]
    per_row = max(1, sample // max(1, n_rows))
    west = Window.partitionBy("y").orderBy("x")
    edge = tiles.withColumn("_rn", F.row_number().over(west)).filter(F.col("_rn") <= per_row)
    if n_rows * per_row <= sample or per_row > 1:
        return edge.drop("_rn")
    numbered = dense_ids(edge.drop("_rn"), "y", "_i", start=0)
    step = n_rows / sample
    chosen = F.floor(F.ceil(F.col("_i") / step) * step) == F.col("_i")
    return numbered.filter(chosen & (F.ceil(F.col("_i") / step) < sample)).drop("_i")


def seeded_sample(cells: DataFrame, n_tiles: int, per_tile: int, size: int, seed: int) -> DataFrame:
    """``n_tiles`` tiles and ``per_tile`` known cells of each, in a seeded hash order."""

    def order(*columns: str) -> Column:
        return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))

    tiled = tile_positions(cells.filter("height IS NOT NULL"), size)
    tiles = (tiled.select("tile_row", "tile_col").distinct()
             .orderBy(order("tile_row", "tile_col"), "tile_row", "tile_col").limit(n_tiles))
    inside = tiled.join(tiles, ["tile_row", "tile_col"])
    rank = F.row_number().over(Window.partitionBy("tile_row", "tile_col").orderBy(order("row", "col"), "row", "col"))
    return inside.withColumn("_rn", rank).filter(F.col("_rn") <= per_tile).select("tile_row", "tile_col", "row", "col", "height")
