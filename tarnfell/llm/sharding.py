"""Tiles packed into archives of fixed capacity, equal images together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.llm.common import stored
from tarnfell.operators.ordered import running_totals

#: Archives that one task packs, and the pieces a capacity is cut into at most before small groups travel in bundles.
_REGION, _GRAIN = 64, 1024
#: Pieces of all archives if their number is given.
_PIECES = 1 << 16
#: Rows of a run of slots.
_RUN = 1 << 16

_Node = tuple | None


def _height(t: _Node) -> int:
    return t[3] if t else 0


def _node(key: tuple, left: _Node, right: _Node) -> _Node:
    return key, left, right, 1 + max(_height(left), _height(right))


def _balanced(key: tuple, left: _Node, right: _Node) -> _Node:
    """A node whose sides differ by one in height at most, given that they differ by two at most."""
    if _height(left) > _height(right) + 1:
        if _height(left[1]) >= _height(left[2]):
            return _node(left[0], left[1], _node(key, left[2], right))
        middle = left[2]
        return _node(middle[0], _node(left[0], left[1], middle[1]), _node(key, middle[2], right))
    if _height(right) > _height(left) + 1:
        if _height(right[2]) >= _height(right[1]):
            return _node(right[0], _node(key, left, right[1]), right[2])
        middle = right[1]
        return _node(middle[0], _node(key, left, middle[1]), _node(right[0], middle[2], right[2]))
    return _node(key, left, right)


def _with(t: _Node, key: tuple) -> _Node:
    if not t:
        return _node(key, None, None)
    if key < t[0]:
        return _balanced(t[0], _with(t[1], key), t[2])
    return _balanced(t[0], t[1], _with(t[2], key))


def _without(t: _Node, key: tuple) -> _Node:
    if key < t[0]:
        return _balanced(t[0], _without(t[1], key), t[2])
    if key > t[0]:
        return _balanced(t[0], t[1], _without(t[2], key))
    if not t[1] or not t[2]:
        return t[1] or t[2]
    least = t[2]
    while least[1]:
        least = least[1]
    return _balanced(least[0], t[1], _without(t[2], least[0]))


def _tightest(t: _Node, size: int) -> tuple | None:
    """The smallest (room, bin) with room for ``size``."""
    found = None
    while t:
        if t[0][0] >= size:
            found, t = t[0], t[1]
        else:
            t = t[2]
    return found


def best_fit(sizes: np.ndarray, capacity: int, most: int | None = None) -> list[int] | None:
    """Bins of ``sizes``, which fall: each enters the fullest bin that it fits, else a new one.

    A balanced tree holds the bins by remaining room, equal rooms by number. A size above the
    capacity has a bin of its own. None if more than ``most`` bins are needed.
    """
    tree: _Node = None
    placed, bins = [], 0
    for size in sizes.tolist():
        found = _tightest(tree, size)
        if found:
            room, number = found
            tree = _without(tree, found)
        else:
            room, number = max(capacity, size), bins
            bins += 1
            if most is not None and bins > most:
                return None
        tree = _with(tree, (room - size, number))
        placed.append(number)
    return placed


def least_capacity(sizes: np.ndarray, number: int) -> list[int]:
    """Bins of ``sizes``, which fall, under the smallest capacity found (to one part in 2 ** 14) that needs ``number`` bins at most."""
    if not len(sizes):
        return []
    least = max(int(sizes[0]), -(-int(sizes.sum()) // number))
    step = max(1, least >> 14)
    low, slack = -step, 0
    while (placed := best_fit(sizes, least + slack, number)) is None:
        low, slack = slack, max(step, 2 * slack)
    while slack - low > step:
        middle = (low + slack) // 2
        if (tried := best_fit(sizes, least + middle, number)) is None:
            low = middle
        else:
            placed, slack = tried, middle
    return placed


def _falling(pieces: pd.DataFrame) -> pd.DataFrame:
    return pieces.sort_values(["bytes", "piece"], ascending=[False, True])


def _packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``piece``, ``bin``: best-fit decreasing in regions of about ``_REGION`` bins, then once more for what fills no half bin.

    In a region at most one bin is filled to less than half, or its pieces would have entered another.
    These rests are pieces of the next round, which has a fraction of the regions, until one region is left.
    """
    total = pieces.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    regions = max(1, -(-total // (capacity * _REGION)))

    def pack(_: tuple, region: pd.DataFrame) -> pd.DataFrame:
        region = _falling(region)
        region["bin"] = best_fit(region["bytes"].to_numpy(), capacity)
        return region

    dealt = pieces.withColumn("region", F.pmod(F.xxhash64(F.lit(regions), "piece"), F.lit(regions)))
    found = stored(dealt.groupBy("region").applyInPandas(pack, "piece bigint, bytes bigint, region bigint, bin bigint"), "archive-bins")
    named = found.select("piece", F.xxhash64(F.lit(regions), "region", "bin").alias("bin"), "bytes")
    if regions == 1:
        return named.select("piece", "bin")
    filled = named.groupBy("bin").agg(F.sum("bytes").alias("bytes"))
    rests = stored(filled.filter(2 * F.col("bytes") < capacity).select(F.col("bin").alias("piece"), "bytes"), "archive-rests")
    again = _packed(rests, capacity).select(F.col("piece").alias("bin"), F.col("bin").alias("_into"))
    return named.join(again, "bin", "left").select("piece", F.coalesce("_into", "bin").alias("bin"))


def _image() -> Column:
    return F.sha2(F.coalesce(F.col("data").cast("binary"), F.lit(b"")), 256)


class _Grouped:
    """Stored ``rows`` and what they are packed as: ``pieces`` of whole groups."""

    def __init__(self, tiles: DataFrame, overhead: int, keep: list[str]):
        key = ["server", "z", "x", "y", *keep]
        size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long") + overhead
        self.key = key
        self.rows = stored(tiles.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(key)], size.alias("bytes"), _image().alias("image"))
                           .withColumn("_row", F.monotonically_increasing_id()), "tile-sizes")
        self.groups = stored(self.rows.groupBy("image").agg(F.sum("bytes").alias("bytes")), "tile-groups")
        self.total = self.groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def cut(self, grain: int) -> tuple[DataFrame, DataFrame]:
        """``pieces`` (``piece``, ``bytes``) and ``large`` (``image``, ``piece``): groups of ``grain`` bytes or more are pieces, all others
        travel in bundles of about that size. So there are at most twice as many pieces as grains."""
        bundles = max(1, self.total // grain)
        large = self.groups.filter(F.col("bytes") >= grain).select("image", F.xxhash64("image").alias("piece"), "bytes")
        small = self.groups.filter(F.col("bytes") < grain).select(_bundle(bundles).alias("piece"), "bytes")
        pieces = large.select("piece", "bytes").unionByName(small).groupBy("piece").agg(F.sum("bytes").alias("bytes"))
        self.bundles = bundles
        return stored(pieces, "tile-pieces"), large.select("image", F.col("piece").alias("_large"))

    def numbered(self, bins: DataFrame, large: DataFrame, bounded: bool) -> DataFrame:
        """Rows with ``archive`` and ``slot``; ``bins`` (``piece``, ``archive``) and ``large`` are broadcast if their number is bounded."""
        hint = F.broadcast if bounded else (lambda df: df)
        rows = self.rows.join(hint(large), "image", "left").withColumn("piece", F.coalesce("_large", _bundle(self.bundles)))
        rows = stored(rows.join(hint(bins), "piece").withColumn("_run", F.floor(F.col("_row") / _RUN)), "tile-archives")
        ranked = running_totals(rows, ["archive"], "_run", ["_row"], {"_upto": F.lit(1)})
        return ranked.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(self.key)], "bytes", "image", "archive", (F.col("_upto") - 1).cast("long").alias("slot"))


def _bundle(bundles: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bundle"), F.col("image")), F.lit(bundles))


def archives(tiles: DataFrame, capacity: int, overhead: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Tiles in as few archives of ``capacity`` bytes as best-fit decreasing finds; equal images in one archive.

    ``tiles`` has ``server``, ``z``, ``x``, ``y`` and ``data`` of the tile
    store. A tile takes its bytes (null: none) and ``overhead``. Tiles of equal
    ``data`` (null and empty alike) are one group, which is never divided; a
    group above the capacity fills an archive of its own.

    Method: groups sorted by size enter the archive with the tightest remaining
    room, found in a balanced tree (``best_fit``). One task packs about 64
    archives; groups below a 1,024th of the capacity travel in bundles of about
    that size, so a task has a bounded number of pieces. What each region fills to
    less than half is packed again.

    Returns one row per input row: the key, ``keep`` columns, ``bytes``,
    ``image`` (digest), ``archive`` (from 0) and ``slot`` (gapless from 0 in each archive). Keys may
    be null or repeat. Other columns are not carried; an empty table gives no rows.
    """
    grouped = _Grouped(tiles, overhead, keep or [])
    pieces, large = grouped.cut(max(1, capacity // _GRAIN))
    bins = stored(_packed(pieces, capacity), "archive-pieces")
    names = bins.select("bin").distinct().withColumn("_part", F.pmod(F.col("bin"), F.lit(1 << 20)))
    names = running_totals(names.withColumn("_all", F.lit(0)), ["_all"], "_part", ["bin"], {"_no": F.lit(1)})
    numbers = bins.join(stored(names.select("bin", (F.col("_no") - 1).cast("long").alias("archive")), "archive-numbers"), "bin").select("piece", "archive")
    return grouped.numbered(numbers, large, False)


def equal_archives(tiles: DataFrame, number: int, overhead: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Tiles in ``number`` archives (at most 4,096) of near equal bytes; equal images in one archive.

    As ``archives``, with the smallest capacity for which best-fit decreasing
    needs no more than ``number`` archives. Groups below a 65,536th of all bytes travel in
    bundles, so that one task packs at most twice as many pieces at any size of input. Archives differ by
    about a piece, unless one group is larger than an even share.
    """
    if not 1 <= number <= 4096:
        raise ValueError("number of archives must be from 1 to 4096")
    grouped = _Grouped(tiles, overhead, keep or [])
    pieces, large = grouped.cut(max(1, grouped.total // _PIECES))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := list(batches):
            rows = _falling(pd.concat(parts))
            yield pd.DataFrame({"piece": rows["piece"], "archive": least_capacity(rows["bytes"].to_numpy(), number)})

    bins = stored(pieces.coalesce(1).mapInPandas(pack, "piece bigint, archive bigint"), "archive-pieces")
    return grouped.numbered(bins, large, True)
