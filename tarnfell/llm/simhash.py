"""Near-equal notes by SimHash, linked through segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.llm.common import BLANKS, ascii_lower, no_longs, over_positions, split_words, stored, text_of
from tarnfell.operators.components import min_labels

#: For every byte, its eight bits spread over the eight bytes of a word.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view("<u8").ravel()
#: Hashes whose bits are counted at once in one-byte counters.
_RUN = 255
#: Hashes per round, which bounds memory whatever arrives in a batch.
_ROUND = _RUN * 4096


def _bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set (lowest first)."""
    totals = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROUND):
        part = np.ascontiguousarray(hashes[at:at + _ROUND]).view(np.uint8).reshape(-1, 8)
        cuts = np.arange(0, len(part), _RUN)
        for byte in range(8):
            runs = np.add.reduceat(_SPREAD[part[:, byte]], cuts)
            totals[8 * byte:8 * byte + 8] += runs.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return totals


def _majorities(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One fingerprint per group of hashes; ``ends`` are the groups' ends."""
    sizes = np.diff(ends, prepend=0)
    prints = np.zeros(len(ends), np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes <= _RUN))
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for group in np.array_split(short, max(1, int(sizes[short].sum()) // _ROUND + 1)):
        if not len(group):
            continue
        lengths = sizes[group]
        first = np.cumsum(lengths) - lengths
        take = np.repeat(ends[group] - lengths - first, lengths) + np.arange(lengths.sum())
        part = hashes[take].view(np.uint8).reshape(-1, 8)
        counts = np.stack([np.add.reduceat(_SPREAD[part[:, b]], first) for b in range(8)], axis=1)
        majority = counts.view(np.uint8).reshape(len(group), 64).astype(np.int32) * 2 > lengths[:, None]
        prints[group] = (majority * weights).sum(axis=1, dtype=np.uint64)
    for group in np.flatnonzero(sizes > _RUN):
        totals = _bit_totals(hashes[ends[group] - sizes[group]:ends[group]])
        prints[group] = np.sum(weights[totals * 2 > sizes[group]], dtype=np.uint64)
    return prints


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("_hashes")
        hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        prints = _majorities(hashes, ends).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints)], names=["id", "fingerprint"])


def fingerprints(pins: DataFrame, shingle: int = 3) -> DataFrame:
    """``id`` and ``fingerprint`` (a signed 64-bit number) of each pin's ``notes``.

    Words (A-Z lowered, split at white space) form runs of ``shingle`` words,
    repeats included; a bit is set if more than half of their 64-bit hashes have
    it. Fewer words are one run; no words, or null, give zero.
    """
    words = F.col("_words")
    runs = over_positions(F.size(words) - (shingle - 1), lambda i: F.xxhash64(
        F.concat_ws(" ", *[F.get(words, i + j) for j in range(shingle)])), no_longs())
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    hashes = F.when(F.size(words) == 0, no_longs()).when(F.size(words) < shingle, whole).otherwise(runs)
    split = pins.select("id", split_words(ascii_lower(text_of("notes")), BLANKS).alias("_words"))
    hashed = split.select("id", hashes.alias("_hashes"))
    kind = hashed.schema["id"].dataType.simpleString()
    return hashed.mapInArrow(_fingerprint_batches, f"id {kind}, fingerprint bigint")


def _popcounts(part: Column, bits: int, segment: int) -> list[Column]:
    mask = (1 << segment) - 1
    return [F.bit_count(F.shiftrightunsigned(part, at).bitwiseAND(F.lit(mask).cast("long"))).cast("long")
            for at in range(0, bits, segment)]


def _cells(prints: DataFrame, radius: int, segment: int) -> DataFrame:
    """Grid cells to meet in: ``_cell``, ``fingerprint``, and ``_home`` for the fingerprint's own cell.

    The word is cut in ``radius`` parts; two fingerprints within ``radius`` bits
    have a part with at most one bit between them. A part is embedded as the
    popcounts of its segments: one bit moves it by one in one coordinate, so
    Manhattan distance never exceeds Hamming distance. Cells are the points of
    that grid; besides its own a fingerprint visits the cells one step up.
    """
    width = 64 // radius
    rows = []
    steps = width // segment
    for part in range(radius):
        bits = F.shiftrightunsigned("fingerprint", part * width)
        counts = _popcounts(bits, width, segment)
        # A coordinate is at most ``segment``, so counts pack into digits of a number.
        digit = segment.bit_length()
        home = sum((F.shiftleft(c, digit * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
        rows.append(F.struct(F.lit(part).alias("part"), home.alias("cell"), F.lit(True).alias("home")))
        for i in range(steps):
            up = home + F.lit(1 << (digit * i))
            rows.append(F.when(counts[i] < segment, F.struct(
                F.lit(part).alias("part"), up.alias("cell"), F.lit(False).alias("home"))))
    each = prints.select("fingerprint", F.explode(F.array_compact(F.array(*rows))).alias("_c"))
    return each.select("fingerprint", F.col("_c.part").alias("_part"), F.col("_c.cell").alias("_cell"),
                       F.col("_c.home").alias("_home"))


def links(prints: DataFrame, radius: int = 2, segment: int = 2) -> DataFrame:
    """``left_id``, ``right_id``: distinct fingerprints at most ``radius`` bits apart, each pair once."""
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    cells = _cells(prints, radius, segment)
    homes = cells.filter("_home").select("_part", "_cell", F.col("fingerprint").alias("right_id"))
    visits = cells.select("_part", "_cell", "_home", F.col("fingerprint").alias("left_id"))
    met = visits.join(homes, ["_part", "_cell"]).filter(
        F.when(F.col("_home"), F.col("left_id") < F.col("right_id")).otherwise(F.col("left_id") != F.col("right_id")))
    steps = zip(_popcounts(F.col("left_id"), 64, segment), _popcounts(F.col("right_id"), 64, segment))
    manhattan = sum((F.abs(a - b) for a, b in steps), F.lit(0).cast("long"))
    hamming = F.bit_count(F.col("left_id").bitwiseXOR(F.col("right_id")))
    near = met.filter(manhattan <= radius).filter(hamming <= radius)
    return near.select(F.least("left_id", "right_id").alias("left_id"),
                       F.greatest("left_id", "right_id").alias("right_id")).distinct()


def near_pins(pins: DataFrame, radius: int = 2) -> DataFrame:
    """Groups of pins whose ``notes`` are nearly equal.

    ``pins`` has ``id`` (whole numbers) and ``notes``. Notes link if their
    SimHash fingerprints differ in at most ``radius`` bits (2 or 4); groups
    are the connected parts. Equal fingerprints are one node, so copies are
    never paired with each other. Pairs are proposed by a grid join on segment
    popcounts (a lower bound of the distance) and verified on all 64 bits.

    Returns one row per input row: ``id``, ``fingerprint`` (bigint) and
    ``component_id``, the smallest id of the group. Null notes count as
    wordless: fingerprint zero, linked like any other. A null id keeps its
    row and takes no part in minima. Repeated ids stay repeated; extra columns
    are not carried; an empty table gives no rows.
    """
    prints = stored(fingerprints(pins), "fingerprints")
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("_low")), "fingerprint-nodes")
    labels = min_labels(links(nodes.select("fingerprint"), radius))
    labelled = nodes.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    labelled = stored(labelled.select("fingerprint", "_low", F.coalesce("label", "fingerprint").alias("_label")),
                      "fingerprint-labels")
    lows = labelled.groupBy("_label").agg(F.min("_low").alias("component_id"))
    named = stored(labelled.join(lows, "_label").select("fingerprint", "component_id"), "fingerprint-groups")
    return prints.join(named, "fingerprint").select("id", "fingerprint", "component_id")
