"""Licence notices in notes, retrieved by MinHash windows and verified by shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.llm.common import bound_once, broadcast_if_small, no_longs, numbered, over_positions, split_words, stored, text_of

#: Notices of common licences (fixed values: their published wording).
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "NLOD-2.0": "Contains data under the Norwegian licence for Open Government data (NLOD) distributed by Kartverket",
}

_NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_SHINGLE = 5
#: Shingles that start in a window, and how far the next window is.
_WINDOW, _STRIDE = 4, 2
_BANDS = 16


def notices(spark: SparkSession) -> DataFrame:
    """The notices as a table with ``licence`` and ``notice``."""
    return spark.createDataFrame(list(NOTICES.items()), "licence string, notice string")


def _hashed(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` with ``_grams``, the shingle hashes of the text in order."""
    def runs(words: Column) -> Column:
        each = over_positions(F.size(words) - (_SHINGLE - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(_SHINGLE)]), no_longs())
        whole = F.array(F.xxhash64(F.array_join(words, " ")))
        return F.when(F.size(words) == 0, no_longs()).when(F.size(words) < _SHINGLE, whole).otherwise(each)

    # Never null, and said so: else the optimizer tests for null, which hashes every text twice.
    grams = bound_once(split_words(F.lower(text_of(text)), _NOT_WORD), runs)
    return df.select(*keep, F.coalesce(grams, no_longs()).alias("_grams"))


def _seeds() -> list[int]:
    """Masks of the bands: a shingle that is smallest under one is smallest under another by chance alone."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(_BANDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _bands(df: DataFrame, keep: list[str], stride: int) -> DataFrame:
    """``keep`` with ``_band`` and ``_low``, the smallest shingle hash of a window under the band's mask, and ``_at``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("_grams") - 1, F.lit(0)), F.lit(stride))
    windows = df.withColumn("_starts", starts).select(*keep, "_grams", F.explode_outer("_starts").alias("_at"))
    windows = windows.filter(F.get("_grams", F.col("_at")).isNotNull())
    # One band a row: sixteen in one expression make code too long to be compiled.
    masks = F.array(*[F.lit(s).cast("long") for s in _seeds()])
    each = windows.select(*keep, "_grams", "_at", F.posexplode_outer(masks).alias("_band", "_mask"))
    low = F.least(*[F.get("_grams", F.col("_at") + j).bitwiseXOR(F.col("_mask")) for j in range(_WINDOW)])
    each = each.withColumn("_low", F.coalesce(low, F.lit(0).cast("long")))
    return each.select(*keep, "_at", "_band", "_low")


def licences_found(pins: DataFrame, licences: DataFrame | None = None, containment: float = 0.8) -> DataFrame:
    """Licence notices that every pin's ``notes`` carry.

    ``pins`` has ``id`` and ``notes`` of saved pins; ``licences`` has ``licence``
    and ``notice`` (``notices`` if not given). Method: overlapping windows of
    eight words get MinHash bands of one row each, 16 of them; a window that
    holds only one of a notice's shingles still meets it with probability
    1 - (3/4) ** 16 = 0.99, and every window of a longer notice adds a chance.
    Notices that meet a window are verified: at least ``containment`` of their
    five-word shingles (of all words, if fewer) must occur in the notes.

    Returns one row per input row and licence found: ``id``, ``licence``,
    ``contained`` (share of the notice's shingles) and ``first_word`` (where the
    first window that met it starts, from 0). Null or wordless notes and notices
    have none; null ids are kept; repeated rows give repeated results; extra
    columns are not carried; empty tables give no rows.
    """
    licences = licences if licences is not None else notices(pins.sparkSession)
    rows = numbered(pins.select("id", "notes"), "notes")
    known = stored(_hashed(licences, ["licence"], "notice").filter("size(_grams) > 0"), "notices")
    theirs = stored(_bands(known, ["licence"], 1).select("licence", "_band", "_low").distinct(), "notice-bands")
    theirs = broadcast_if_small(theirs, 64)
    ours = _bands(_hashed(rows, ["_row"], "notes"), ["_row"], _STRIDE)
    met = ours.join(theirs, ["_band", "_low"]).groupBy("_row", "licence").agg(F.min("_at").alias("first_word"))
    met = stored(met, "notice-candidates").join(known, "licence")
    asked = broadcast_if_small(met.select("_row", "licence", "first_word", F.col("_grams").alias("_wanted")), 512)
    both = _hashed(rows.join(asked, "_row"), ["id", "licence", "first_word", "_wanted"], "notes")
    wanted = F.array_distinct("_wanted")
    share = F.size(F.array_intersect(wanted, F.col("_grams"))) / F.size(wanted)
    kept = F.filter(F.array(share), lambda x: x >= containment)  # tested here, since a filter would hash the notes again
    found = both.select("id", "licence", F.explode_outer(kept).alias("contained"), F.col("first_word").cast("long").alias("first_word"))
    return found.filter("contained is not null")
