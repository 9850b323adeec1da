"""Fingerprints of notes that add up by paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.llm.common import BLANKS, numbered, stored, text_of

#: Lanes that tell how alike two fingerprints are, added modulo 2 ** 32; the written form has them modulo 2 ** 16.
LANES = 64
#: Lanes that tell whether two are equal, added modulo 2 ** 32.
CHECKS = 4
#: Rows of one key range, which are ordered together.
_RANGE = 256


def _counters(bits: Column) -> list[Column]:
    """The 64 bits of a hash as 32 numbers that sum two bit counts each."""
    one = F.lit(1).cast("long")
    return [F.shiftrightunsigned(bits, b).bitwiseAND(one) + F.shiftleft(F.shiftrightunsigned(bits, b + 1).bitwiseAND(one), 32)
            for b in range(0, LANES, 2)]


def _sums(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """One row per key with ``lanes_i`` (array<int>) and ``checks_i`` (array<bigint>) of each text column."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), text_of(t).alias("text")) for i, t in enumerate(texts)])
    each = rows.select(*keys, F.explode_outer(kinds).alias("_t")).select(*keys, F.col("_t.kind").alias("_kind"), F.col("_t.text").alias("_text"))
    # Outer explosions: plain ones would split every text twice, the first time only to test for emptiness.
    parts = each.select(*keys, "_kind", F.explode_outer(F.split("_text", "\n")).alias("_part"))
    parts = parts.withColumn("_words", F.split("_part", f"[{BLANKS}]+"))
    words = parts.select(*keys, "_kind", "_part", "_words", F.posexplode_outer("_words").alias("_at", "_word"))
    named = F.col("_word") != ""
    words = words.select(
        *keys, "_kind", named.alias("_named"), F.when(F.col("_at") == 0, F.xxhash64(F.lit(1), "_part")).alias("_p1"),
        F.when(F.col("_at") == 0, F.xxhash64(F.lit(2), "_part")).alias("_p2"),
        F.when(named, F.xxhash64("_word", F.nullif(F.get("_words", F.col("_at") + 1), F.lit("")))).otherwise(F.lit(0).cast("long")).alias("_h"))
    low = F.lit((1 << 32) - 1).cast("long")
    totals = []
    for i in range(len(texts)):
        mine = F.col("_kind") == i
        totals += [F.sum(c).alias(f"_s{i}_{k}") for k, c in enumerate(_counters(F.when(mine, F.col("_h")).otherwise(F.lit(0).cast("long"))))]
        totals.append(F.count(F.when(mine & F.col("_named"), F.lit(1))).alias(f"_n{i}"))
        for k, half in enumerate((F.col("_p1").bitwiseAND(low), F.shiftrightunsigned("_p1", 32),
                                  F.col("_p2").bitwiseAND(low), F.shiftrightunsigned("_p2", 32))):
            totals.append(F.coalesce(F.sum(F.when(mine, half)), F.lit(0)).alias(f"_c{i}_{k}"))
    summed = words.groupBy(*keys).agg(*totals)
    out = [F.col(k) for k in keys]
    for i in range(len(texts)):
        lanes = []
        for b in range(LANES):
            pair = F.col(f"_s{i}_{b // 2}")
            count = F.shiftrightunsigned(pair, 32) if b % 2 else pair.bitwiseAND(low)
            lanes.append(_centred(count * 2 - F.col(f"_n{i}")))
        out += [F.array(*lanes).cast("array<int>").alias(f"lanes_{i}"),
                F.array(*[F.pmod(F.col(f"_c{i}_{k}"), F.lit(1 << 32)) for k in range(CHECKS)]).alias(f"checks_{i}")]
    return summed.select(*out)


def _centred(value: Column) -> Column:
    """Modulo 2 ** 32, from -2 ** 31 on."""
    return F.pmod(value + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def written(lanes: Column, checks: Column) -> Column:
    """A fingerprint as text: 8 hex digits a check, then 4 a lane."""
    head = F.transform(checks, lambda x: F.lpad(F.hex(x), 8, "0"))
    tail = F.transform(lanes, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 16))), 4, "0"))
    return F.lower(F.array_join(F.concat(head, tail), ""))


def added(left: Column, right: Column, sign: int = 1) -> Column:
    """Lanes after paragraphs with the lanes ``right`` are inserted (sign 1) or deleted (sign -1)."""
    return F.zip_with(left, right, lambda a, b: _centred(a.cast("long") + b.cast("long") * sign)).cast("array<int>")


def checks_added(left: Column, right: Column, sign: int = 1) -> Column:
    """As ``added``, for checks."""
    return F.zip_with(left, right, lambda a, b: F.pmod(a + b * sign, F.lit(1 << 32)))


def likeness(left: Column, left_checks: Column, right: Column, right_checks: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1; 1 for equal ones.

    A lane sums one random sign per pair of neighbouring words, so products of
    lanes estimate how many word pairs the texts share (cosine of the counts,
    give or take an eighth; of texts up to 2 ** 31 words, where no lane wraps).
    """
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    norms = F.sqrt(dot(left, left) * dot(right, right))
    cosine = F.when(norms > 0, dot(left, right) / norms).otherwise(F.lit(0.0))
    same = (left == right) & (left_checks == right_checks)
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def note_fingerprints(pins: DataFrame) -> DataFrame:
    """Fingerprint of every pin's ``notes`` as a multiset of paragraphs.

    ``pins`` has ``id`` and ``notes`` of saved pins. Every paragraph (line) is
    hashed to a wide vector: 4 numbers of the whole paragraph and 64 lanes from
    its pairs of neighbouring words. Vectors are added, checks and
    lanes modulo 2 ** 32, so the order of paragraphs does not matter, and
    inserted or deleted paragraphs are added or taken away (``added``,
    ``checks_added``) without the rest of the text.

    Returns one row per ``id``: ``lanes`` (array<int>), ``checks``
    (array<bigint>) and ``fingerprint`` (text). Null notes are empty notes, one
    empty paragraph. Rows that share an id (null is an id) are parts of one pin
    and add up. Extra columns are not carried; an empty table gives no rows.
    """
    summed = _sums(pins.select("id", "notes"), ["id"], ["notes"])
    return summed.select("id", F.col("lanes_0").alias("lanes"), F.col("checks_0").alias("checks"),
                         written(F.col("lanes_0"), F.col("checks_0")).alias("fingerprint"))


def _with_next(pins: DataFrame) -> DataFrame:
    """``_row``, ``id``, ``notes`` with ``_next_row`` and ``_next``: the row after it by falling id, the first after the last.

    Rows are cut into key ranges and ordered inside them; only the first row of
    each range travels to the range above it.
    """
    rows = numbered(pins.select("id", text_of("notes").alias("notes")), "notes")
    low, high, count = pins.agg(F.min("id"), F.max("id"), F.count("*")).first()
    wide = max(1, ((high or 0) - (low or 0)) // max(1, (count or 0) // _RANGE) + 1)
    part = F.coalesce(F.floor((F.col("id") - F.lit(low or 0)) / wide), F.lit(-1)).cast("long")
    rows = rows.withColumn("_part", part).withColumn("_guest", F.lit(0))
    order = F.struct(F.col("id").isNull(), -F.col("id"), F.col("_row"))
    heads = rows.groupBy("_part").agg(F.min_by("_row", order).alias("_head"))
    up = Window.orderBy("_part")
    first = F.first("_part").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = stored(heads.select("_head", F.coalesce(F.lead("_part").over(up), first).alias("_to")), "fingerprint-heads")
    guests = rows.join(heads, F.col("_row") == F.col("_head")).select(
        "id", "notes", "_row", F.col("_to").alias("_part"), F.lit(1).alias("_guest"))
    inside = Window.partitionBy("_part").orderBy("_guest", order)
    both = rows.unionByName(guests)
    return both.select("*", F.lead("_row").over(inside).alias("_next_row"), F.lead("notes").over(inside).alias("_next")).filter("_guest = 0")


def edited_fingerprints(pins: DataFrame) -> DataFrame:
    """Fingerprints of every pin's ``notes`` and of the notes after an edit.

    ``pins`` has ``id`` (whole numbers) and ``notes``. The edit replaces the last
    half (rounded down) of the code points by the first as many, or all, of the
    next pin's notes, by falling id; the first pin follows the last.

    Returns one row per input row: ``id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``
    (``likeness`` to the edited and to the next pin's notes). Null notes are
    empty; null ids come last; rows with equal ids follow each other in input
    order. Extra columns are not carried; an empty table gives no rows.
    """
    n = F.char_length("notes").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("notes"), F.lit(1), (n - half).cast("int")), F.substring(F.col("_next"), F.lit(1), half))
    texts = _with_next(pins).select("_row", "_next_row", "id", "notes", n.alias("n_chars"), edited.alias("_edited"))
    texts = texts.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    summed = stored(_sums(texts, ["_row", "_next_row", "id", "n_chars", "edited_sha256"], ["notes", "_edited"]), "fingerprints")
    after = summed.select(F.col("_row").alias("_next_row"), F.col("lanes_0").alias("_lanes"), F.col("checks_0").alias("_checks"))
    both = summed.join(after, "_next_row")
    own = F.col("lanes_0"), F.col("checks_0")
    return both.select("id", "n_chars", "edited_sha256", written(*own).alias("fingerprint"),
                       written(F.col("lanes_1"), F.col("checks_1")).alias("edited_fingerprint"),
                       likeness(*own, F.col("lanes_1"), F.col("checks_1")).alias("near_edited"),
                       likeness(*own, F.col("_lanes"), F.col("_checks")).alias("near_next"))
