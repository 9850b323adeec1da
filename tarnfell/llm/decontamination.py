"""Notes that repeat passages of a held-out set of strings, by winnowed word grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.llm.common import ascii_lower, broadcast_if_small, no_longs, over_positions, split_words, stored, text_of

#: Everything that is no digit, no letter a-z and plain ASCII separates words.
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def _words(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_WORD)


def _grams(words: Column, k: int) -> Column:
    """Hash of the k words that begin at each position."""
    return over_positions(F.size(words) - (k - 1),
                          lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]), no_longs())


def _chosen(df: DataFrame, k: int, span: int) -> DataFrame:
    """``df`` (with ``_words``) by winnowed gram: ``_at`` and ``_gram``.

    Of every ``span - k + 1`` neighbouring grams the smallest is kept, with all
    its ties. Equal stretches of ``span`` words therefore keep a gram at the
    same place, whatever stands around them. Outer explosion, because a plain one
    would have the optimizer test the arrays' sizes before they are computed, by
    computing them again for every reference.
    """
    wide = span - k + 1
    df = df.withColumn("_grams", _grams(F.col("_words"), k))
    if wide == 1:
        return df.select("*", F.posexplode_outer("_grams").alias("_at", "_gram")).filter("_at is not null")
    grams, least = F.col("_grams"), F.col("_least")
    df = df.withColumn("_least", over_positions(
        F.size(grams) - (wide - 1), lambda i: F.least(*[F.get(grams, i + j) for j in range(wide)]), no_longs()))

    def kept(i: Column) -> Column:
        hit = F.lit(False)
        for j in range(wide):
            hit = hit | F.coalesce(F.get(grams, i) == F.get(least, i - j), F.lit(False))
        return hit

    places = F.when(F.size(least) > 0, F.filter(F.sequence(F.lit(0), F.size(grams) - 1), kept))
    df = df.withColumn("_places", F.coalesce(places, F.array().cast("array<int>"))).drop("_least")
    each = df.select("*", F.explode_outer("_places").alias("_at")).filter("_at is not null")
    return each.withColumn("_gram", F.get("_grams", F.col("_at")))


def _windows(strings: DataFrame, span: int) -> DataFrame:
    """Distinct windows of the strings: ``_text``, ``_long`` (words) and ``_keys``, the strings that hold them."""
    words = strings.select(F.col("key").cast("string").alias("_key"), _words(text_of("value")).alias("_words"))
    words = words.filter(F.size("_words") > 0)
    count = F.greatest(F.size("_words") - (span - 1), F.lit(1))
    each = words.select("_key", "_words", F.explode(F.sequence(F.lit(1), count)).alias("_from"))
    each = each.select("_key", F.slice("_words", F.col("_from"), F.lit(span)).alias("_window"))
    return (each.groupBy(F.array_join("_window", " ").alias("_text"))
            .agg(F.first(F.size("_window")).alias("_long"), F.collect_set("_key").alias("_keys")))


def repeated_passages(pins: DataFrame, strings: DataFrame, span: int = 10, gram: int = 5) -> DataFrame:
    """Which words of each pin's ``notes`` lie inside a passage of the app's ``strings``.

    ``pins`` has ``id`` and ``notes`` of saved pins; ``strings`` has ``key`` and
    ``value`` of a string catalogue that must stay unseen. A passage is ``span``
    consecutive words of a string, or the whole string if it is shorter; words
    are compared with A-Z in lower case, punctuation separates them.

    Method: winnowing. Both sides keep the smallest hash of ``gram`` words out of
    ``span - gram + 1`` neighbours, so a shared passage always shares a kept hash.
    Hashes are joined and each hit is extended to its passage and compared word
    by word with the row's own notes. Strings shorter than ``span`` are looked
    up under their own length (window of one).

    Returns one row per input row: ``id``, ``n_words``, ``n_hit`` (words inside
    passages), ``n_items`` and ``items`` (keys as text, sorted). Null notes have
    no words; null or wordless strings have no passages; a null key belongs to
    no list but still marks words. Repeated ids are judged row by row, extra
    columns are not carried. Empty tables give no rows, or rows without hits.
    """
    if not 1 <= gram <= span:
        raise ValueError("gram must be between 1 and span")
    own = pins.select("id", text_of("notes").alias("_notes"))
    windows = stored(_windows(strings, span), "passages")
    lengths = [r[0] for r in windows.select("_long").distinct().limit(span).collect()]  # 1 to span, so few
    found = None
    for size in sorted(lengths):
        k = gram if size == span else size
        here = windows.filter(F.col("_long") == size).withColumn("_words", F.split("_text", " "))
        theirs = _chosen(here, k, size).select("_gram", F.col("_at").alias("_offset"), "_text", "_long", "_keys")
        theirs = broadcast_if_small(stored(theirs.distinct(), "passage-grams"), 256)
        ours = _chosen(own.select("id", _words(F.col("_notes")).alias("_words")), k, size).select("id", "_at", "_gram")
        hits = ours.join(theirs, "_gram").select(
            "id", F.struct((F.col("_at") - F.col("_offset")).alias("at"), F.col("_long").alias("long"),
                           F.col("_text").alias("text"), F.col("_keys").alias("keys")).alias("_hit"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        none = F.array().cast("array<string>")
        return own.select("id", F.size(_words(F.col("_notes"))).cast("long").alias("n_words"),
                          F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items"))
    found = found.groupBy(F.col("id").alias("_id")).agg(F.collect_set("_hit").alias("_hits"))
    both = own.join(found, F.col("id").eqNullSafe(F.col("_id")), "left")
    words = F.col("_words")
    both = both.select("id", "_hits", _words(F.col("_notes")).alias("_words"))
    # Extend each hit over its passage: the words themselves must agree.
    right = F.filter("_hits", lambda h: (h["at"] >= 0) & (
        F.array_join(F.slice(words, F.greatest(h["at"], F.lit(0)) + 1, h["long"]), " ") == h["text"]))
    both = both.select("id", F.size("_words").cast("long").alias("n_words"),
                       F.when(F.col("_hits").isNotNull(), F.array_sort(right)).alias("_hits"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate("_hits", start, lambda a, h: F.struct(
        F.greatest(a["end"], h["at"] + h["long"]).alias("end"),
        (a["total"] + F.greatest(F.lit(0), h["at"] + h["long"] - F.greatest(a["end"], h["at"]))).alias("total")),
        lambda a: a["total"])
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["keys"]))))
    both = both.select("id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce(keys, F.array().cast("array<string>")).alias("items"))
    return both.select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")
