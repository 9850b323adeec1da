"""Mix localised strings to target weights by locale, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.llm.common import BLANKS, stored, text_of
from tarnfell.operators.ordered import running_totals

_SEED = 20_240


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than white space."""
    pieces = F.size(F.split(text, f"[{BLANKS}]+"))
    edge = F.lit(f"^[{BLANKS}]"), F.lit(f"[{BLANKS}]$")
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(0), (
        pieces - F.rlike(text, edge[0]).cast("int") - F.rlike(F.right(text, F.lit(1)), edge[1]).cast("int")))).cast("long")


def _unit(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1) of its arguments."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(_SEED), *parts), 11) / F.lit(float(1 << 53))


def _permuted(index: Column, count: Column, *key: Column, rounds: int = 6) -> Column:
    """Pseudorandom permutation of 0 .. count - 1: a linear step, then swap-or-not rounds.

    A round mirrors the number at a keyed point and takes the image or not by a
    bit that both of the pair agree on, so it is one to one for any count.
    """
    prime = (1 << 31) - 1  # larger than any count below 2 ** 31, so coprime to it
    first = F.pmod(F.pmod(index, count) * F.lit(prime) + F.pmod(F.xxhash64(F.lit(_SEED), *key), count), count)

    def swapped(x: Column, step: Column) -> Column:
        image = F.pmod(F.pmod(F.xxhash64(F.lit(_SEED), step, *key), count) - x, count)
        bit = F.pmod(F.xxhash64(F.greatest(x, image), step, *key), F.lit(2))
        return F.when(bit == 1, image).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, swapped)


def targets(sized: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Per locale: ``_size``, ``_weight`` and ``target``.

    ``sized`` has ``locale`` and ``size``. Locales in code-point order, null
    last, weigh ``weights`` in turn and share ``share`` of all words; none gets
    more than ``most`` times its own, the excess goes to the others by weight.
    Water-filling in closed form: capped locales are those with the smallest
    cap per weight. One row per locale passes the single-partition windows.
    """
    per = sized.groupBy("locale").agg(F.sum("size").alias("_size"))
    order = Window.orderBy(F.col("locale").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    per = per.withColumn("_cap", F.col("_size") * F.lit(float(most))).withColumn("_level", F.col("_cap") / F.col("_weight"))
    every = Window.partitionBy(F.lit(0))
    up = Window.partitionBy(F.lit(0)).orderBy("_level", F.col("locale").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_total", F.sum("_size").over(every) * F.lit(float(share)))
    per = per.withColumn("_capped", F.coalesce(F.sum("_cap").over(up), F.lit(0.0)))
    per = per.withColumn("_free", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(up), F.lit(0.0)))
    # The water level if this locale and all above it stay below their caps.
    per = per.withColumn("_water", (F.col("_total") - F.col("_capped")) / F.col("_free"))
    level = F.max(F.when(F.col("_water") <= F.col("_level"), F.col("_water"))).over(every)
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_weight")))
    return per.select("locale", "_size", "_weight", target.alias("target"))


def _offsets(sized: DataFrame) -> DataFrame:
    """``sized`` with ``_at``, the words of the locale that stand before the row (by key, then row).

    Rows are cut into buckets of key ranges, about a thousand rows each, so that
    no locale is one window however large it is.
    """
    low, high, count = sized.agg(F.min("key"), F.max("key"), F.count("*")).first()
    wide = max(1, ((high or 0) - (low or 0) + 1) // max(1, (count or 0) // 1024) + 1)
    bucket = F.coalesce(F.floor((F.col("key") - F.lit(low or 0)) / wide), F.lit(-1)).cast("long")
    cut = sized.withColumn("_bucket", bucket)
    sums = cut.groupBy("locale", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("locale").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col("locale").alias("_l"), F.col("_bucket").alias("_b"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy("locale", "_bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(carried, F.col("locale").eqNullSafe(F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    return joined.select("key", "locale", "size", (F.col("_local") + F.col("_carry")).alias("_at"))


def mixed(strings: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: float = 2.0,
          block: int = 32, shard: int = 4096) -> DataFrame:
    """How many words a mix by locale takes of each string.

    ``strings`` has ``key`` (whole numbers), ``locale`` and ``value`` of a
    string catalogue. See ``targets`` for ``weights``, ``share`` and ``most``.

    Method: each locale's words, in key order, are packed into blocks of
    ``block`` words (the last may be short). The mix is a row of block slots in
    shards of ``shard``; each slot draws its locale with the target weights, so
    a shard's counts are one multinomial draw. The n-th slot of a locale takes
    the block that a pseudorandom permutation assigns to n (a fresh one for each
    pass over the locale), and blocks are joined to strings by index. Draws
    beyond a locale's target are settled at the end: they go to locales that
    were drawn too rarely, so totals meet the targets to within a block. All
    draws are hashes of positions, so reruns agree.

    Returns one row per input row: ``key``, ``locale``, ``size`` (words), ``locale_size``,
    ``target`` (of its locale) and ``taken``; no string is taken more than
    ``most`` (rounded up) times. Null values have no words; null is a locale of
    its own; null keys come first in their locale. Repeated rows are separate
    strings. Extra columns are not carried; an empty table gives no rows.
    """
    weights = weights or [3, 1, 2]
    sized = strings.select(F.col("key").cast("long").alias("key"), "locale", word_count(text_of("value")).alias("size"))
    placed = stored(_offsets(stored(sized, "string-sizes")).withColumn("_row", F.monotonically_increasing_id()), "string-places")
    per = stored(quotas(targets(placed, weights, share, most), block, most), "locale-targets")
    times = slots(per, shard).groupBy("_no", "_block").agg(F.count("*").alias("_times"))
    known = per.select(F.col("locale").alias("_l"), "_no", "_size", "target")
    rows = placed.join(known, F.col("locale").eqNullSafe(F.col("_l")))
    first, last = F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block)
    pieces = rows.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("_block"))
    pieces = pieces.join(times, ["_no", "_block"], "left")
    inside = (F.least(F.col("_at") + F.col("size"), (F.col("_block") + 1) * block)
              - F.greatest(F.col("_at"), F.col("_block") * block))
    taken = F.sum(F.coalesce(inside * F.col("_times"), F.lit(0)))
    summed = pieces.groupBy("_row", "key", "locale", "size", "_size", "target").agg(taken.alias("taken"))
    return summed.select("key", "locale", "size", F.col("_size").alias("locale_size"), "target", "taken")


def quotas(per: DataFrame, block: int, most: float) -> DataFrame:
    """``targets`` with ``_no`` (the locale's number), ``_blocks``, ``_quota`` (blocks to take) and ``_to`` (running sum)."""
    blocks = F.ceil(F.col("_size") / block).cast("long")
    filled = F.col("_size") / F.when(F.col("_blocks") > 0, F.col("_blocks"))
    wanted = F.coalesce(F.round(F.col("target") / filled).cast("long"), F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("locale").asc_nulls_last())
    per = per.withColumn("_blocks", blocks).withColumn("_no", F.row_number().over(order))
    per = per.withColumn("_quota", F.least(wanted, F.ceil(F.col("_blocks") * F.lit(float(most))).cast("long")))
    return per.withColumn("_to", F.sum("_quota").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _drawn(per: DataFrame, total: int, shard: int) -> DataFrame:
    """Multinomial counts ``_count`` by ``_shard`` and ``_no``; a uniform draw finds its locale through equal cells."""
    spark = per.sparkSession
    cell = max(1, total // 4096)
    number = spark.range(-(-total // shard)).select(F.col("id").alias("_shard"))
    slot = number.select("_shard", F.explode(F.sequence(F.lit(0), F.lit(shard - 1))).alias("_slot"))
    slot = slot.filter(F.col("_shard") * shard + F.col("_slot") < total)
    slot = slot.select("_shard", F.floor(_unit(F.col("_shard"), F.col("_slot")) * total).cast("long").alias("_draw"))
    slot = slot.withColumn("_cell", F.floor(F.col("_draw") / cell))
    span = per.filter("_quota > 0").select("_no", (F.col("_to") - F.col("_quota")).alias("_from"), "_to")
    span = span.select("_no", "_from", "_to", F.explode(
        F.sequence(F.floor(F.col("_from") / cell), F.floor((F.col("_to") - 1) / cell))).alias("_cell"))
    met = slot.join(span, "_cell").filter((F.col("_from") <= F.col("_draw")) & (F.col("_draw") < F.col("_to")))
    return met.groupBy("_shard", "_no").agg(F.count("*").alias("_count"))


def slots(per: DataFrame, shard: int) -> DataFrame:
    """Every slot of the mix: ``_shard``, ``_no`` (locale) and ``_block`` (its index in the locale).

    ``per`` comes from ``quotas`` and must be stored: it is read several times.
    """
    total = per.agg(F.coalesce(F.sum("_quota"), F.lit(0))).first()[0]
    counts = stored(_drawn(per, total, shard), "shard-draws")
    turns = running_totals(counts.withColumn("_thousand", F.floor(F.col("_shard") / 1024)), ["_no"], "_thousand",
                           ["_shard"], {"_upto": F.col("_count")})
    turns = turns.select("_shard", "_no", F.explode(
        F.sequence(F.col("_upto") - F.col("_count"), F.col("_upto") - 1)).alias("_turn"))
    got = counts.groupBy("_no").agg(F.sum("_count").alias("_got"))
    order = Window.partitionBy(F.lit(0)).orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("_got") - F.col("_quota"), F.lit(0)), F.greatest(F.col("_quota") - F.col("_got"), F.lit(0))
    even = per.select("_no", "_quota", "_blocks").join(got, "_no", "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    even = even.select("*", F.coalesce(F.sum(over).over(order), F.lit(0)).alias("_over_at"),
                       F.coalesce(F.sum(under).over(order), F.lit(0)).alias("_under_at"), under.alias("_under"))
    even = stored(even, "shard-settlement")
    turns = turns.join(even.select("_no", "_quota", "_over_at"), "_no")
    kept = turns.filter("_turn < _quota").select("_shard", "_no", "_turn")
    spare = turns.filter("_turn >= _quota").select("_shard", (F.col("_over_at") + F.col("_turn") - F.col("_quota")).alias("_index"))
    missing = even.filter("_under > 0").select("_no", "_got", "_under_at", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("_under") - 1)).alias("_k"))
    missing = missing.select("_no", (F.col("_got") + F.col("_k")).alias("_turn"), (F.col("_under_at") + F.col("_k")).alias("_index"))
    settled = spare.join(missing, "_index").select("_shard", "_no", "_turn")
    turns = kept.unionByName(settled).join(even.select("_no", "_blocks"), "_no")
    block = _permuted(F.col("_turn"), F.col("_blocks"), F.col("_no"), F.floor(F.col("_turn") / F.col("_blocks")))
    return turns.select("_shard", "_no", block.alias("_block"))
