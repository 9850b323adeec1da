"""Ordered computations that survive a hot key.

A window over a key that holds a third of all rows is one task. Here each key
is first cut into chunks along its order; windows run inside ``(key, chunk)``,
a grouping with map-side partial aggregation summarises each chunk in one row,
and only those summaries are ordered per key. ``chunk`` must not decrease along
the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.session import materialised

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def counted_chunks(df: DataFrame, key: list[str], order: list[str], rows: int = 1 << 16) -> DataFrame:
    """``df`` with ``_chunk``, which rises along ``order`` within a key and has about ``rows`` rows.

    Rows are dealt out by ranges of key and order, whose bounds Spark takes from a sample of the rows: a
    second in which a third of all rows fall is cut like any other stretch, as long as
    ``order`` tells rows apart. The result is written, so that chunks stay what they are.
    """
    whole = materialised(df, "unchunked")
    number = max(1, -(-whole.count() // rows))
    dealt = whole.repartitionByRange(number, *key, *order) if number > 1 else whole.coalesce(1)
    return materialised(dealt.withColumn("_chunk", F.spark_partition_id().cast("long")), "chunks")


def dense_ids(df: DataFrame, order: str, out: str, major: list[str] | None = None,
              width: int = 1 << 16, start: int = 1) -> DataFrame:
    """Consecutive ids in the order of ``(*major, order)``; ``order`` is a unique whole number.

    The only unpartitioned window sees one row per ``width`` numbers, so it
    stays small: a million rows for 6e10 ids.
    """
    major = major or []
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / width))
    sizes = chunked.groupBy(*major, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*major, "_chunk").rowsBetween(*_BEFORE))
    offsets = sizes.select(*major, "_chunk", F.coalesce(before, F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*major, "_chunk").orderBy(order))
    numbered = chunked.withColumn("_local", local).join(offsets, [*major, "_chunk"])
    return (numbered.withColumn(out, F.col("_offset") + F.col("_local") + (start - 1))
            .drop("_chunk", "_local", "_offset"))


def running_totals(df: DataFrame, key: list[str], chunk: str, order: list[str],
                   totals: dict[str, Column]) -> DataFrame:
    """Running sums, current row included."""
    local = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(*_UP_TO)
    carry = Window.partitionBy(*key).orderBy(chunk).rowsBetween(*_BEFORE)
    sums = df.groupBy(*key, chunk).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in totals.items()])
    carried = sums.select(*key, chunk, *[
        F.coalesce(F.sum(f"_s_{n}").over(carry), F.lit(0)).alias(f"_c_{n}") for n in totals])
    inside = df.select("*", *[F.sum(v).over(local).alias(f"_l_{n}") for n, v in totals.items()])
    joined = inside.join(carried, [*key, chunk])
    kept = [c for c in df.columns]
    return joined.select(*kept, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in totals])


def previous_value(df: DataFrame, key: list[str], chunk: str, order: list[str], value: Column, out: str,
                   skip_null: bool = False, include_current: bool = False) -> DataFrame:
    """Value of the row before (optionally the latest non-null one at or before)."""
    frame = _UP_TO if include_current else _BEFORE
    local = Window.partitionBy(*key, chunk).orderBy(*order)
    boxed = F.struct(value.alias("v"))
    usable = F.when(value.isNotNull(), boxed) if skip_null else boxed
    near = F.last(usable, ignorenulls=True).over(local.rowsBetween(*frame))
    tail = df.groupBy(*key, chunk).agg(F.max_by(usable, F.when(usable.isNotNull(), F.struct(*order))).alias("_tail"))
    carry = Window.partitionBy(*key).orderBy(chunk).rowsBetween(*_BEFORE)
    carried = tail.select(*key, chunk, F.last("_tail", ignorenulls=True).over(carry).alias("_carried"))
    joined = df.withColumn("_near", near).join(carried, [*key, chunk])
    return joined.withColumn(out, F.coalesce("_near", "_carried")["v"]).drop("_near", "_carried")


def next_value(df: DataFrame, key: list[str], chunk: str, order: list[str], value: Column, out: str,
               skip_null: bool = False) -> DataFrame:
    """Value of the row after (optionally the next non-null one); null where there is none."""
    local = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    boxed = F.struct(value.alias("v"))
    usable = F.when(value.isNotNull(), boxed) if skip_null else boxed
    head = df.groupBy(*key, chunk).agg(F.min_by(usable, F.when(usable.isNotNull(), F.struct(*order))).alias("_head"))
    later = Window.partitionBy(*key).orderBy(chunk).rowsBetween(1, Window.unboundedFollowing)
    carried = head.select(*key, chunk, F.first("_head", ignorenulls=True).over(later).alias("_carried"))
    near = F.first(usable, ignorenulls=True).over(local)
    joined = df.withColumn("_near", near).join(carried, [*key, chunk])
    return joined.withColumn(out, F.coalesce("_near", "_carried")["v"]).drop("_near", "_carried")
