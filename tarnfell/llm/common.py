"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.session import scratch_path

#: White space between words, as the body of a regular-expression class.
BLANKS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only if its measured size is below this; beyond it the join is left to Spark.
BROADCAST_BYTES = 8 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit the bound; ``df`` must be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: Steps after which rows may come in another order or number when they are read again.
_UNSTEADY = re.compile(r"Exchange|AdaptiveSparkPlan|ExistingRDD|InMemory|Python|Pandas|Arrow|MapIn|Sample|Generate|Limit|Union|Join")


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``_row``, a number of the row that stays the same however often the result is read.

    Rows of files are numbered as they are read. Anything that may deal rows out
    anew (a shuffle, a join, Python) is written to the shared folder first.
    """
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    df = stored(df, label) if _UNSTEADY.search(re.sub(r"\[[^\]]*\]|Location:.*", "", said.getvalue())) else df
    return df.withColumn("_row", F.monotonically_increasing_id())


def text_of(column: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    Plain ASCII text takes the quick whole-string path; the mapping by
    character is only for texts where lower case would touch other letters.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Maximal runs of characters outside the class body ``separators``."""
    return F.array_remove(F.split(text, f"[{separators}]+"), "")


def over_positions(count: Column, body: Callable[[Column], Column], empty: Column) -> Column:
    """``body`` at 0 .. count - 1; ``empty`` (a typed empty array) without positions."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), body)).otherwise(empty)


def no_longs() -> Column:
    return F.array().cast("array<bigint>")


def bound_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)
