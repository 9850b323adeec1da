"""Documents and configuration: labels, ids, templates, newest versions, free numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.operators.ordered import previous_value

_USABLE_URL = r"(?i)^https?://[^/?#\s]+\S*$"
_VERSION = r"^[0-9]+\.[0-9]+(\.[0-9]+)?$"


def rendered_url(template: Column, fallback: Column, z: Column, x: Column, y: Column) -> Column:
    """The template with its numbers filled in; the fallback when the result is not a web address."""

    def fill(text: Column) -> Column:
        for name, value in (("{z}", z), ("{x}", x), ("{y}", y)):
            text = F.replace(text, F.lit(name), value.cast("string"))
        return text

    return F.when(fill(template).rlike(_USABLE_URL), fill(template)).otherwise(fill(fallback))


def well_formed_version(version: Column) -> Column:
    return F.coalesce(version.rlike(_VERSION), F.lit(False))


def usable_template(template: Column) -> Column:
    holders = template.contains("{z}") & template.contains("{x}") & template.contains("{y}")
    zero = F.lit(0)
    filled = rendered_url(template, F.lit(""), zero, zero, zero)
    return F.coalesce(holders & (filled != ""), F.lit(False))


def valid_configuration(version: Column, templates: list[Column]) -> Column:
    valid = well_formed_version(version)
    for t in templates:
        valid = valid & usable_template(t)
    return valid


def normalised_name(name: Column) -> Column:
    """Trimmed; blank means none."""
    return F.nullif(F.trim(name), F.lit(""))


def route_title(name: Column, created: Column) -> Column:
    return F.coalesce(normalised_name(name), F.date_format(created, "yyyy-MM-dd HH:mm"))


def pin_title(name: Column) -> Column:
    return F.coalesce(normalised_name(name), F.lit(""))


def distance_label(metres: Column) -> Column:
    """Whole metres under a kilometre, else kilometres with two decimals."""
    return F.when(metres < 1000, F.format_string("%d m", F.round(metres).cast("long"))).otherwise(
        F.format_string("%.2f km", F.bround(metres / 1000, 2)))


def marker_label(metres: Column) -> Column:
    return F.format_string("%d km", F.round(metres / 1000).cast("long"))


def stable_id(text: Column) -> Column:
    """The first 16 UTF-8 bytes, zero padded, in the dashed form of a 16-byte id."""
    digits = F.rpad(F.substring(F.lower(F.hex(F.encode(text, "UTF-8"))), 1, 32), 32, "0")
    return F.concat_ws("-", *[F.substring(digits, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def latest_per_id(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last write of each id, by a grouping with partial aggregation: a hot id is cheap."""
    others = [c for c in writes.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    return writes.groupBy(key).agg(last).select(key, "_last.*")


def newest_first(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.orderBy(*[F.col(c).desc() for c in order])


def smallest_free_number(taken: DataFrame, owner: str, number: str) -> DataFrame:
    """Smallest number from 1 that the owner has not used.

    It is 1 or the successor of a used number, so used numbers are enough; an
    owner with most of the rows is met by (owner, number), never as one group.
    """
    used = taken.filter(F.col(number) >= 1).select(owner, number).distinct()
    owners = taken.select(owner, F.lit(1).cast("long").alias(number)).distinct()
    candidates = used.select(owner, (F.col(number) + 1).alias(number)).unionByName(owners)
    free = candidates.join(used, [owner, number], "left_anti")
    return free.groupBy(owner).agg(F.min(number).alias("free_number"))


def configuration_in_effect(timeline: DataFrame, key: str, order: list[str], chunk: str, builtin: str) -> DataFrame:
    """Newest valid configuration at or before each row, else the built-in one.

    ``timeline`` mixes configuration rows (``version`` and ``valid`` set) and
    requests (``version`` null). A channel's whole history may be hot, so the
    carry runs over time chunks.
    """
    candidate = F.when(F.coalesce("valid", F.lit(False)), F.col("version"))
    carried = previous_value(timeline, [key], chunk, order, candidate, "in_effect", skip_null=True, include_current=True)
    return carried.withColumn("in_effect", F.coalesce("in_effect", F.lit(builtin)))
