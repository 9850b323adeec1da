"""Table audits: fields, consistency, inventories, translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import fixed

_BLANKS = " \t\n\r\f\x0b\x00"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def field_problems(metadata: DataFrame) -> DataFrame:
    """Missing, empty, too long or badly separated fields per locale.

    ``metadata(locale, field, value)``, one row per locale and field. Required
    fields are listed per locale, so an absent one is a row to check as well.
    """
    required = F.array(*[F.lit(f) for f in fixed.REQUIRED_FIELDS])
    wanted = metadata.select("locale").distinct().select("locale", F.explode(required).alias("field"))
    optional = metadata.filter(F.col("field") == "release_notes").select("locale", "field")
    rows = wanted.unionByName(optional).join(metadata, ["locale", "field"], "left")
    value = stripped(F.col("value"))
    limit = fixed.lookup(F.col("field"), fixed.FIELD_LIMITS)
    is_required = F.col("field") != "release_notes"
    problems = F.array_compact(F.array(
        F.when(F.col("value").isNull(), "missing"),
        F.when(is_required & (value == ""), "empty"),
        F.when(F.length(value) > limit, "too long"),
        F.when((F.col("field") == "keywords") & value.contains(", "), "separator")))
    return rows.select("locale", "field", F.explode(problems).alias("problem"))


def inconsistent_fields(metadata: DataFrame) -> DataFrame:
    """Fields that must be equal everywhere but are not."""
    shared = metadata.filter(F.col("field").endswith("_url")).select("field", stripped(F.col("value")).alias("value"))
    counted = shared.groupBy("field").agg(F.countDistinct("value").alias("n_values"))
    return counted.filter("n_values > 1")


def reconciled(expected: DataFrame, actual: DataFrame, group: list[str]) -> DataFrame:
    """Expected against actual files per group; of several copies one keeper is judged.

    ``expected(*group, name, checksum, size)`` is unique by group and name;
    ``actual(*group, name, copy_id, checksum, size)`` may repeat. The keeper is
    the copy with the right checksum, else one without checksum of the right
    size, else the first. It is chosen by a minimum, so many copies of one file
    are reduced map-side.
    """
    key = [*group, "name"]
    local = expected.select(*key, F.col("checksum").alias("want"), F.col("size").alias("want_size"))
    known = actual.join(local, key, "left")
    preference = (F.when(F.col("checksum") == F.col("want"), 0)
                  .when(F.col("checksum").isNull() & (F.col("size") == F.col("want_size")), 1).otherwise(2))
    keepers = known.groupBy(*key).agg(
        F.min_by(F.struct("copy_id", "checksum", "size"), F.struct(preference, F.col("copy_id"))).alias("k"),
        F.count("*").alias("copies"))
    joined = keepers.join(local, key, "full_outer")
    state = (F.when(F.col("k").isNull(), "missing")
             .when(F.col("want").isNull(), "unexpected")
             .when(F.col("k.checksum") == F.col("want"), "ok")
             .when(F.col("k.checksum").isNotNull(), "stale")
             .when(F.col("k.size") != F.col("want_size"), "unsettled").otherwise("ok"))
    return joined.select(*key, F.col("k.copy_id").alias("kept_copy"),
                         F.greatest(F.coalesce("copies", F.lit(0)) - 1, F.lit(0)).alias("duplicates"), state.alias("state"))


def expected_minus_actual(keys: DataFrame, languages: list[str], actual: DataFrame) -> DataFrame:
    """Key and language pairs that should exist and do not."""
    wanted = keys.select("str_key").distinct().select(
        "str_key", F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang"))
    return wanted.join(actual.select("str_key", "lang"), ["str_key", "lang"], "left_anti")


def translation_problems(strings: DataFrame, languages: list[str], untranslated: Column, short: Column,
                         max_short: int = 12) -> DataFrame:
    """Missing, unchanged and over-long translations.

    ``untranslated`` and ``short`` are tests on ``str_key``: keys that need no
    translation, and keys whose labels have little room.
    """
    missing = expected_minus_actual(strings.filter(~untranslated), languages, strings).withColumn("problem", F.lit("missing"))
    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.col("value"), F.lit("")) == F.col("str_key"), "same as key"),
        F.when(short & (F.length("value") > max_short), "too long")))
    present = strings.filter(~untranslated).select("str_key", "lang", F.explode(problems).alias("problem"))
    return missing.unionByName(present)
