"""Nested XML place register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of the register's schema.
SCHEMA = """
    stedsnummer bigint, navneobjekthovedgruppe string, navneobjektgruppe string, sortering string,
    `språkprioritering` string,
    posisjon string,
    kommune array<struct<Kommune: array<struct<kommunenavn: string, fylkesnavn: string>>>>,
    stedsnavn array<struct<Stedsnavn: struct<navnestatus: string, `språk`: string,
      `skrivemåte`: array<struct<`Skrivemåte`: struct<`komplettskrivemåte`: string, `skrivemåtestatus`: string>>>>>>
"""
ROW_TAG = "Sted"


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """One row per place with its spellings as an array; rows without a position are left out."""
    raw = (spark.read.format("xml").schema(SCHEMA).option("rowTag", ROW_TAG)
           .option("ignoreNamespace", "true").load(path))
    # The geometry as its own markup: positions of points, lines and areas at any depth.
    text = F.concat_ws(" ", F.regexp_extract_all("posisjon", F.lit(r"<(?:\w+:)?pos(?:List)?(?:\s[^>]*)?>([^<]*)<"), F.lit(1)))
    district = F.get(F.flatten(F.transform("kommune", lambda k: k["Kommune"])), 0)
    numbers = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: t.cast("double"))
    xs = F.filter(numbers, lambda _v, i: i % 2 == 0)
    ys = F.filter(numbers, lambda _v, i: i % 2 == 1)

    def spelled(name):
        inner = name["Stedsnavn"]
        return F.transform(inner["skrivemåte"], lambda s: F.struct(
            F.trim(inner["navnestatus"]).alias("name_status"), F.trim(inner["språk"]).alias("language"),
            F.trim(s["Skrivemåte"]["skrivemåtestatus"]).alias("spelling_status"),
            F.trim(s["Skrivemåte"]["komplettskrivemåte"]).alias("written")))

    placed = raw.withColumn("_xs", xs).withColumn("_ys", ys).filter(F.size("_ys") > 0)
    return placed.select(
        F.col("stedsnummer").alias("native_id"), F.col("navneobjekthovedgruppe").alias("main_group"),
        F.col("navneobjektgruppe").alias("sub_group"), F.col("sortering").alias("sorting"),
        F.col("språkprioritering").alias("priority"),
        ((F.array_min("_xs") + F.array_max("_xs")) / 2).alias("x"),
        ((F.array_min("_ys") + F.array_max("_ys")) / 2).alias("y"),
        district["kommunenavn"].alias("adm"), district["fylkesnavn"].alias("region"),
        F.flatten(F.transform("stedsnavn", spelled)).alias("spellings"))


#: Records of one file at most. A file of markup is read by one task, so files must not grow with the register.
FILE_RECORDS = 20_000


def write_register(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write records of the same nested shape as XML parts, of ``file_records`` records at most."""
    (records.hint("rebalance").write.format("xml").option("rowTag", ROW_TAG).option("rootTag", "SSR")
     .option("maxRecordsPerFile", file_records).save(path))
