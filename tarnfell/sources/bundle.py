"""The gazetteer bundle: six Parquet tables written together, complete once their manifest is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.operators import gazetteer, search
from tarnfell.sources.tables import is_folder

KEYS = {"place": "place_id", "alias": "alias_id", "municipality": "muni", "language": "lang_id",
        "term": "owner_id", "meta": None}


def write_bundle(places: DataFrame, aliases: DataFrame, doomed: DataFrame, path: str) -> None:
    """Write place, alias, municipality, language, term and meta below ``path``.

    Terms are range-partitioned by (term, owner): a prefix query then touches
    few files, and one hot term is still spread over many of them.
    """
    muni_key = ["country", "adm", "region"]
    municipality = gazetteer.interned(places, muni_key, "place_id", "muni")
    language = gazetteer.interned(aliases, ["lang"], "alias_id", "lang_id")
    kept = gazetteer.without(places, doomed)
    kept_aliases = gazetteer.without(aliases, doomed)
    gazetteer.with_interned(kept, municipality, muni_key, "muni").select(
        "place_id", "kind", "rank", "lat_e5", "lon_e5", "country", "muni", "name").write.parquet(f"{path}/place")
    gazetteer.with_interned(kept_aliases, language, ["lang"], "lang_id").select(
        "alias_id", "place_id", "name", "lang_id").write.parquet(f"{path}/alias")
    municipality.write.parquet(f"{path}/municipality")
    language.write.parquet(f"{path}/language")
    spark = places.sparkSession
    written = search.index_input(spark.read.parquet(f"{path}/place"), spark.read.parquet(f"{path}/alias"))
    terms = search.term_index(written).withColumn("prefix", F.substring("term", 1, 2))
    terms.repartitionByRange("term", "owner_id").sortWithinPartitions("term", "owner_id").write.parquet(f"{path}/term")
    summary = gazetteer.build_summary(spark.read.parquet(f"{path}/place"), spark.read.parquet(f"{path}/alias"), doomed)
    summary.coalesce(1).write.parquet(f"{path}/meta")
    bundle_counts(spark, path).coalesce(1).write.parquet(f"{path}/manifest")


def bundle_counts(spark: SparkSession, path: str) -> DataFrame:
    """Row count and key sum of every table of a bundle."""
    out = None
    for part, key in KEYS.items():
        total = F.sum(key) if key else F.lit(None)
        counted = spark.read.parquet(f"{path}/{part}").agg(
            F.lit(part).alias("part"), F.count("*").alias("n"), total.cast("long").alias("key_sum"))
        out = counted if out is None else out.unionByName(counted)
    return out


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables of a complete bundle by name; without its manifest, or with rows amiss, it is an error."""
    if not is_folder(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"no complete bundle at {path}")
    said, found = spark.read.parquet(f"{path}/manifest"), bundle_counts(spark, path)
    amiss = sorted(r["part"] for r in said.exceptAll(found).collect())  # of six rows
    if amiss:
        raise ValueError(f"tables of the bundle at {path} don't fit its manifest: {', '.join(amiss)}")
    return {part: spark.read.parquet(f"{path}/{part}") for part in KEYS}


def bundle_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Every row of a bundle as ``part``, ``key`` (0 for the summary) and ``content``, its other columns joined by bars."""
    out = None
    for part, key in KEYS.items():
        rest = [c for c in tables[part].columns if c not in (key, "prefix")]
        rows = tables[part].select(F.lit(part).alias("part"), (F.col(key) if key else F.lit(0)).cast("long").alias("key"),
                                   F.concat_ws("|", *rest).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out
