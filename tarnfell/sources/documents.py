"""JSON document directories: saved routes, saved pins, route catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.sources.tables import is_folder

COORDINATE = "struct<lat: double, lon: double>"
SAVED_ROUTE = f"""id string, createdAt timestamp, meters double, coordinates array<{COORDINATE}>, strokeSizes array<int>,
    ascent double, descent double, elevations array<double>, name string, schemaVersion int"""
SAVED_PIN = f"id string, createdAt timestamp, coordinate {COORDINATE}, name string, notes string, schemaVersion int"
CATALOGUE = """schemaVersion int, routes array<struct<id: string, name: string, subtitle: string, meters: double, ascent: double,
    descent: double, coordinates: array<array<double>>, elevations: array<double>>>"""


def read_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Documents of a directory: ``*.json`` only, unreadable ones left out, absent fields null."""
    return (spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", str(multi_line).lower())
            .option("pathGlobFilter", "*.json").json(path)).filter("id IS NOT NULL")


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000,
                    multi_line: bool = True) -> DataFrame:
    """The same directory as a stream of new files. A file is read once: see ``poll`` for rewrites and deletions."""
    return (spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
            .option("multiLine", str(multi_line).lower())
            .option("maxFilesPerTrigger", files_per_trigger).json(path)).filter("id IS NOT NULL")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, modified, length`` of every document file, without reading any."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path))
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def document_changes(spark: SparkSession, path: str, schema: str, before: DataFrame,
                     multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """What has changed in a directory since ``before``, an earlier ``listing`` that was stored.

    Returns the documents of new and rewritten files, read again whole, with their ``path``, and the
    paths (``path``) of deleted files.
    """
    now = listing(spark, path)
    fresh = now.join(before, ["path", "modified", "length"], "left_anti").select("path", "modified")
    return (documents_of(spark, path, schema, fresh, multi_line),
            before.join(now, "path", "left_anti").select("path"))


def documents_of(spark: SparkSession, path: str, schema: str, files: DataFrame, multi_line: bool = True) -> DataFrame:
    """Documents of those files of a directory that ``files`` (``path``, ``modified``) names, with their ``path``.

    Files older than all of them are left out by their listing and never opened.
    """
    oldest = files.agg(F.min("modified")).first()[0]
    read = (spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", str(multi_line).lower())
            .option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path))
    recent = read.filter(F.col("_metadata.file_modification_time") >= F.lit(oldest).cast("timestamp"))
    found = recent.select("*", F.col("_metadata.file_path").alias("path"))
    return found.join(files.select("path"), "path", "left_semi").filter("id IS NOT NULL")


_FILES = "path string, modified timestamp, length bigint, batch_id bigint"


def _newest_files(spark: SparkSession, log: str, below: int | None = None) -> DataFrame:
    """Last entry of every file the log has met, in batches below a number; ``modified`` is null once it is gone."""
    if not is_folder(spark, f"{log}/files"):
        return spark.createDataFrame([], _FILES)
    files = spark.read.schema(_FILES).parquet(f"{log}/files")
    files = files if below is None else files.filter(F.col("batch_id") < below)
    last = F.max_by(F.struct("modified", "length", "batch_id"), "batch_id").alias("_last")
    return files.groupBy("path").agg(last).select("path", "_last.*")


def poll(spark: SparkSession, path: str, schema: str, log: str, number: int, multi_line: bool = True) -> None:
    """Append to a feed's ``log`` what has changed in a directory since the polls before ``number``.

    A stream of files reads every path once and never learns of a rewrite or a
    deletion, so each poll compares listings: ``files`` gets an entry for every new,
    rewritten or deleted file (a tombstone), ``documents`` the documents of the first two.
    A poll that failed is run again under its number and replaces what it left
    behind; a poll without changes writes empty tables. Documents of unchanged files are
    neither read nor written again.
    """
    known = _newest_files(spark, log, number).filter("modified IS NOT NULL")
    now = listing(spark, path)
    fresh = now.join(known, ["path", "modified", "length"], "left_anti")
    gone = known.join(now, "path", "left_anti").select(
        "path", F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("bigint").alias("length"))
    here = f"{log}/files/batch_id={number}"
    fresh.unionByName(gone).write.mode("overwrite").parquet(here)
    files = spark.read.schema("path string, modified timestamp, length bigint").parquet(here).filter("modified IS NOT NULL")
    documents_of(spark, path, schema, files, multi_line).write.mode("overwrite").parquet(f"{log}/documents/batch_id={number}")


def fed_documents(spark: SparkSession, schema: str, log: str) -> DataFrame:
    """Documents of a feed as of its last poll: those of every file's last entry, none of deleted files; with ``path``."""
    kept = _newest_files(spark, log).filter("modified IS NOT NULL").select("path", "batch_id")
    documents = spark.read.schema(f"{schema}, path string, batch_id bigint").parquet(f"{log}/documents")
    return documents.join(kept, ["path", "batch_id"], "left_semi").drop("batch_id")


def read_catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Routes of catalogue files; only coordinate pairs of exactly two numbers are kept, in order."""
    raw = spark.read.schema(CATALOGUE).option("multiLine", str(multi_line).lower()).option("mode", "DROPMALFORMED").json(path)
    routes = raw.select(F.explode("routes").alias("r")).select("r.*")
    pairs = F.filter("coordinates", lambda c: F.size(c) == 2)
    return routes.withColumn("coordinates", F.transform(pairs, lambda c: F.struct(c[0].alias("lat"), c[1].alias("lon"))))


def write_lines(texts: DataFrame, path: str) -> None:
    """One document text per line in ``*.json`` files."""
    (texts.write.format("csv").option("extension", "json").option("sep", "\u0001").option("quote", "")
     .option("escape", "").mode("append").save(path))
