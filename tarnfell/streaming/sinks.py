"""Running a stream over what is there now, with restartable state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.sources.tables import is_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk rather than on the heap; needed for keyed processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Process everything available. Every batch is written under its number.

    A batch that is run again after a failure overwrites its own folder, so the
    sink is exactly-once; ``checkpoint`` keeps counters across restarts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()


def emitted(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows a drained stream has written, with their batch number; none if no batch ran."""
    if not is_folder(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def latest_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key of an update-mode sink."""
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = F.max_by(F.struct(*others), "batch_id").alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")
