"""Chains: rows of which each names the next, followed in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.session import cut_lineage


def followed(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """``key``, ``node``, ``number`` of every node met from the starts, which have number 1.

    ``starts`` has ``key`` and ``node``, one per key; ``pointers`` has ``key``, ``node`` and ``next``, which must lead
    forward. Pointer doubling: after round k all nodes up to number 2 ** k are known and
    pointers jump 2 ** k nodes, so one join gives the next 2 ** k and one more doubles the jumps.
    Rounds grow with the logarithm of the longest chain, however many rows lie between its nodes.
    """
    reached = cut_lineage(starts.select("key", "node", F.lit(1).cast("long").alias("number")))
    jumps = cut_lineage(pointers.filter(F.col("next").isNotNull()).select("key", "node", "next"))
    step = 1
    while True:
        more = cut_lineage(reached.join(jumps, ["key", "node"]).select(
            "key", F.col("next").alias("node"), (F.col("number") + step).alias("number")))
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        onward = jumps.select("key", F.col("node").alias("next"), F.col("next").alias("_far"))
        jumps = cut_lineage(jumps.join(onward, ["key", "next"]).select("key", "node", F.col("_far").alias("next")))
        step *= 2
