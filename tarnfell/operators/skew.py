"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.session import materialised


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with one row per group, where ``size`` counts the group's rows.

    Joined directly, an aggregate on the same key brings its partitioning along,
    and adaptive skew splitting does not reach the join: a hot group would be
    one task. So the groups are written first. The join then has exchanges of
    its own on both sides, which Spark splits where a key is hot, or broadcasts
    the groups if their measured size is small; neither side is read twice.
    """
    return rows.join(materialised(groups, "groups"), keys).drop(size)


def sized(rows: DataFrame, keys: list[str], size: str, *aggregates: Column) -> DataFrame:
    """One row per group with its row count, for ``join_groups``."""
    return rows.groupBy(*keys).agg(F.count("*").alias(size), *aggregates)
