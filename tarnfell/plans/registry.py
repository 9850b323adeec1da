"""Query registry: a Spark plan per name, with its SQL oracle where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfell.session import pin_utc

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``; ``oracle`` is equivalent DuckDB SQL."""

    def wrap(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return plan(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = plan.__doc__
        PLANS[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return wrap
