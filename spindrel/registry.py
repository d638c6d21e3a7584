"""All queries of the library with their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from spindrel.plans.catalog import ORACLES, QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def for_workers(f: Query) -> Query:
    """The query, with this library on the path of the session's Python workers."""
    root = str(Path(__file__).resolve().parent.parent)

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        known = env.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
