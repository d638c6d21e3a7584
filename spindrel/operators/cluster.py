"""Shards, the node that a request goes to, and counters as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 256
#: A node that is busier than this hands its requests on.
BUSY = 0.85


def request_hash(*columns: str) -> Column:
    """A request's identity for caches, shards and idempotency."""
    return F.xxhash64(*columns)


def shard(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(SHARDS)).cast("int")


def least_loaded(loads: DataFrame, *by: str) -> DataFrame:
    """(by, node): the node (node, load) of the least load, the smallest on ties."""
    return loads.groupBy(*by).agg(F.min(F.struct("load", "node")).alias("m")).select(*by, F.col("m.node").alias("node"))


def route(requests: DataFrame, loads: DataFrame, *by: str) -> DataFrame:
    """Requests (primary) with the node that takes each: the primary, or the least loaded other
    one of its group if the primary is busier than ``BUSY``."""
    order = Window.partitionBy(*by).orderBy("load", "node")
    ranked = loads.withColumns({"r": F.row_number().over(order), "next": F.lead("node").over(order)})
    best = ranked.where("r = 1").select(*by, F.col("node").alias("best"), F.col("next").alias("second"))
    own = loads.select(*by, F.col("node").alias("primary"), F.col("load").alias("own_load"))
    out = requests.join(own, [*by, "primary"], "left").join(best, list(by), "left")
    other = F.when(F.col("best") == F.col("primary"), F.col("second")).otherwise(F.col("best"))
    return out.withColumn("node", F.when(F.col("own_load") > BUSY, F.coalesce(other, "primary")).otherwise(F.col("primary"))).drop("own_load", "best", "second")


def metric_lines(counters: DataFrame) -> DataFrame:
    """(line): a row of counters as ``name value`` lines."""
    return counters.select(F.explode(F.array(*[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in counters.columns])).alias("line"))
