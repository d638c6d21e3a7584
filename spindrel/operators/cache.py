"""What three levels of caches hold after a history of uses.

A history is a table (key, seq, ms) of insertions and reads; each level keeps ``capacity`` keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the keys that stay are ordered: the newest insertions, the greatest keys (the smallest one
#: is evicted), the most used (of equals the smallest key).
ORDERS = {"recent": ["inserted desc"], "keyed": ["key desc"], "frequent": ["uses desc", "key"]}


def uses(history: DataFrame) -> DataFrame:
    """(key, inserted, last_ms, uses): of each key the first seq, the last time, the number of uses."""
    return history.groupBy("key").agg(F.min("seq").alias("inserted"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("uses"))


def kept(used: DataFrame, order: str, capacity: int, *, now: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(key): what a level holds; with ``ttl_ms`` only keys used within that time before ``now``."""
    alive = used if ttl_ms is None else used.where(F.lit(now) - F.col("last_ms") < ttl_ms)
    return alive.orderBy(*[F.desc(c.removesuffix(" desc")) if c.endswith(" desc") else F.asc(c) for c in ORDERS[order]]).limit(capacity).select("key")
