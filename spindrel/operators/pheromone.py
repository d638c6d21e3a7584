"""Pheromone levels on edges: deposits, evaporation, routing, merging of replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAU_MIN, TAU_MAX, TAU_START, RHO = 0.01, 10.0, 1.0, 0.1


def clamp(c: Column, low: float = TAU_MIN, high: float = TAU_MAX) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def deposit(levels: DataFrame | None, deposits: DataFrame, *, low: float = TAU_MIN, high: float = TAU_MAX) -> DataFrame:
    """(src, dst, level, deposit_count, total_deposited) after deposits (seq, src, dst, amount).

    Clamping makes the order count, so each edge's amounts are folded by seq; the fold is one
    pass over an array per edge.  ``levels`` (src, dst, level) are what edges start from (1).
    """
    amounts = deposits.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "amount"))), lambda x: x["amount"]).alias("a"))
    if levels is not None:
        amounts = levels.select("src", "dst", F.col("level").alias("start")).join(amounts, ["src", "dst"], "full_outer").withColumns({"a": F.coalesce("a", F.array().cast("array<double>")), "start": F.coalesce("start", F.lit(TAU_START))})
    else:
        amounts = amounts.withColumn("start", F.lit(TAU_START))
    level = F.aggregate("a", F.col("start"), lambda s, x: clamp(s + x, low, high))
    return amounts.select("src", "dst", level.alias("level"), F.size("a").cast("bigint").alias("deposit_count"), F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total_deposited"))


def evaporated(level: Column, rho: float = RHO, cycles: int = 1, low: float = TAU_MIN) -> Column:
    """The level after so many cycles, in one step."""
    if not 0 < rho < 1:
        raise ValueError("rho must be between 0 and 1")
    return F.greatest(F.lit(low), level * (1 - rho) ** cycles)


def evaporation_metrics(levels: DataFrame, rho: float = RHO, low: float = TAU_MIN) -> DataFrame:
    """One row: edges_processed, total_decay, edges_at_tau_min, after one cycle."""
    after = evaporated(F.col("level"), rho, 1, low)
    return levels.agg(F.count(F.lit(1)).alias("edges_processed"), F.coalesce(F.sum(F.col("level") - after), F.lit(0.0)).alias("total_decay"), F.count_if(F.abs(after - low) < 1e-10).alias("edges_at_tau_min"))


def route(candidates: DataFrame, *, alpha: float = 1.0, beta: float = 2.0) -> DataFrame:
    """(src, dst): the choice of each source among candidates (src, dst, weight, level, pos, r),
    by a roulette on the supplied uniform r; none where all scores are zero."""
    eta = F.when(F.col("weight") > 0, 1 / F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)).otherwise(1.0)
    scored = candidates.withColumn("s", F.pow("level", F.lit(alpha)) * F.pow(eta, F.lit(beta)))
    of = Window.partitionBy("src")
    run = of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spun = scored.withColumns({"upto": F.sum("s").over(run), "total": F.sum("s").over(of)})
    return spun.where((F.col("total") > 0) & (F.col("upto") >= F.col("r") * F.col("total"))).groupBy("src").agg(F.min_by("dst", "pos").alias("dst"))


def lww_merge(*replicas: DataFrame) -> DataFrame:
    """(src, dst, value, ts, node_id): of each edge the write with the latest time, then the
    greatest node.  The maximum is associative, so tasks merge before the shuffle."""
    every = replicas[0]
    for r in replicas[1:]:
        every = every.unionByName(r)
    return every.groupBy("src", "dst").agg(F.max(F.struct("ts", "node_id", "value")).alias("m")).select("src", "dst", "m.value", "m.ts", "m.node_id")


def path_pairs(paths: DataFrame) -> DataFrame:
    """(path_id, pos, src, dst): the steps of paths (path_id, path)."""
    return paths.select("path_id", F.posexplode("path").alias("pos", "src"), "path").withColumn("dst", F.get("path", F.col("pos") + 1)).where("dst is not null").drop("path")


def reinforce(edges: DataFrame, pairs: DataFrame, *, amount: float = 0.5, cap: float = 10.0) -> DataFrame:
    """Edges (src, dst, pheromone) raised by each step that used them, up to the cap."""
    used = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("uses"))
    return edges.join(used, ["src", "dst"], "left").withColumn("pheromone", F.when(F.col("uses").isNull(), F.col("pheromone")).otherwise(F.least(F.col("pheromone") + amount * F.col("uses"), F.lit(cap)))).drop("uses")
