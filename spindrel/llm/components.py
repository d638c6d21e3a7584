"""Connected components of a link table, with DataFrame operations alone.

The graph is contracted round by round: every node moves to the least of itself and its
neighbours, and the links between the nodes moved to are the next round's.  In the first and in
odd rounds the order is that of the nodes, which ends stars in two and cliques in one; in the others
it is a hash of the round's own, so that paths in any numbering shrink by a share.  The greatest node of a component is
never moved to, so each round ends with fewer.  A round is two aggregations (with map-side
combining, so a hot node is summed before the shuffle) and two joins between written tables, which
adaptive execution can broadcast or split.  Nothing is collected but whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import written


def _moved(edges: DataFrame, k: int) -> DataFrame:
    """(node, to): the least of each node and its neighbours, in the order of round ``k``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if k == 0 or k % 2:
        return both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("m", "u").alias("to"))
    rank = lambda x: F.struct(F.xxhash64(F.lit(k), x).alias("h"), F.col(x).alias("x"))
    return both.groupBy("u").agg(F.min(rank("v")).alias("m")).select(F.col("u").alias("node"), F.least("m", rank("u"))["x"].alias("to"))


def _contracted(edges: DataFrame, moved: DataFrame) -> DataFrame:
    ends = edges.join(moved.toDF("u", "a"), "u").join(moved.toDF("v", "b"), "v")
    return ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component: its smallest node.

    Null ends and loops are no links.  No links give no rows.
    """
    ends = links.where(F.col(a) != F.col(b))
    edges = ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, rounds = written(edges, "links"), []
    while not edges.isEmpty():
        rounds.append(written(_moved(edges, len(rounds)), "moved"))
        edges = written(_contracted(edges, rounds[-1]), "contracted")
    if not rounds:
        return edges.toDF("node", "component")
    found = rounds[0]
    for moved in rounds[1:]:
        found = found.join(moved.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return written(found.join(least, "to").select("node", "component"), "components")
