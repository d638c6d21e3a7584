"""A small Python surface over the operators, for use from a service or a notebook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions import vector as V
from spindrel.operators import action, graph, histogram, immune, lifecycle, pheromone, retrieval
from spindrel.plans import pipeline


def _frame(spark: SparkSession, vectors: list[list[float]], ids: list[int] | None = None) -> DataFrame:
    rows = list(zip(ids or range(len(vectors)), [[float(x) for x in v] for v in vectors]))
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


def cosine_similarity(spark: SparkSession, a: list[float], b: list[float]) -> float:
    """Raises where sizes differ or an element is not finite."""
    given = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    found = given.select(V.cosine(F.col("a"), F.col("b"))).first()[0]
    if found is None:
        raise ValueError("vectors differ in size or are not finite")
    return found


def retrieve(spark: SparkSession, query: list[float], vectors: list[list[float]], top_k: int, *, threshold: float = 0.1) -> list[tuple[int, float]]:
    return [(r["id"], r["score"]) for r in retrieval.top_k(_frame(spark, vectors), [float(x) for x in query], top_k, threshold=threshold).collect()]


def classify(spark: SparkSession, vector: list[float], own: list[list[float]], *, threshold: float = 0.1, min_patterns: int = 1) -> tuple[str, float]:
    patterns = _frame(spark, own).select(F.col("id").cast("int").alias("pattern_idx"), "vector")
    found = immune.classify(_frame(spark, [vector]), patterns, radius=threshold, min_patterns=min_patterns).first()
    return found["label"], found["confidence"]


def latency_percentiles(spark: SparkSession, samples_us: list[int]) -> dict[str, int]:
    rows = spark.createDataFrame([(int(x),) for x in samples_us], "latency_us bigint")
    return {f"p{r['p'] / 10:g}": r["value_us"] for r in histogram.percentiles(histogram.histogram(rows)).collect()}


class Engine:
    """Tables of vectors, edges and levels, and the batch query over them.

    Tables are DataFrames and so are all results; nothing runs before a result is used.
    """

    def __init__(self, vectors: DataFrame, edges: DataFrame, levels: DataFrame | None = None):
        self.vectors, self.edges, self.levels = vectors, edges, levels

    def query(self, requests: DataFrame, *, top_k: int = 5, threshold: float = 0.1, tenant: str | None = None) -> DataFrame:
        """The composite pipeline; ``tenant`` restricts the vectors if they have tenant_id."""
        data = self.vectors.where(F.col("tenant_id") == tenant) if tenant is not None else self.vectors
        return pipeline.run(data, requests, self.edges, k=top_k, threshold=threshold)

    def expand(self, seeds: DataFrame, depth: int = 2, max_nodes: int | None = None) -> DataFrame:
        return graph.expand_capped(self.edges, seeds, depth, max_nodes)

    def deposit(self, deposits: DataFrame) -> Engine:
        """The engine with levels after valid deposits (finite and above zero)."""
        good = deposits.where((F.col("amount") > 0) & ~F.isnan("amount") & (F.col("amount") < float("inf")))
        return Engine(self.vectors, self.edges, pheromone.deposit(self.levels, good))

    def graph_view(self) -> DataFrame:
        levels = self.levels if self.levels is not None else self.edges.select("src", "dst", F.lit(1.0).alias("level"))
        return graph.pheromone_view(self.edges, levels)

    def encode(self, nodes: DataFrame, key: str = "request_id") -> DataFrame:
        return action.pack(nodes, key)

    def evolve(self, nodes: DataFrame, thresholds: lifecycle.Thresholds = lifecycle.Thresholds()) -> DataFrame:
        return lifecycle.process(nodes, thresholds)
