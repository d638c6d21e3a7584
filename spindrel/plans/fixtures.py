"""Inputs of the queries, derived from the driver's tables: as DataFrames, and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions.time import millis
from spindrel.operators import retrieval
from spindrel.operators.lifecycle import Thresholds
from spindrel.sources.storage import cut

#: Thresholds at which the tables show every transition.
NODE_THRESHOLDS = Thresholds(stem_usage=10, progenitor_usage=14, progenitor_connections=3, dying_entropy=0.9, dying_usage=12)
SIMILAR = 0.3


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dataset(table(spark, d, "embeddings"), "vec_id", "embedding")


#: What asks, and what is known beforehand: every vector whose id is divisible by 50, at any size;
#: all vectors are searched.
ASKS = "id % 50 = 0"


def requests(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where(ASKS).withColumnRenamed("id", "request_id")


def patterns(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where(ASKS).select(F.col("id").cast("int").alias("pattern_idx"), "vector")


def query(spark: SparkSession, d: str) -> list[float]:
    return vectors(spark, d).where("id = 0").first()["vector"]


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.all_pairs(vectors(spark, d), threshold=SIMILAR)


def knn(spark: SparkSession, d: str) -> DataFrame:
    """The graph of similar vectors, written once; entries are ranked by the other end."""
    both = cut(pairs(spark, d))
    entries = both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("score").alias("weight")).unionByName(both.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("score").alias("weight")))
    return entries.withColumn("adj_pos", F.col("dst"))


def k_of(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(F.lit("Stem"), F.lit("Progenitor"), F.lit("Specialized")), (F.col("user_id") % 3 + 1).cast("int"))
    e = table(spark, d, "events").withColumn("k", k_of())
    n = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("usage_count"), ((F.max("k") - F.min("k")) / 100.0).alias("entropy"), (F.countDistinct(F.to_date("ts")) % 8).cast("int").alias("connections"))
    return n.withColumn("state", state)


def latencies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.floor(F.col("value") * 1000).cast("bigint").alias("latency_us"))


def deposits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("src"), (k_of() % 10).cast("bigint").alias("dst"), (F.col("value") / 100).alias("amount"), millis("ts").alias("ms"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each hour: the mean and greatest value, share of errors, events a minute."""
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return e.groupBy("hour").agg(
        F.max("value").alias("latency_p95_ms"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"), (F.countDistinct("event_type") / 10.0).alias("pheromone_entropy"),
        (F.count(F.lit(1)) / 2.0).alias("anomaly_rate"), (F.count(F.lit(1)) / 25.0).alias("resource_utilization"), F.count(F.lit(1)).alias("n"),
    )


def antigens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), millis("ts").alias("first_seen_ms"), k_of().alias("k"))
    v = vectors(spark, d).withColumnRenamed("vector", "pattern")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Critical")]), (F.col("id") % 4 + 1).cast("int"))
    return v.join(e, "id").select("id", "pattern", F.col("k").cast("bigint").alias("encounter_count"), "first_seen_ms", (F.col("first_seen_ms") + 1000).alias("last_seen_ms"), severity.alias("severity"), F.lit("Active").alias("status"))


#: A moment in the middle of the events' month, for expiries.
NOW_MS = 1_705_276_800_000

# The same as SQL.  A CTE may use those before it.
CTE = {
    "emb": "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "prs": "prs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS score FROM emb a JOIN emb b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.3)",
    "knn": "knn AS (SELECT a AS src, b AS dst, score AS weight FROM prs UNION ALL SELECT b, a, score FROM prs)",
    "ev": "ev AS (SELECT *, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) AS k FROM events)",
    "nodes": "nodes AS (SELECT user_id, event_type, count(*) AS usage_count, (max(k) - min(k)) / CAST(100 AS DOUBLE) AS entropy, count(DISTINCT CAST(ts AS DATE)) % 8 AS connections, CASE user_id % 3 WHEN 0 THEN 'Stem' WHEN 1 THEN 'Progenitor' ELSE 'Specialized' END AS state FROM ev GROUP BY user_id, event_type)",
    "lat": "lat AS (SELECT CAST(floor(value * 1000) AS BIGINT) AS latency_us FROM events)",
    "dep": "dep AS (SELECT event_id AS seq, user_id % 50 AS src, CAST(k % 10 AS BIGINT) AS dst, value / 100 AS amount, (epoch_us(ts) // 1000) AS ms FROM ev)",
    "hourly": "hourly AS (SELECT date_trunc('hour', ts) AS hour, max(value) AS latency_p95_ms, avg(CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS error_rate, count(DISTINCT event_type) / CAST(10 AS DOUBLE) AS pheromone_entropy, count(*) / CAST(2 AS DOUBLE) AS anomaly_rate, count(*) / CAST(25 AS DOUBLE) AS resource_utilization, count(*) AS n FROM events GROUP BY 1)",
    "antig": "antig AS (SELECT e.id, e.v, CAST(x.k AS BIGINT) AS encounter_count, (epoch_us(x.ts) // 1000) AS first_seen_ms, (epoch_us(x.ts) // 1000) + 1000 AS last_seen_ms, CASE e.id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS severity FROM emb e JOIN ev x ON x.event_id = e.id)",
}
_NEEDS = {"prs": ["emb"], "knn": ["prs"], "nodes": ["ev"], "dep": ["ev"], "antig": ["emb", "ev"]}


def with_ctes(*names: str) -> str:
    """WITH and the CTEs named, and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(CTE[x] for x in order) + " "


def levels_of(spark: SparkSession, d: str) -> DataFrame:
    """Levels (src, dst, level) on every other similar pair."""
    return pairs(spark, d).where((F.col("a") + F.col("b")) % 2 == 0).select(F.col("b").alias("src"), F.col("a").alias("dst"), (1.0 + (F.col("a") % 7)).alias("level"))


def bipartite(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, level) of the distinct (part, supplier) pairs."""
    pairs_ = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return pairs_.withColumn("level", (F.pmod(F.col("src") * 31 + F.col("dst"), F.lit(97)) / 10.0 + 0.01))



