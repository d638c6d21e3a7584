"""The queries of the engine's operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions import vector as V
from spindrel.functions.time import millis
from spindrel.operators import action, cache, cluster, colony, graph, histogram, immune, lifecycle, memory_kernel, pheromone, regulation, retrieval
from spindrel.plans import fixtures as X
from spindrel.plans import pipeline
from spindrel.plans.fixtures import with_ctes
from spindrel.sources import storage
from spindrel.streaming import batch as stream_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6)
    return out.alias(name) if name else out


# --- retrieval -----------------------------------------------------------------------------

@query(with_ctes("emb") + "SELECT b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM emb a, emb b WHERE a.id = 0 AND list_cosine_similarity(a.v, b.v) >= 0.1 ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id LIMIT 10")
def vec_topk(spark, d):
    return retrieval.top_k(X.vectors(spark, d), X.query(spark, d), 10).select("id", r6("score", "score"))


_SCORED = "SELECT a.id AS request_id, b.id AS id, list_cosine_similarity(a.v, b.v) AS s FROM emb a, emb b WHERE a.id % 50 = 0 AND list_cosine_similarity(a.v, b.v) >= 0.1"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, id) AS rank FROM ({_SCORED})"


@query(with_ctes("emb") + f"SELECT request_id, CAST(rank AS INTEGER) AS rank, id, round(s, 6) AS score FROM ({_RANKED}) WHERE rank <= 10")
def vec_topk_batch(spark, d):
    return retrieval.batch_top_k(X.vectors(spark, d), X.requests(spark, d), 10).select("request_id", "rank", "id", r6("score", "score"))


@query(with_ctes("emb") + "SELECT b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM emb a, emb b WHERE a.id = 0 AND list_cosine_similarity(a.v, b.v) >= 0.1")
def vec_threshold_scan(spark, d):
    return retrieval.score(X.vectors(spark, d), X.query(spark, d)).select("id", r6("score", "score"))


@query(with_ctes("prs") + "SELECT a, b, round(score, 6) AS score FROM prs")
def vec_similar_pairs(spark, d):
    return X.pairs(spark, d).select("a", "b", r6("score", "score"))


@query(with_ctes("emb") + "SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1 FROM emb")
def vec_norms(spark, d):
    return X.vectors(spark, d).select("id", r6(V.norm(F.col("vector")), "norm"), r6(V.l1(F.col("vector")), "l1"))


@query(with_ctes("emb") + "SELECT id, round(v[1] * 3 / sqrt(list_sum(list_transform(v, lambda x: 9 * x * x))), 6) AS x0, round(v[64] * 3 / sqrt(list_sum(list_transform(v, lambda x: 9 * x * x))), 6) AS x63 FROM emb")
def vec_normalize(spark, d):
    unit = X.vectors(spark, d).select("id", V.normalize(F.transform("vector", lambda x: 3 * x)).alias("u"))
    return unit.select("id", r6(F.col("u")[0], "x0"), r6(F.col("u")[63], "x63"))


@query(with_ctes("emb") + "SELECT a.id AS a, b.id AS b, round(list_distance(a.v, b.v), 6) AS distance FROM emb a JOIN emb b ON a.id % 50 = 0")
def vec_l2_pairs(spark, d):
    far = retrieval.batch_distances(X.vectors(spark, d), X.requests(spark, d))
    return far.select(F.col("request_id").alias("a"), F.col("id").alias("b"), r6("distance", "distance"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))), 6) AS l1 FROM embeddings")
def vec_l1(spark, d):
    return X.vectors(spark, d).select("id", r6(V.l1(F.col("vector")), "l1"))


@query(with_ctes("emb") + "SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'empty query vector' WHEN vec_id % 4 = 1 THEN 'top_k must be positive' WHEN vec_id % 4 = 2 THEN 'query vector is not finite' END AS error FROM embeddings")
def query_validation(spark, d):
    kind = F.col("id") % 4
    given = X.vectors(spark, d).select("id", F.when(kind == 0, F.array().cast("array<double>")).when(kind == 2, F.transform("vector", lambda x: F.lit(float("nan")))).otherwise(F.col("vector")).alias("vector"), F.when(kind == 1, 0).otherwise(10).alias("top_k"))
    return given.select("id", retrieval.refusal(F.col("vector"), F.col("top_k")).alias("error"))


@query("SELECT vec_id AS request_id, CASE WHEN vec_id % 100 = 0 THEN 'empty query vector' ELSE 'query vector is not finite' END AS error FROM embeddings WHERE vec_id % 50 = 0 AND (vec_id % 100 = 0 OR vec_id % 150 <> 50)")
def query_refusals(spark, d):
    """Of the batch every second request is empty, and but for some the others hold a NaN."""
    of = F.col("request_id")
    bad = F.when(of % 100 == 0, F.array().cast("array<double>")).when(of % 150 == 50, F.col("vector")).otherwise(F.transform("vector", lambda x: F.lit(float("nan"))))
    return retrieval.refused(X.requests(spark, d).withColumn("vector", bad), 10)


@query(with_ctes("emb") + f"SELECT request_id, count(*) AS hits, CASE WHEN bool_or(s < 0.3) THEN 'alert' WHEN bool_or(s > 0.8) THEN 'risk_eval' ELSE 'classify' END AS intent, CAST(least(greatest(round(avg(s) * 10), 1), 10) AS INTEGER) AS priority FROM ({_RANKED}) WHERE rank <= 10 GROUP BY request_id")
def query_intent(spark, d):
    top = retrieval.batch_top_k(X.vectors(spark, d), X.requests(spark, d), 10)
    return top.groupBy("request_id").agg(F.count(F.lit(1)).alias("hits"), action.intent().alias("intent"), action.priority(F.avg("score")).alias("priority"))


_CACHE = "SELECT b.id, a.id AS cached, list_cosine_similarity(a.v, b.v) AS s FROM emb a JOIN emb b ON a.id % 50 = 0 AND b.id % 50 <> 0 WHERE list_cosine_similarity(a.v, b.v) >= 0.3"


@query(with_ctes("emb") + f"SELECT id, cached, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cached) AS n FROM ({_CACHE})) WHERE n = 1")
def cache_similar_lookup(spark, d):
    hits = retrieval.batch_scores(X.vectors(spark, d).where("id % 50 <> 0"), X.requests(spark, d), threshold=0.3)
    best = hits.groupBy("id").agg(F.max(F.struct("score", (-F.col("request_id")).alias("c"))).alias("m"))
    return best.select("id", (-F.col("m.c")).alias("cached"), r6("m.score", "similarity"))


@query(with_ctes("emb") + f"SELECT count(*) AS lookups, count(h.id) AS hits, round(count(h.id) / CAST(count(*) AS DOUBLE), 6) AS hit_rate FROM emb e LEFT JOIN (SELECT DISTINCT id FROM ({_CACHE})) h ON h.id = e.id WHERE e.id % 50 <> 0")
def cache_hit_rate(spark, d):
    asked = X.vectors(spark, d).where("id % 50 <> 0")
    hits = retrieval.batch_scores(asked, X.requests(spark, d), threshold=0.3).select("id", F.lit(1).alias("hit")).distinct()
    both = asked.select("id").join(hits, "id", "left")
    return both.agg(F.count(F.lit(1)).alias("lookups"), F.count("hit").alias("hits"), r6(regulation.rate(F.count("hit"), F.count(F.lit(1))), "hit_rate"))


# --- latency -------------------------------------------------------------------------------

_HIST = "SELECT CAST(least(floor(latency_us / CAST(10 AS DOUBLE)), 9999) AS BIGINT) AS bucket, count(*) AS n FROM lat GROUP BY 1"


@query(with_ctes("lat") + _HIST)
def latency_hist(spark, d):
    return histogram.histogram(X.latencies(spark, d))


@query(with_ctes("lat") + f", h AS ({_HIST}), c AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS upto FROM h), t AS (SELECT p, CAST(floor((SELECT count(*) FROM lat) * p / CAST(1000 AS DOUBLE)) AS BIGINT) AS target FROM (VALUES (500), (950), (990), (999)) AS v(p)), m AS (SELECT p, target, min(bucket) AS bucket FROM t JOIN c ON c.upto >= t.target GROUP BY p, target) SELECT CAST(m.p AS INTEGER) AS p, CAST(m.bucket * 10 + floor((m.target - c.upto + c.n) / CAST(c.n AS DOUBLE) * 10) AS BIGINT) AS value_us FROM m JOIN c ON c.bucket = m.bucket")
def latency_percentiles(spark, d):
    return histogram.percentiles(histogram.histogram(X.latencies(spark, d)))


@query(with_ctes("lat") + "SELECT count(*) AS n, CAST(sum(latency_us) AS BIGINT) AS sum_us, min(latency_us) AS min_us, max(latency_us) AS max_us, round(avg(latency_us), 6) AS mean_us FROM lat")
def latency_summary(spark, d):
    return histogram.summary(X.latencies(spark, d)).withColumn("mean_us", r6("mean_us"))


# --- lifecycle -----------------------------------------------------------------------------

_NEXT = "CASE state WHEN 'Stem' THEN CASE WHEN usage_count >= 10 THEN 'Progenitor' ELSE 'Stem' END WHEN 'Progenitor' THEN CASE WHEN usage_count >= 14 AND entropy < 0.9 AND connections >= 3 THEN 'Specialized' WHEN entropy >= 0.9 AND usage_count <= 12 THEN 'Apoptosis' ELSE 'Progenitor' END ELSE CASE WHEN entropy >= 0.9 AND usage_count <= 12 THEN 'Apoptosis' ELSE 'Specialized' END END"
_MATURE = "least(greatest(CAST(0.3 AS DOUBLE) * CASE {s} WHEN 'Stem' THEN CAST(0.1 AS DOUBLE) WHEN 'Progenitor' THEN CAST(0.4 AS DOUBLE) WHEN 'Specialized' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(0.3 AS DOUBLE) * least(usage_count / CAST(20 AS DOUBLE), CAST(1 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * (1 - entropy) + CAST(0.2 AS DOUBLE) * least(connections / CAST(10 AS DOUBLE), CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


@query(with_ctes("nodes") + f"SELECT user_id, event_type, state AS from_state, {_NEXT} AS state FROM nodes")
def node_lifecycle(spark, d):
    return lifecycle.process(X.nodes(spark, d), X.NODE_THRESHOLDS).select("user_id", "event_type", "from_state", "state")


@query(with_ctes("nodes") + f"SELECT user_id, event_type, round({_MATURE.format(s='to_state')}, 6) AS maturity FROM (SELECT *, {_NEXT} AS to_state FROM nodes)")
def node_maturity(spark, d):
    return lifecycle.process(X.nodes(spark, d), X.NODE_THRESHOLDS).select("user_id", "event_type", r6("maturity", "maturity"))


@query(with_ctes("nodes") + f"SELECT user_id, event_type, round(least(greatest({_MATURE.format(s='state')} + entropy - CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)), 6) AS maturity FROM nodes")
def node_feedback(spark, d):
    n = X.nodes(spark, d).withColumns({"maturity": lifecycle.maturity(), "delta": F.col("entropy") - 0.5})
    return n.select("user_id", "event_type", r6(lifecycle.feedback("maturity", "delta"), "maturity"))


@query(with_ctes("ev") + ", first AS (SELECT user_id AS id, count(*) AS usage_count FROM ev WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1), incoming AS (SELECT user_id AS id, count(*) AS usage_count, max(k) / CAST(100 AS DOUBLE) AS entropy FROM ev WHERE event_type = 'click' AND user_id % 3 <> 1 GROUP BY 1) SELECT coalesce(f.id, i.id) AS id, CASE WHEN i.id IS NULL THEN f.usage_count WHEN f.id IS NULL THEN i.usage_count ELSE f.usage_count + 1 END AS usage_count, CASE WHEN i.id IS NULL THEN CAST(0.5 AS DOUBLE) ELSE i.entropy END AS entropy, CASE WHEN i.id IS NULL THEN 'Stem' ELSE 'Progenitor' END AS state FROM first f FULL JOIN incoming i ON f.id = i.id")
def node_upsert(spark, d):
    e = X.table(spark, d, "events").withColumn("k", X.k_of())
    rest = lambda state: [F.lit(state).alias("state"), F.lit(0).alias("connections"), F.lit(0.0).alias("maturity")]
    known = e.where("event_type = 'view' and user_id % 3 <> 0").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("usage_count")).select("id", "usage_count", F.lit(0.5).alias("entropy"), *rest("Stem"))
    new = e.where("event_type = 'click' and user_id % 3 <> 1").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("usage_count"), (F.max("k") / 100.0).alias("entropy")).select("id", "usage_count", "entropy", *rest("Progenitor"))
    return lifecycle.upsert(known, new).select("id", "usage_count", "entropy", "state")


@query(with_ctes("nodes") + f"SELECT state AS from_state, {_NEXT} AS state, count(*) AS n FROM nodes GROUP BY 1, 2")
def lifecycle_counts(spark, d):
    return lifecycle.process(X.nodes(spark, d), X.NODE_THRESHOLDS).groupBy("from_state", "state").agg(F.count(F.lit(1)).alias("n"))


# --- graph ---------------------------------------------------------------------------------

@query(with_ctes("knn") + "SELECT src, dst, round(weight, 6) AS weight FROM knn WHERE src < dst")
def graph_edges(spark, d):
    return graph.edge_list(X.knn(spark, d)).withColumn("weight", r6("weight"))


@query("SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def graph_build(spark, d):
    li = X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.edge_list(graph.build(li))


@query(with_ctes("knn") + "SELECT dst, round(weight, 6) AS weight FROM knn WHERE src = 7")
def graph_neighbors(spark, d):
    return graph.neighbors(X.knn(spark, d), 7).select("dst", r6("weight", "weight"))


@query(with_ctes("knn") + "SELECT degree, count(*) AS nodes, CAST(sum(degree) AS BIGINT) AS entries FROM (SELECT src, count(*) AS degree FROM knn GROUP BY src) GROUP BY degree")
def graph_degree_counts(spark, d):
    return graph.degrees(X.knn(spark, d)).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("entries"))


@query(with_ctes("knn") + "SELECT count(DISTINCT src) AS node_count, count(*) AS edge_count FROM knn")
def graph_counts(spark, d):
    return graph.counts(X.knn(spark, d))


@query(with_ctes("knn") + "SELECT src, dst, round(weight, 6) AS weight FROM knn WHERE src % 10 <> 3 AND dst % 10 <> 3")
def graph_remove_node(spark, d):
    gone = X.vectors(spark, d).where("id % 10 = 3").select(F.col("id").alias("node"))
    return graph.remove_nodes(X.knn(spark, d), gone).select("src", "dst", r6("weight", "weight"))


@query(with_ctes("prs") + "SELECT a, b FROM prs WHERE a % 2 = 0 AND b % 2 = 0")
def graph_registered_pairs(spark, d):
    return graph.registered(X.pairs(spark, d).select("a", "b"), X.vectors(spark, d).where("id % 2 = 0").select("id"))


@query(with_ctes("knn") + ", l1 AS (SELECT DISTINCT dst AS node FROM knn WHERE src IN (7, 11) AND dst NOT IN (7, 11)), l2 AS (SELECT DISTINCT dst AS node FROM knn WHERE src IN (SELECT node FROM l1) AND dst NOT IN (7, 11) AND dst NOT IN (SELECT node FROM l1)) SELECT node, CAST(0 AS INTEGER) AS depth FROM (VALUES (CAST(7 AS BIGINT)), (11)) AS s(node) UNION ALL SELECT node, CAST(1 AS INTEGER) FROM l1 UNION ALL SELECT node, CAST(2 AS INTEGER) FROM l2")
def graph_bfs_uncapped(spark, d):
    return graph.expand(X.knn(spark, d), spark.createDataFrame([(7,), (11,)], "node bigint"), 2)


_MET = "min(struct_pack(fv := v.visit, ap := k.dst, src := v.{node}, w := k.weight)) AS m"
_NEXT_VISIT = "row_number() OVER (PARTITION BY request_id ORDER BY m.fv, m.ap) AS visit"
_CAPPED = f"""
, s AS (SELECT id AS request_id, unnest([id, id + 40, id + 80]) AS node FROM emb WHERE id % 50 = 0),
v0 AS (SELECT request_id, node, row_number() OVER (PARTITION BY request_id ORDER BY node) AS visit FROM s),
m1 AS (SELECT v.request_id, k.dst, {_MET.format(node='node')} FROM v0 v JOIN knn k ON k.src = v.node WHERE NOT EXISTS (SELECT 1 FROM v0 x WHERE x.request_id = v.request_id AND x.node = k.dst) GROUP BY 1, 2),
v1 AS (SELECT * FROM (SELECT *, 3 + {_NEXT_VISIT} FROM m1) WHERE visit <= 6),
a1 AS (SELECT request_id, node FROM v0 UNION ALL SELECT request_id, dst FROM v1),
n1 AS (SELECT request_id, count(*) AS size FROM a1 GROUP BY 1),
m2 AS (SELECT v.request_id, k.dst, n1.size, {_MET.format(node='dst')} FROM v1 v JOIN n1 USING (request_id) JOIN knn k ON k.src = v.dst WHERE n1.size < 6 AND NOT EXISTS (SELECT 1 FROM a1 x WHERE x.request_id = v.request_id AND x.node = k.dst) GROUP BY 1, 2, 3),
v2 AS (SELECT * FROM (SELECT *, size + {_NEXT_VISIT} FROM m2) WHERE visit <= 6)
SELECT request_id, node, CAST(0 AS INTEGER) AS depth, visit, CAST(NULL AS BIGINT) AS from_node, CAST(NULL AS DOUBLE) AS weight FROM v0
UNION ALL SELECT request_id, dst, 1, visit, m.src, round(m.w, 6) FROM v1 UNION ALL SELECT request_id, dst, 2, visit, m.src, round(m.w, 6) FROM v2
"""


@query(with_ctes("knn") + _CAPPED)
def graph_bfs_capped(spark, d):
    seeds = X.requests(spark, d).select("request_id", F.explode(F.array("request_id", F.col("request_id") + 40, F.col("request_id") + 80)).alias("node")).withColumn("pos", F.col("node"))
    return graph.expand_capped(X.knn(spark, d), seeds, 2).withColumn("weight", r6("weight"))


@query(with_ctes("prs") + ", lv AS (SELECT a, b, CAST(1 + (a % 7) AS DOUBLE) AS level FROM prs WHERE (a + b) % 2 = 0) SELECT p.a AS src, p.b AS dst, round(p.score, 6) AS weight, CAST(p.a AS VARCHAR) || '_' || CAST(p.b AS VARCHAR) AS key, coalesce(lv.level, CAST(1 AS DOUBLE)) AS level, coalesce(lv.level, CAST(1 AS DOUBLE)) >= 3 AS highway FROM prs p LEFT JOIN lv ON lv.a = p.a AND lv.b = p.b")
def graph_pheromone_view(spark, d):
    return graph.pheromone_view(X.knn(spark, d), X.levels_of(spark, d)).withColumn("weight", r6("weight"))


# --- immune --------------------------------------------------------------------------------

_DIST = "near AS (SELECT b.id AS id, min(list_distance(a.v, b.v)) AS d, arg_min(a.id, list_distance(a.v, b.v)) AS p FROM emb a JOIN emb b ON a.id % 50 = 0 GROUP BY b.id), w AS (SELECT *, greatest(CAST(1 AS DOUBLE), max(d) OVER u) AS seen, row_number() OVER (ORDER BY id) AS call, avg(d) OVER l AS m, stddev_pop(d) OVER l AS sd, count(*) OVER l AS c FROM near WINDOW u AS (ORDER BY id ROWS UNBOUNDED PRECEDING), l AS (ORDER BY id ROWS 99 PRECEDING)), f AS (SELECT *, d / seen > 0.9 AS anomaly FROM w), g AS (SELECT *, sum(CASE WHEN call >= 50 AND anomaly AND c >= 2 AND d <= m + sd THEN 1 ELSE 0 END) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS fp, sum(CASE WHEN call >= 50 THEN 1 ELSE 0 END) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS wn FROM f)"


def _detected(spark, d):
    calls = X.vectors(spark, d).withColumn("seq", F.col("id"))
    return immune.detect(calls, X.patterns(spark, d), threshold=0.9, window=100, warmup=50)


@query(with_ctes("emb") + f", {_DIST} SELECT id, CAST(p AS INTEGER) AS closest_pattern_idx, round(d, 6) AS min_distance, round(least(d / seen, 1), 6) AS score, anomaly AS is_anomaly FROM g")
def detect_anomalies(spark, d):
    return _detected(spark, d).select("id", "closest_pattern_idx", r6("min_distance", "min_distance"), r6("score", "score"), "is_anomaly")


@query(with_ctes("emb") + f", {_DIST} SELECT id, round(m, 6) AS baseline_mean, round(sd, 6) AS baseline_std FROM g")
def detect_baseline(spark, d):
    return _detected(spark, d).select("id", r6("baseline_mean", "baseline_mean"), r6("baseline_std", "baseline_std"))


@query(with_ctes("emb") + f", {_DIST} SELECT id, round(CASE WHEN wn > 0 THEN fp / CAST(wn AS DOUBLE) ELSE 0 END, 6) AS fpr FROM g")
def detect_fpr(spark, d):
    return _detected(spark, d).select("id", r6("fpr", "fpr"))


@query(with_ctes("emb") + f", {_DIST} SELECT id, id % 7 AS caller, CAST(p AS INTEGER) AS closest_pattern_idx, round(d, 6) AS min_distance, round(least(d / seen, 1), 6) AS score FROM g")
def detect_repeated_ids(spark, d):
    """Seven callers, each with many calls: a call is judged by its own vector."""
    calls = X.vectors(spark, d).select((F.col("id") % 7).alias("id"), F.col("id").alias("seq"), "vector")
    out = immune.detect(calls, X.patterns(spark, d), threshold=0.9, window=100, warmup=50)
    return out.select(F.col("seq").alias("id"), F.col("id").alias("caller"), "closest_pattern_idx", r6("min_distance", "min_distance"), r6("score", "score"))


@query("SELECT vec_id AS id, CAST(-1 AS INTEGER) AS closest_pattern_idx, CAST(1 AS DOUBLE) AS score, true AS is_anomaly, CAST(0 AS DOUBLE) AS fpr FROM embeddings")
def detect_without_patterns(spark, d):
    out = immune.detect(X.vectors(spark, d).withColumn("seq", F.col("id")), X.patterns(spark, d).where("false"))
    return out.select("id", "closest_pattern_idx", "score", "is_anomaly", "fpr")


@query(with_ctes("emb") + ", n AS (SELECT b.id, min(list_distance(a.v, b.v)) AS d FROM emb a JOIN emb b ON a.id % 50 = 0 GROUP BY b.id) SELECT id, CASE WHEN d <= 1.2 THEN 'Self' ELSE 'NonSelf' END AS label, round(CASE WHEN d <= 1.2 THEN 1 - d / CAST(1.2 AS DOUBLE) ELSE (d - CAST(1.2 AS DOUBLE)) / (1 + d - CAST(1.2 AS DOUBLE)) END, 6) AS confidence FROM n")
def classify_self(spark, d):
    return immune.classify(X.vectors(spark, d), X.patterns(spark, d), radius=1.2, min_patterns=1).withColumn("confidence", r6("confidence"))


_MATCH = f"SELECT e.id, a.id AS antigen_id, list_distance(a.v, e.v) AS s FROM emb e JOIN antig a ON NOT (greatest({X.NOW_MS} - a.first_seen_ms, 0) > 10 * CAST(86400000 AS BIGINT)) AND list_distance(a.v, e.v) < 1.15"


@query(with_ctes("antig") + f", m AS (SELECT id, min(s) AS distance, arg_min(antigen_id, s) AS antigen_id FROM ({_MATCH}) GROUP BY id) SELECT e.id, CAST(m.antigen_id AS BIGINT) AS antigen_id, round(m.distance, 6) AS distance FROM emb e LEFT JOIN m ON m.id = e.id")
def antigen_match(spark, d):
    return immune.match_antigens(X.vectors(spark, d), X.antigens(spark, d), threshold=1.15, now=X.NOW_MS, days=10).select("id", "antigen_id", r6("distance", "distance"))


@query(with_ctes("antig") + f"SELECT id, CASE WHEN greatest({X.NOW_MS} - first_seen_ms, 0) > 10 * CAST(86400000 AS BIGINT) THEN 'Expired' ELSE 'Active' END AS status FROM antig")
def antigen_expire(spark, d):
    return X.antigens(spark, d).select("id", F.when(immune.expired(F.col("first_seen_ms"), X.NOW_MS, 10), "Expired").otherwise(F.col("status")).alias("status"))


@query(with_ctes("antig") + "SELECT id, encounter_count FROM antig ORDER BY encounter_count DESC, id DESC LIMIT 30")
def antigen_evict(spark, d):
    return immune.evict(X.antigens(spark, d), 30).select("id", "encounter_count")


@query(with_ctes("antig") + ", met AS (SELECT user_id AS id, count(*) AS times, max((epoch_us(ts) // 1000)) AS ms FROM events GROUP BY 1) SELECT a.id, CAST(a.encounter_count + coalesce(m.times, 0) AS BIGINT) AS encounter_count, greatest(a.last_seen_ms, coalesce(m.ms, a.last_seen_ms)) AS last_seen_ms FROM antig a LEFT JOIN met m ON m.id = a.id")
def antigen_encounters(spark, d):
    met = X.table(spark, d, "events").select(F.col("user_id").alias("id"), millis("ts").alias("ms"))
    return immune.record_encounters(X.antigens(spark, d), met).select("id", "encounter_count", "last_seen_ms")


@query(with_ctes("antig") + "SELECT id, CASE WHEN id % 3 = 0 THEN 'Loaded' ELSE severity END AS severity FROM antig")
def antigen_merge(spark, d):
    a = X.antigens(spark, d)
    return immune.load_antigens(a.where("id % 3 <> 0"), a.where("id % 3 <> 1").withColumn("severity", F.lit("Loaded"))).select("id", "severity")


@query(with_ctes("antig") + "SELECT id AS antigen_id, severity, first_seen_ms, last_seen_ms, encounter_count, 'ACTIVE' AS status FROM antig")
def antigen_csv_rows(spark, d):
    return immune.csv_rows(X.antigens(spark, d))


_SEVERITY = "CASE k % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END"


def _triggers(spark, d):
    severity = F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Critical")]), (X.k_of() % 4 + 1).cast("int"))
    return X.table(spark, d, "events").select(F.col("user_id").alias("context"), F.floor(millis("ts") / 3_600_000).cast("bigint").alias("cycle"), F.col("event_id").alias("seq"), severity.alias("severity"))


@query(with_ctes("ev") + f"SELECT user_id AS context, event_id AS seq, {_SEVERITY} AS severity, CAST(CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 10 END AS INTEGER) AS boost FROM ev")
def severity_boost(spark, d):
    return _triggers(spark, d).select("context", "seq", "severity", immune.boost(F.col("severity")).alias("boost"))


@query(with_ctes("ev") + ", t AS (SELECT user_id AS context, event_id AS seq, CAST(floor((epoch_us(ts) // 1000) / CAST(3600000 AS DOUBLE)) AS BIGINT) AS cycle, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 10 END AS boost FROM ev), l AS (SELECT context, list(struct_pack(c := cycle, b := boost) ORDER BY cycle, seq) AS es FROM t GROUP BY context) SELECT context, CAST(list_reduce(list_prepend(struct_pack(c := es[1].c, b := 0), es), lambda s, e: struct_pack(c := e.c, b := CAST(least(greatest(s.b - (e.c - s.c), 0) + e.b, 10) AS INTEGER))).b AS INTEGER) AS level FROM l")
def amplifier_levels(spark, d):
    return immune.amplify(_triggers(spark, d))


@query()
def nsa_detectors(spark, d):
    return immune.generate_detectors(X.patterns(spark, d), 10, 64, radius=4.0).select("pattern_idx", r6(V.norm(F.col("vector")), "norm"))


@query()
def mutate_explore(spark, d):
    v = X.vectors(spark, d)
    return immune.explored(immune.mutations(v), v.select("id", V.l1(F.col("vector")).alias("score"))).withColumn("selected_score", r6("selected_score"))


@query()
def mutate_best(spark, d):
    return immune.best_mutation(immune.mutations(X.vectors(spark, d))).withColumn("best_score", r6("best_score"))


# --- pheromone -----------------------------------------------------------------------------

@query(with_ctes("dep") + ", g AS (SELECT src, dst, list(amount ORDER BY seq) AS a FROM dep GROUP BY src, dst) SELECT src, dst, round(list_reduce(list_prepend(CAST(1 AS DOUBLE), a), lambda s, x: greatest(least(s + x, CAST(10 AS DOUBLE)), CAST(0.01 AS DOUBLE))), 6) AS level, CAST(len(a) AS BIGINT) AS deposit_count, round(list_sum(a), 6) AS total_deposited FROM g")
def pheromone_deposit(spark, d):
    return pheromone.deposit(None, X.deposits(spark, d)).select("src", "dst", r6("level", "level"), "deposit_count", r6("total_deposited", "total_deposited"))


_LEVELS = "lv AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, ((l_partkey * 31 + l_suppkey) % 97) / CAST(10 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS level FROM lineitem)"


@query(f"WITH {_LEVELS} SELECT src, dst, round(greatest(CAST(0.01 AS DOUBLE), level * power(CAST(0.9 AS DOUBLE), 7)), 6) AS level FROM lv")
def pheromone_evaporate_n(spark, d):
    return X.bipartite(spark, d).select("src", "dst", r6(pheromone.evaporated(F.col("level"), 0.1, 7), "level"))


@query(f"WITH {_LEVELS} SELECT count(*) AS edges_processed, round(sum(level - greatest(CAST(0.01 AS DOUBLE), level * CAST(0.9 AS DOUBLE))), 4) AS total_decay, count(*) FILTER (abs(greatest(CAST(0.01 AS DOUBLE), level * CAST(0.9 AS DOUBLE)) - CAST(0.01 AS DOUBLE)) < 1e-10) AS edges_at_tau_min FROM lv")
def evaporation_metrics(spark, d):
    return pheromone.evaporation_metrics(X.bipartite(spark, d)).withColumn("total_decay", F.round("total_decay", 4))


@query(f"WITH {_LEVELS}, s AS (SELECT src, dst, level * power(1 / CAST(1 + (dst % 5) AS DOUBLE), 2) AS s, (src % 100) / CAST(100 AS DOUBLE) AS r FROM lv), c AS (SELECT *, sum(s) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS upto, sum(s) OVER (PARTITION BY src) AS total FROM s) SELECT src, min(dst) AS dst FROM c WHERE total > 0 AND upto >= r * total GROUP BY src")
def route_choice(spark, d):
    c = X.bipartite(spark, d).select("src", "dst", (1 + F.col("dst") % 5).cast("double").alias("weight"), "level", F.col("dst").alias("pos"), (F.col("src") % 100 / 100.0).alias("r"))
    return pheromone.route(c)


@query(with_ctes("ev") + "SELECT src, dst, m.v AS value, m.t AS ts, m.n AS node_id FROM (SELECT user_id AS src, event_type AS dst, max(struct_pack(t := epoch_ms(date_trunc('hour', ts)), n := CAST(k AS VARCHAR), v := value)) AS m FROM ev GROUP BY 1, 2)")
def lww_merge(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), "value", millis(F.date_trunc("hour", "ts")).alias("ts"), X.k_of().cast("string").alias("node_id"))
    return pheromone.lww_merge(e.where("src % 2 = 0 or value > 50"), e.where("src % 2 = 1 or value <= 50"))


_PATHS = "p AS (SELECT user_id AS path_id, list(k ORDER BY event_id) AS path FROM ev GROUP BY user_id), pp AS (SELECT path_id, CAST(i - 1 AS INTEGER) AS pos, path[i] AS src, path[i + 1] AS dst FROM (SELECT path_id, path, unnest(generate_series(1, len(path) - 1)) AS i FROM p))"


def _paths(spark, d):
    e = X.table(spark, d, "events").select("user_id", F.struct("event_id", X.k_of().alias("k")).alias("s"))
    return pheromone.path_pairs(e.groupBy(F.col("user_id").alias("path_id")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["k"]).alias("path")))


@query(with_ctes("ev") + f", {_PATHS} SELECT path_id, pos, src, dst FROM pp")
def path_pairs(spark, d):
    return _paths(spark, d)


@query(with_ctes("ev") + f", {_PATHS}, e AS (SELECT DISTINCT src, dst FROM pp WHERE src % 2 = 0), u AS (SELECT src, dst, count(*) AS n FROM pp WHERE path_id % 2 = 0 GROUP BY 1, 2) SELECT e.src, e.dst, CASE WHEN u.n IS NULL THEN CAST(1 AS DOUBLE) ELSE least(CAST(10 AS DOUBLE), 1 + CAST(0.5 AS DOUBLE) * u.n) END AS pheromone FROM e LEFT JOIN u ON u.src = e.src AND u.dst = e.dst")
def index_reinforce(spark, d):
    pairs = _paths(spark, d)
    edges = pairs.where("src % 2 = 0").select("src", "dst").distinct().withColumn("pheromone", F.lit(1.0))
    return pheromone.reinforce(edges, pairs.where("path_id % 2 = 0"))


@query(with_ctes("prs") + "SELECT b AS src, a AS dst, round(score, 6) AS distance, round(greatest(CAST(0.01 AS DOUBLE), CAST(0.9 AS DOUBLE)), 6) AS pheromone FROM prs")
def index_evaporate(spark, d):
    e = colony.index_edges(X.vectors(spark, d), X.pairs(spark, d))
    return e.select("src", "dst", r6("distance", "distance"), r6(pheromone.evaporated(F.col("pheromone")), "pheromone"))


@query()
def fractional_deposit(spark, d):
    return memory_kernel.fold(X.deposits(spark, d), alpha=0.5, key=["src", "dst"]).withColumn("level", F.round("level", 4))


# --- colony --------------------------------------------------------------------------------

@query()
def colony_best_path(spark, d):
    starts = X.requests(spark, d).select(F.col("request_id").alias("start"))
    return colony.best_paths(starts, X.knn(spark, d)).withColumn("cost", r6("cost"))


@query()
def ant_explore(spark, d):
    starts = X.requests(spark, d).select(F.col("request_id").alias("start"))
    return colony.explore_all(starts, X.knn(spark, d)).withColumns({c: r6(c) for c in ("cost", "alpha", "beta")})


@query()
def ant_index_topk(spark, d):
    v = X.vectors(spark, d)
    return colony.index_search(v, colony.index_edges(v, X.pairs(spark, d)), X.requests(spark, d), 5).withColumn("score", r6("score"))


@query()
def rng_sequence(spark, d):
    return colony.uniform_sequence(spark, 50, 20).withColumn("u", F.round("u", 12))


# --- regulation ----------------------------------------------------------------------------

_ACTION = "CASE WHEN resource_utilization > 0.9 THEN 'CircuitBreak' WHEN latency_p95_ms > 100 OR error_rate > 0.05 THEN 'ReduceLoad' WHEN anomaly_rate > 10 THEN 'TightenSecurity' WHEN pheromone_entropy < 0.2 THEN 'IncreaseExploration' ELSE 'None' END"
_STATUS = "CASE a WHEN 'ReduceLoad' THEN 'REDUCING_LOAD' WHEN 'IncreaseExploration' THEN 'EXPLORING' WHEN 'TightenSecurity' THEN 'TIGHTENING_SECURITY' WHEN 'CircuitBreak' THEN 'CIRCUIT_BREAK' ELSE 'BALANCED' END"


@query(with_ctes("hourly") + f"SELECT hour, {_ACTION} AS action FROM hourly")
def regulate_actions(spark, d):
    return X.hourly(spark, d).select("hour", regulation.action().alias("action"))


@query(with_ctes("hourly") + f"SELECT hour, {_STATUS} AS status FROM (SELECT hour, {_ACTION} AS a FROM hourly)")
def status_label(spark, d):
    return X.hourly(spark, d).select("hour", regulation.status(regulation.action()).alias("status"))


@query(with_ctes("hourly") + f"SELECT hour, round(CASE a WHEN 'ReduceLoad' THEN CAST(0.77 AS DOUBLE) WHEN 'TightenSecurity' THEN CAST(0.63 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END, 6) AS detection_threshold, CAST(5 AS INTEGER) AS ant_count, round(CASE a WHEN 'IncreaseExploration' THEN CAST(0.055 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END, 6) AS mutation_rate, round(CASE a WHEN 'IncreaseExploration' THEN CAST(0.11 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END, 6) AS evaporation_rho, round(CASE a WHEN 'TightenSecurity' THEN CAST(0.54 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END, 6) AS nonself_threshold FROM (SELECT hour, {_ACTION} AS a FROM hourly)")
def regulate_adjust_once(spark, d):
    start = {n: F.lit(v) for n, v in regulation.START.items()}
    a = regulation.adjusted(regulation.action(), start)
    return X.hourly(spark, d).select("hour", r6(a["detection_threshold"], "detection_threshold"), a["ant_count"].alias("ant_count"), *[r6(a[n], n) for n in ("mutation_rate", "evaporation_rho", "nonself_threshold")])


_FOLD = {"dt": ("CASE e.a WHEN 'ReduceLoad' THEN least(greatest(s.dt * 1.1, 0.3), 0.95) WHEN 'TightenSecurity' THEN least(greatest(s.dt * 0.9, 0.3), 0.95) ELSE s.dt END", 0.7), "ac": ("CASE e.a WHEN 'ReduceLoad' THEN least(greatest(round(s.ac * 0.9), 2), 20) ELSE s.ac END", 5), "mr": ("CASE e.a WHEN 'IncreaseExploration' THEN least(greatest(s.mr * 1.1, 0.01), 0.3) ELSE s.mr END", 0.05), "er": ("CASE e.a WHEN 'IncreaseExploration' THEN least(greatest(s.er * 1.1, 0.01), 0.5) ELSE s.er END", 0.1), "nt": ("CASE e.a WHEN 'TightenSecurity' THEN least(greatest(s.nt * 0.9, 0.3), 0.9) ELSE s.nt END", 0.6), "sa": ("CASE e.a WHEN 'TightenSecurity' THEN least(greatest(s.sa + 0.002, 0.8), 0.99) ELSE s.sa END", 0.99)}
_STARTS = ", ".join(f"{n} := CAST({v} AS DOUBLE)" for n, (_, v) in _FOLD.items())
_STEPS = ", ".join(f"{n} := CAST({c} AS DOUBLE)" for n, (c, _) in _FOLD.items())


@query(with_ctes("hourly") + f", t AS (SELECT CAST(day(hour) AS INTEGER) AS engine, list(struct_pack(a := {_ACTION}, {_STARTS}) ORDER BY hour) AS es FROM hourly GROUP BY 1), f AS (SELECT engine, len(es) AS cycles, list_reduce(list_prepend(struct_pack(a := '', {_STARTS}), es), lambda s, e: struct_pack(a := e.a, {_STEPS})) AS p FROM t) SELECT engine, CAST(cycles AS BIGINT) AS cycles, CAST(p.ac AS INTEGER) AS ant_count, round(p.dt, 6) AS detection_threshold, round(p.mr, 6) AS mutation_rate, round(p.er, 6) AS evaporation_rho, round(p.nt, 6) AS nonself_threshold, round(p.sa, 6) AS caputo_suspect_alpha FROM f")
def regulate_fold(spark, d):
    m = X.hourly(spark, d).withColumns({"engine": F.dayofmonth("hour"), "seq": millis("hour")})
    out = regulation.regulate(m)
    return out.select("engine", "cycles", "ant_count", *[r6(n, n) for n in ("detection_threshold", "mutation_rate", "evaporation_rho", "nonself_threshold", "caputo_suspect_alpha")])


@query("SELECT event_id, 10 - v < 3 AS skipped_graph, 10 - v < 2 AS skipped_ecma, 10 - v < 1 AS skipped_mce, 10 - v < 1.5 AS skipped_ot FROM (SELECT event_id, value / CAST(10 AS DOUBLE) AS v FROM events)")
def degrade_decision(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", *[c.alias(n) for n, c in regulation.degradation(F.col("value") / 10).items()])


@query("SELECT event_id, samples, CAST(failures AS BIGINT) AS failures, samples >= 5 AND failures / CAST(samples AS DOUBLE) > 0.2 AS opens FROM (SELECT event_id, count(*) OVER w AS samples, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS failures FROM events WINDOW w AS (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW))")
def breaker_open(spark, d):
    e = X.table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("service"), (F.col("event_type") == "error").alias("failed"))
    return regulation.breaker(e, key="service", seconds=21_600).select("event_id", "samples", "failures", "opens")


@query()
def breaker_states(spark, d):
    """Five services; each event is a request, an error one that failed."""
    e = X.table(spark, d, "events").select("event_id", F.col("event_id").alias("seq"), millis("ts").alias("ms"), (F.col("user_id") % 5).alias("service"), (F.col("event_type") == "error").alias("failed"))
    out = regulation.breaker_states(e, key="service", window_ms=21_600_000, open_ms=10_800_000)
    return out.select("event_id", "service", "state", "allowed")


@query(with_ctes("hourly") + "SELECT hour, CASE WHEN s AND p AND l THEN 'Healthy' WHEN s OR p THEN 'Degraded' ELSE 'Unhealthy' END AS health FROM (SELECT hour, error_rate < 0.3 AS s, n > 10 AS p, latency_p95_ms < 200 AS l FROM hourly)")
def health_status(spark, d):
    return X.hourly(spark, d).select("hour", regulation.health(F.col("error_rate") < 0.3, F.col("n") > 10, F.col("latency_p95_ms") < 200).alias("health"))


@query("WITH c AS (SELECT user_id, event_id, value, count(*) OVER l AS c, var_pop(value) OVER l AS v, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events WINDOW l AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)), i AS (SELECT *, sum(CASE WHEN b IS NULL OR value < b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1 AS streak FROM i) SELECT user_id, event_id, round(v, 2) AS recent_variance, CAST(streak AS INTEGER) AS streak, (c >= 3 AND v < 400) OR streak >= 5 AS converged FROM s")
def convergence_window(spark, d):
    e = X.table(spark, d, "events").select("user_id", "event_id", "value")
    out = regulation.convergence(e, key="user_id", seq="event_id", cost="value", variance=400.0)
    return out.select("user_id", "event_id", F.round("recent_variance", 2).alias("recent_variance"), "streak", "converged")


# --- fractional memory ---------------------------------------------------------------------

_KERNEL = "SELECT i AS idx, m AS mode, exp(CAST(-0.5 AS DOUBLE) * power((m - (1 - (i + 1) * CAST(0.01 AS DOUBLE)) * 7) / CAST(1.45 AS DOUBLE), 2)) AS raw, 2 * power(CAST(2 AS DOUBLE) / CAST(3.17e-9 AS DOUBLE), -m / CAST(7 AS DOUBLE)) AS theta FROM generate_series(0, 98) AS a(i), generate_series(0, 7) AS b(m)"
_OMEGA = f"kern AS (SELECT idx, mode, theta, raw / sum(raw) OVER (PARTITION BY idx) AS omega FROM ({_KERNEL}))"
_EXP = "1 / power(1 + ({u}) * (1 + ({u}) * (CAST(0.5 AS DOUBLE) + ({u}) * (CAST(0.16666667 AS DOUBLE) + ({u}) * CAST(0.04166667 AS DOUBLE)))), 64)"


def _exp_sql(x: str) -> str:
    return _EXP.format(u=f"least(greatest({x}, CAST(0 AS DOUBLE)), CAST(88 AS DOUBLE)) / 64")


@query(f"WITH {_OMEGA} SELECT CAST(idx AS BIGINT) AS idx, CAST(mode AS INTEGER) AS mode, round(ln(theta), 6) AS ln_theta, round(omega, 6) AS omega FROM kern")
def kernel_table(spark, d):
    return memory_kernel.kernel_table(spark).select("idx", "mode", r6(F.log("theta"), "ln_theta"), r6("omega", "omega"))


@query(f"SELECT event_id, round({_exp_sql('value / 10')}, 6) AS y FROM events")
def exp_neg_fast(spark, d):
    return X.table(spark, d, "events").select("event_id", r6(memory_kernel.exp_neg(F.col("value") / 10), "y"))


def _states(spark, d):
    """A state per event: all modes at its value, an order by k, looked at some minutes later."""
    e = X.table(spark, d, "events").withColumn("k", X.k_of())
    return e.select("event_id", F.array_repeat("value", 8).alias("modes"), millis("ts").alias("then"), F.greatest(F.least(F.col("k") / 100.0, F.lit(0.99)), F.lit(0.01)).alias("alpha"), F.col("value").alias("cached"), (millis("ts") + F.col("k") * 60_000).alias("now"))


# Every mode of these states holds the same value.
_PEEK = with_ctes("ev") + f", {_OMEGA}, st AS (SELECT event_id, value, k, greatest(least(k, 99), 1) - 1 AS idx, k * 60 AS dt FROM ev), pk AS (SELECT st.event_id, sum(st.value * ({_exp_sql('kern.theta * st.dt')}) * kern.omega) AS total, sum((st.value * ({_exp_sql('kern.theta * st.dt')}) + 5) * kern.omega) AS stepped FROM st JOIN kern ON kern.idx = st.idx GROUP BY st.event_id)"


@query(_PEEK + " SELECT st.event_id, round(CASE WHEN st.k = 0 THEN st.value ELSE pk.total END, 4) AS intensity FROM st JOIN pk ON pk.event_id = st.event_id")
def memory_peek(spark, d):
    s = _states(spark, d)
    return s.select("event_id", F.round(memory_kernel.peek(F.col("modes"), F.col("then"), F.col("alpha"), F.col("cached"), F.col("now")), 4).alias("intensity"))


@query(_PEEK + " SELECT event_id, round(stepped, 4) AS intensity FROM pk")
def memory_step(spark, d):
    s = _states(spark, d)
    return s.select("event_id", F.round(memory_kernel.step(F.col("modes"), F.col("then"), F.col("alpha"), F.col("now"), F.lit(5.0))["cached_intensity"], 4).alias("intensity"))


@query(_PEEK + " SELECT st.event_id, round(pk.total, 4) AS intensity, CAST(0.15 AS DOUBLE) AS alpha FROM st JOIN pk ON pk.event_id = st.event_id")
def memory_modulate(spark, d):
    s = _states(spark, d)
    m = memory_kernel.modulate(F.col("modes"), F.col("then"), F.col("alpha"), F.lit(0.15), F.col("now"))
    return s.select("event_id", m.alias("m")).select("event_id", F.round("m.cached_intensity", 4).alias("intensity"), "m.alpha")


@query(_PEEK + ", v AS (SELECT st.event_id, (st.idx + 1) / CAST(100 AS DOUBLE) AS alpha, CASE WHEN st.k = 0 THEN st.value ELSE pk.total END AS x FROM st JOIN pk ON pk.event_id = st.event_id) SELECT event_id, CASE WHEN x < 0.05 THEN 'Apoptosis' WHEN x > 50 AND alpha > 0.2 THEN 'Specialized' WHEN x > 15 AND alpha > 0.6 THEN 'Progenitor' ELSE 'Stem' END AS stage, CASE WHEN x < 0.05 THEN alpha WHEN x > 50 AND alpha > 0.2 THEN CAST(0.15 AS DOUBLE) WHEN x > 15 AND alpha > 0.6 THEN CAST(0.55 AS DOUBLE) ELSE alpha END AS alpha FROM v")
def memory_stage(spark, d):
    s = _states(spark, d)
    x = memory_kernel.peek(F.col("modes"), F.col("then"), F.col("alpha"), F.col("cached"), F.col("now"))
    return s.withColumn("x", x).select("event_id", memory_kernel.stage(F.col("x"), F.col("alpha")).alias("s")).select("event_id", "s.stage", "s.alpha")


# --- actions -------------------------------------------------------------------------------

_HASH = "SELECT event_id, k, CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(generate_series(1, length(event_type)), lambda i: CAST(ascii(substr(event_type, i, 1)) AS HUGEINT))), lambda s, b: (s * 31 + b) % CAST(18446744073709551616 AS HUGEINT)) AS HUGEINT) AS h FROM (SELECT event_id, k, event_type || '-' || CAST(event_id AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) AS event_type FROM ev)"


def _hashed(spark, d):
    text = F.concat_ws("-", F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    e = X.table(spark, d, "events").select("event_id", X.k_of().alias("k"), text.cast("binary").alias("payload"))
    return e.withColumn("h", action.hash_codes(action.byte_values(F.col("payload"))))


@query(with_ctes("ev") + f"SELECT event_id, CAST(h AS VARCHAR) AS payload_hash FROM ({_HASH})")
def payload_hash(spark, d):
    return _hashed(spark, d).select("event_id", F.col("h").cast("string").alias("payload_hash"))


@query(with_ctes("ev") + f", t AS (SELECT event_id, h, CASE event_id % 4 WHEN 0 THEN 'risk_eval' WHEN 1 THEN 'data_enrich' WHEN 2 THEN 'alert' ELSE 'classify' END AS intent, CAST(h % 100 AS DOUBLE) / 100 AS p FROM ({_HASH})) SELECT event_id, intent, CASE intent WHEN 'risk_eval' THEN CASE WHEN p > 0.7 THEN 'high' WHEN p > 0.4 THEN 'medium' ELSE 'low' END WHEN 'data_enrich' THEN 'enriched' WHEN 'alert' THEN CASE CAST(h % 4 AS INTEGER) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END ELSE CASE WHEN p > 0.5 THEN 'self' ELSE 'non_self' END END AS label, CASE intent WHEN 'data_enrich' THEN CAST(h % 5 + 1 AS DOUBLE) WHEN 'alert' THEN CAST(h % 4 AS DOUBLE) ELSE p END AS value, CASE intent WHEN 'risk_eval' THEN CASE WHEN p > 0.7 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END WHEN 'data_enrich' THEN CAST(0.03 AS DOUBLE) WHEN 'alert' THEN CASE WHEN h % 4 >= 2 THEN CAST(0.04 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END ELSE CASE WHEN p > 0.5 THEN CAST(0.02 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END END AS maturity_delta FROM t")
def action_dispatch(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("risk_eval", "data_enrich", "alert", "classify")]), (F.col("event_id") % 4 + 1).cast("int"))
    h = _hashed(spark, d).withColumn("intent", name)
    return h.select("event_id", "intent", action.dispatch(F.col("intent"), F.col("h"), F.octet_length("payload")).alias("o")).select("event_id", "intent", "o.label", "o.value", "o.maturity_delta")


@query(with_ctes("ev") + "SELECT event_id, k * 100 > 5000 AS expired, CASE WHEN event_id % 10 = 0 THEN 'payload is empty' WHEN event_id % 7 = 0 THEN 'TTL is zero' END AS error FROM ev")
def ttl_check(spark, d):
    e = X.table(spark, d, "events").select("event_id", X.k_of().alias("k"), millis("ts").alias("ms"))
    return e.select("event_id", action.is_expired(F.col("ms"), F.col("ms") + F.col("k") * 100, F.lit(action.TTL_MS)).alias("expired"), action.invalid((F.col("event_id") % 10), F.col("event_id") % 7).alias("error"))


@query(with_ctes("nodes") + f"SELECT user_id, CAST(least(greatest(round(avg({_MATURE.format(s='state')}) * 10), 1), 10) AS INTEGER) AS priority FROM nodes GROUP BY user_id")
def priority_calc(spark, d):
    n = X.nodes(spark, d).withColumn("maturity", lifecycle.maturity())
    return n.groupBy("user_id").agg(action.priority(action.mean(F.col("maturity"))).alias("priority"))


def _packed(spark, d):
    n = X.nodes(spark, d).withColumns({"maturity": lifecycle.maturity(), "id": F.col("user_id"), "pos": F.col("event_type")})
    return action.pack(n, "user_id")


@query()
def action_pack(spark, d):
    return _packed(spark, d).select("user_id", F.hex("payload").alias("payload_hex"), "payload_size")


@query()
def compression_ratio(spark, d):
    return _packed(spark, d).select("user_id", "json_size", r6("compression_ratio", "compression_ratio"))


# --- storage -------------------------------------------------------------------------------

def _log(spark, d):
    return storage.entries(X.table(spark, d, "events").select(F.col("event_id").alias("seq"), millis("ts").alias("timestamp_ms"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("data")))


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS data, max(event_id) AS seq FROM events GROUP BY 1")
def kv_latest(spark, d):
    return storage.latest(_log(spark, d))


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS data, max(event_id) AS seq FROM events WHERE user_id = 7 GROUP BY 1")
def kv_read(spark, d):
    return storage.read(_log(spark, d), "7")


@query("SELECT event_id AS seq, (epoch_us(ts) // 1000) AS timestamp_ms, 'INSERT' AS operation, CAST(user_id AS VARCHAR) AS key, props AS data FROM events")
def wal_replay(spark, d):
    path = f"{storage.scratch(spark)}/wal"
    storage.append(_log(spark, d), path)
    return storage.replay(spark, path).select("seq", "timestamp_ms", "operation", "key", "data")


def _damaged(spark, d):
    bad = F.when(F.col("seq") % 11 == 0, F.col("checksum") + 1).otherwise(F.col("checksum"))
    return _log(spark, d).withColumns({"checksum": bad, "operation": F.when(F.col("seq") % 7 == 0, "DELETE").otherwise("INSERT")})


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS data, max(event_id) AS seq FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0 GROUP BY 1")
def wal_recover_crc(spark, d):
    return storage.recover(_damaged(spark, d))


@query("SELECT count(*) AS replayed, count(*) FILTER (event_id % 11 = 0) AS corrupt, count(*) FILTER (event_id % 11 <> 0 AND event_id % 7 = 0) AS skipped, count(*) FILTER (event_id % 11 <> 0 AND event_id % 7 <> 0) AS applied FROM events")
def wal_recovery_report(spark, d):
    return storage.recovery_report(_damaged(spark, d))


_F32 = "round(CAST(CAST(embedding[{i}] AS FLOAT) AS DOUBLE), 6)"


@query("SELECT vec_id AS id, " + ", ".join(f"{_F32.format(i=i + 1)} AS mode_{i}" for i in range(8)) + f", vec_id * 1000 AS last_updated_ms, CAST(0.5 AS DOUBLE) AS alpha, {_F32.format(i=1)} AS cached_intensity FROM embeddings")
def page_codec(spark, d):
    s = X.vectors(spark, d).select("id", F.slice("vector", 1, 8).cast("array<float>").alias("modes"), (F.col("id") * 1000).alias("last_updated_ms"), F.lit(0.5).cast("float").alias("alpha"), F.col("vector")[0].cast("float").alias("cached_intensity"))
    back = storage.decode_states(storage.encode_states(s))
    double = lambda c: r6(c.cast("double"))
    return back.select("id", *[double(F.col("modes")[i]).alias(f"mode_{i}") for i in range(8)], "last_updated_ms", *[double(F.col(c)).alias(c) for c in ("alpha", "cached_intensity")])


@query("SELECT event_id, CASE WHEN length(props) >= 6 THEN substr(props, 3, 4) END AS part FROM events")
def mmap_range_read(spark, d):
    e = X.table(spark, d, "events").select("event_id", F.col("props").cast("binary").alias("data"))
    return e.select("event_id", storage.read_range(F.col("data"), 2, 4).cast("string").alias("part"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unknown message type: 0x00' END AS error, CASE WHEN event_id % 4 > 0 THEN regexp_replace(lpad(lower(hex(user_id)), 32, '0'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS node_id, CASE WHEN event_id % 4 > 0 THEN event_id END AS sequence_number, CASE event_id % 4 WHEN 1 THEN 'PheromoneSync' WHEN 2 THEN 'AntigenSync' WHEN 3 THEN 'GraphDeltaSync' END AS message_type, CASE WHEN event_id % 4 > 0 THEN CAST((epoch_us(ts) // 1000) AS VARCHAR) END AS causal_watermark, CASE WHEN event_id % 4 > 0 THEN props END AS payload FROM events")
def gossip_decode(spark, d):
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    packet = F.unhex(F.concat(F.lit("03"), F.lpad(F.hex(F.col("user_id")), 32, "0"), hexed(F.col("event_id"), 8), F.lpad(F.hex((F.col("event_id") % 4).cast("bigint")), 2, "0"), hexed(millis("ts"), 16), F.hex(F.col("props").cast("binary"))))
    out = storage.decode_packets(X.table(spark, d, "events").select("event_id", packet.alias("packet")))
    return out.select("event_id", "error", "node_id", "sequence_number", "message_type", F.col("causal_watermark").cast("string").alias("causal_watermark"), F.col("payload").cast("string").alias("payload"))


@query(with_ctes("emb") + f"SELECT 'log:query:' || CAST(request_id AS VARCHAR) AS key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS value FROM ({_RANKED}) WHERE rank <= 10 GROUP BY request_id")
def query_log(spark, d):
    top = retrieval.batch_top_k(X.vectors(spark, d), X.requests(spark, d), 10)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    return top.groupBy("request_id").agg(F.array_join(ids, ",").alias("value")).select(F.concat(F.lit("log:query:"), F.col("request_id").cast("string")).alias("key"), "value")


@query(f"WITH {_LEVELS} SELECT src, dst, round(level, 6) AS level FROM lv")
def checkpoint_roundtrip(spark, d):
    return storage.snapshot(X.bipartite(spark, d), f"{storage.scratch(spark)}/snapshot").withColumn("level", r6("level"))


@query("WITH RECURSIVE e AS (SELECT user_id AS request_id, event_id AS seq, (epoch_us(ts) // 1000) AS ms FROM events), f AS (SELECT request_id, min(ms) AS ms FROM e GROUP BY 1 UNION ALL SELECT f.request_id, (SELECT min(e.ms) FROM e WHERE e.request_id = f.request_id AND e.ms >= f.ms + 86400000) FROM f WHERE EXISTS (SELECT 1 FROM e WHERE e.request_id = f.request_id AND e.ms >= f.ms + 86400000)) SELECT f.request_id, min(e.seq) AS seq FROM f JOIN e ON e.request_id = f.request_id AND e.ms = f.ms GROUP BY f.request_id, f.ms")
def idempotent_for_a_day(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), millis("ts").alias("ms"))
    return storage.idempotent(e, ttl_ms=86_400_000).select("request_id", "seq")


@query("SELECT user_id AS request_id, min(event_id) AS seq, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def idempotent_first(spark, d):
    return storage.idempotent(X.table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), "event_type"))


@query()
def shard_assign(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", cluster.shard(cluster.request_hash("c_mktsegment")).alias("shard"))


@query("SELECT c_nationkey, arg_min(c_custkey, struct_pack(a := c_acctbal, k := c_custkey)) AS node FROM customer WHERE c_acctbal < 5000 GROUP BY c_nationkey")
def least_loaded(spark, d):
    loads = X.table(spark, d, "customer").where("c_acctbal < 5000").select("c_nationkey", F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("load"))
    return cluster.least_loaded(loads, "c_nationkey")


@query("WITH l AS (SELECT c_nationkey, c_custkey AS node, c_acctbal / 10000 AS load FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY load, node) AS r FROM l), b AS (SELECT c_nationkey, max(CASE WHEN r = 1 THEN node END) AS best, max(CASE WHEN r = 2 THEN node END) AS second FROM r GROUP BY 1) SELECT l.node AS primary_node, CASE WHEN l.load > 0.85 THEN coalesce(CASE WHEN b.best = l.node THEN b.second ELSE b.best END, l.node) ELSE l.node END AS node FROM l JOIN b USING (c_nationkey)")
def route_by_load(spark, d):
    loads = X.table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("node"), (F.col("c_acctbal") / 10_000).alias("load"))
    return cluster.route(loads.select("c_nationkey", F.col("node").alias("primary")), loads, "c_nationkey").select(F.col("primary").alias("primary_node"), "node")


@query("SELECT name || ' ' || CAST(v AS VARCHAR) AS line FROM (SELECT unnest(['engine_events_total', 'engine_errors_total', 'engine_users']) AS name, unnest([count(*), count(*) FILTER (event_type = 'error'), count(DISTINCT user_id)]) AS v FROM events)")
def metrics_lines(spark, d):
    m = X.table(spark, d, "events").agg(F.count(F.lit(1)).alias("engine_events_total"), F.count_if(F.col("event_type") == "error").alias("engine_errors_total"), F.countDistinct("user_id").alias("engine_users"))
    return cluster.metric_lines(m)


# --- streams (batch form) ------------------------------------------------------------------

@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_window_counts(spark, d):
    return stream_batch.window_counts(X.table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid")
def events_session_state(spark, d):
    return stream_batch.sessions(X.table(spark, d, "events"), "6 hours")


# --- composite -----------------------------------------------------------------------------

@query(with_ctes("emb") + f"SELECT request_id, count(*) AS hits, round(max(s), 6) AS best, CASE WHEN bool_or(s < 0.3) THEN 'alert' WHEN bool_or(s > 0.8) THEN 'risk_eval' ELSE 'classify' END AS intent, CAST(least(greatest(round(avg(s) * 10), 1), 10) AS INTEGER) AS priority, round(avg(CAST(0.045 AS DOUBLE) + CAST(0.2 AS DOUBLE) * s), 6) AS mean_maturity FROM ({_RANKED}) WHERE rank <= 10 GROUP BY request_id")
def pipeline_batch(spark, d):
    out = pipeline.run(X.vectors(spark, d), X.requests(spark, d), X.knn(spark, d), k=10)
    return out.select("request_id", "hits", r6("best", "best"), "intent", "priority", r6("mean_maturity", "mean_maturity"))


@query()
def pipeline_actions(spark, d):
    out = pipeline.run(X.vectors(spark, d), X.requests(spark, d), X.knn(spark, d), k=10)
    return out.select("request_id", "intent", "error", "label", r6("value", "value"), "nodes", "maturity_delta", "expanded")


# --- the rest of the surface ---------------------------------------------------------------

@query(with_ctes("emb") + "SELECT request_id, CAST(rank AS INTEGER) AS rank, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, id) AS rank FROM (SELECT a.id AS request_id, b.id AS id, list_cosine_similarity(a.v, b.v) AS s FROM emb a, emb b) WHERE s >= 0.1) WHERE rank <= 5")
def vec_topk_all(spark, d):
    v = X.vectors(spark, d)
    return retrieval.batch_top_k(v, v.withColumnRenamed("id", "request_id"), 5).select("request_id", "rank", "id", r6("score", "score"))


@query(with_ctes("nodes") + f"SELECT 'ecma:node:' || CAST(user_id AS VARCHAR) || ':' || event_type AS key, to_state AS state, usage_count, round({_MATURE.format(s='to_state')}, 6) AS maturity FROM (SELECT *, {_NEXT} AS to_state FROM nodes)")
def node_persist(spark, d):
    n = lifecycle.process(X.nodes(spark, d), X.NODE_THRESHOLDS)
    key = F.concat(F.lit("ecma:node:"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
    saved = n.select(F.lit(1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("timestamp_ms"), key.alias("key"), F.to_json(F.struct("state", "usage_count", "maturity")).alias("data"))
    back = storage.recover(storage.entries(saved)).select("key", F.from_json("data", "state string, usage_count bigint, maturity double").alias("n"))
    return back.select("key", "n.state", "n.usage_count", r6("n.maturity", "maturity"))


@query("WITH q AS (SELECT user_id AS key, min(event_id) AS inserted, count(*) AS accesses FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY inserted DESC) AS newest, row_number() OVER (ORDER BY accesses DESC, key) AS most FROM q) SELECT key, newest <= 50 AS in_l1, most <= 40 AS in_l3 FROM r")
def cache_evict(spark, d):
    q = cache.uses(X.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), millis("ts").alias("ms")))
    l1, l3 = (cache.kept(q, order, n).withColumn(name, F.lit(True)) for order, n, name in (("recent", 50, "l1"), ("frequent", 40, "l3")))
    return q.select("key").join(l1, "key", "left").join(l3, "key", "left").select("key", F.coalesce("l1", F.lit(False)).alias("in_l1"), F.coalesce("l3", F.lit(False)).alias("in_l3"))


@query(f"WITH q AS (SELECT user_id AS key, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1) SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key DESC) AS n FROM q WHERE {X.NOW_MS} - last_ms < 864000000) WHERE n <= 60")
def cache_smallest_key(spark, d):
    q = cache.uses(X.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), millis("ts").alias("ms")))
    return cache.kept(q, "keyed", 60, now=X.NOW_MS, ttl_ms=864_000_000)


@query(_PEEK + " SELECT st.event_id, round(CASE WHEN st.k % 2 = 0 THEN pk.total ELSE pk.stepped END, 4) AS intensity, CASE WHEN st.k % 2 = 0 THEN CAST(0.99 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS alpha FROM st JOIN pk ON pk.event_id = st.event_id")
def memory_suspect_confirm(spark, d):
    """Suspects (even k) are given the order that forgets, confirmed antigens a stimulus and the
    order that keeps."""
    s = _states(spark, d).withColumn("k", (F.col("now") - F.col("then")) / 60_000)
    even = (F.col("k") % 2) == 0
    given = [F.col(c) for c in ("modes", "then", "alpha")]
    plain = memory_kernel.modulate(*given, F.lit(0.99), F.col("now"))["cached_intensity"]
    raised = memory_kernel.step(*given, F.col("now"), F.lit(5.0))["cached_intensity"]
    return s.select("event_id", F.round(F.when(even, plain).otherwise(raised), 4).alias("intensity"), F.when(even, 0.99).otherwise(0.05).alias("alpha"))


@query(with_ctes("antig") + "SELECT id, severity, encounter_count FROM antig")
def antigen_json_roundtrip(spark, d):
    a = X.antigens(spark, d).select("id", "severity", "encounter_count")
    path = f"{storage.scratch(spark)}/antigens"
    a.write.json(path)
    return spark.read.schema(a.schema).json(path)


@query("SELECT user_id, '[' || string_agg(CAST(event_id AS VARCHAR) || ':' || event_type, ',' ORDER BY event_id) || ']' AS log FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id")
def error_log(spark, d):
    e = X.table(spark, d, "events").where("event_type in ('error', 'signup')")
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["event_type"]))
    return e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("log"))


@query("SELECT CAST(floor(event_id / CAST(500 AS DOUBLE)) AS BIGINT) AS tenant, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS error_rate FROM events GROUP BY 1")
def tenant_error_rate(spark, d):
    e = X.table(spark, d, "events").withColumn("tenant", F.floor(F.col("event_id") / 500).cast("bigint"))
    errors = F.count_if(F.col("event_type") == "error")
    return e.groupBy("tenant").agg(F.count(F.lit(1)).alias("total"), errors.alias("errors"), r6(regulation.rate(errors, F.count(F.lit(1))), "error_rate"))
