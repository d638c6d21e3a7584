"""Small fixtures with known answers."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrel.functions import vector as V
from spindrel.operators import action, colony, graph, histogram, immune, lifecycle, memory_kernel, pheromone, regulation, retrieval
from spindrel.plans import pipeline
from spindrel.registry import queries
from spindrel.sources import storage


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


TRIO = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]


def test_top_k(spark):
    found = retrieval.top_k(vectors(spark, TRIO), [1.0, 0.0], 2).collect()
    assert [r.id for r in found] == [1, 3]
    assert retrieval.top_k(vectors(spark, TRIO), [1.0, 0.0], 5, threshold=-1.0).count() == 3


@pytest.mark.parametrize("query, k", [([], 1), ([1.0], 0), ([float("nan")], 1)])
def test_bad_queries(spark, query, k):
    with pytest.raises(ValueError):
        retrieval.top_k(vectors(spark, TRIO), query, k)


def test_batch_agrees_with_single(spark):
    rng = np.random.default_rng(3)
    data = vectors(spark, [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(900, None), (901, []), (902, [float("nan")] * 8), (903, [0.0] * 8)])
    asked = data.where("id < 5").withColumnRenamed("id", "request_id")
    batch = {(r.request_id, r["rank"]): r.id for r in retrieval.batch_top_k(data, asked, 7).collect()}
    for q in asked.collect():
        assert [batch[q.request_id, i + 1] for i in range(7)] == [r.id for r in retrieval.top_k(data.where("vector is not null"), q.vector, 7).collect()]


class Held:
    """Takes the place of a table, to run in this process what would be sent to the workers."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_best_of_many_queries_in_tiles(spark):
    """A batch against all queries at once would take 320 MB."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(2000, 2))
    m[500:1000] = m[0]
    asked = spark.range(20_000).select(F.col("id").alias("request_id"), F.array(F.cos(F.col("id") / 7), F.sin(F.col("id") / 7)).alias("vector"))
    held = retrieval._block(Held(spark), asked, 0.1, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(m.tolist())], names=["id", "vector"])
    tracemalloc.start()
    found = [r for b in held.run(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(found) == 60_000
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 20_000, 997):
        near = unit @ np.array([np.cos(q / 7), np.sin(q / 7)])
        assert sorted((-round(r["score"], 9), r["id"]) for r in found if r["request_id"] == q) == sorted((-round(near[i], 9), i) for i in range(2000))[:3]


def test_equal_vectors_rank_by_id(spark):
    rng = np.random.default_rng(7)
    m = np.repeat(rng.normal(size=(7, 64)), 41, axis=0)
    data = vectors(spark, [(i, v.tolist()) for i, v in enumerate(m)])
    asked = data.where("id % 41 = 3").withColumnRenamed("id", "request_id")
    for r in retrieval.batch_top_k(data, asked, 5).collect():
        assert r.id == r.request_id - 3 + r["rank"] - 1


def test_distances_without_a_join(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(40)] + [(90, []), (91, None)]
    data = vectors(spark, rows)
    found = {(r.request_id, r.id): r.distance for r in retrieval.batch_distances(data, data.where("id % 7 = 0").withColumnRenamed("id", "request_id")).collect()}
    known = {i: np.array(v) for i, v in rows if v}
    assert found == pytest.approx({(a, b): float(np.linalg.norm(known[a] - known[b])) for a in known if a % 7 == 0 for b in known if len(known[a]) == len(known[b])})


def test_l2_pairs_is_no_join(spark, sf):
    """A join by the dimension alone is one key, hence one task."""
    plan = queries()["vec_l2_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_all_pairs_in_blocks(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 5))
    found = {(r.a, r.b) for r in retrieval.all_pairs(vectors(spark, [(i, v.tolist()) for i, v in enumerate(m)]), threshold=0.5, block=10).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    assert found == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5}


def test_cosine_edges(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([float("inf"), 1.0], [1.0, 1.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, None, None, 1.0]


def test_sql_functions(spark):
    V.register(spark)
    assert spark.sql("select cos_sim(array(1D, 0D), array(1D, 0D)), l2_dist(array(0D), array(3D))").first()[:] == (1.0, 3.0)


def test_histogram(spark):
    d = spark.range(1000).select((F.col("id") * 100).alias("latency_us"))
    p = {r.p: r.value_us for r in histogram.percentiles(histogram.histogram(d)).collect()}
    assert 40_000 <= p[500] <= 60_000
    single = spark.createDataFrame([(5000,)], "latency_us bigint")
    assert histogram.summary(single).first()[:4] == (1, 5000, 5000, 5000)
    assert {r.value_us for r in histogram.percentiles(histogram.histogram(single.where("false"))).collect()} == {0}


def graph_of(spark, edges):
    return graph.build(spark.createDataFrame([(a, b, w, i) for i, (a, b, w) in enumerate(edges)], "a bigint, b bigint, weight double, seq bigint"))


def seeds(spark, *nodes):
    return spark.createDataFrame([(1, n, i) for i, n in enumerate(nodes)], "request_id bigint, node bigint, pos bigint")


def test_first_weight_wins_and_loops(spark):
    g = graph_of(spark, [(1, 2, 0.5), (2, 1, 0.9), (3, 3, 0.1)])
    assert graph.counts(g).first()[:] == (3, 3)
    assert [r.weight for r in graph.edge_list(g).collect()] == [0.5]


def test_capped_expansion(spark):
    star = graph_of(spark, [(0, i, 0.5) for i in range(1, 101)])
    assert graph.expand_capped(star, seeds(spark, 0), 2).count() == 2
    assert graph.expand_capped(star, seeds(spark, 0), 2, 5).count() == 5
    two = graph_of(spark, [(1, 2, 0.5), (10, 20, 0.8)])
    assert {r.node for r in graph.expand_capped(two, seeds(spark, 1, 10), 2).collect()} == {1, 2, 10, 20}


def plain_expansion(adjacency, start, depth, cap):
    seen, queue = list(dict.fromkeys(start)), [(n, 0) for n in dict.fromkeys(start)]
    while queue:
        node, d = queue.pop(0)
        if d < depth and len(seen) < cap:
            for other in adjacency.get(node, []):
                if len(seen) < cap and other not in seen:
                    seen.append(other)
                    queue.append((other, d + 1))
    return set(seen)


def test_capped_expansion_like_a_queue(spark):
    rng = np.random.default_rng(5)
    edges = list({(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a < b})
    g = graph_of(spark, [(a, b, 0.5) for a, b in edges]).persist()
    adjacency = {}
    for a, b in edges:
        adjacency.setdefault(a, []).append(b)
        adjacency.setdefault(b, []).append(a)
    for start in ([0, 1, 2], [5, 5, 9, 30], [39]):
        for depth, cap in ((2, 2 * len(start)), (3, 15)):
            got = {r.node for r in graph.expand_capped(g, seeds(spark, *start), depth, cap).collect()}
            assert got == plain_expansion(adjacency, start, depth, cap)


@pytest.mark.parametrize("state, usage, entropy, connections, to", [("Stem", 5, 0.3, 3, "Progenitor"), ("Stem", 2, 0.3, 1, "Stem"), ("Progenitor", 10, 0.2, 5, "Specialized"), ("Progenitor", 10, 0.2, 2, "Progenitor"), ("Progenitor", 1, 0.95, 0, "Apoptosis")])
def test_transitions(spark, state, usage, entropy, connections, to):
    n = spark.createDataFrame([(state, usage, entropy, connections)], "state string, usage_count int, entropy double, connections int")
    assert lifecycle.process(n).first().state == to


def test_dead_nodes_are_errors(spark):
    n = spark.createDataFrame([("Apoptosis", 5, 0.1, 1)], "state string, usage_count int, entropy double, connections int")
    assert "Apoptosis" in lifecycle.process(n).first().error


def test_deposit(spark):
    d = spark.createDataFrame([(1, 1, 2, 0.5), (2, 3, 4, 20.0), (3, 3, 4, -1.0)], "seq bigint, src bigint, dst bigint, amount double")
    assert {(r.src, r.level) for r in pheromone.deposit(None, d).collect()} == {(1, 1.5), (3, 9.0)}
    with pytest.raises(ValueError):
        pheromone.evaporated(F.lit(1.0), 1.5)


DAG = {1: [(2, 1.0), (3, 2.0)], 2: [(4, 1.0), (3, 1.5)], 3: [(4, 0.5)]}


def test_colony():
    found = colony.colony(1, DAG, colony.Settings())
    assert found["path"] == [1, 2, 4] and found["cost"] == 2.0 and found["iterations"] == 3
    assert abs(found["levels"][1, 2] - 1.9485) < 1e-4


def test_uniform():
    draw = colony.Uniform(42)
    assert [draw() for _ in range(3)] == pytest.approx([0.9816470927459511, 0.3702714420556768, 0.40735701052495726], abs=1e-15)


def test_index_search_like_plain_walks(spark, monkeypatch):
    """Neither vectors nor links are gathered, so no size refuses them or cuts them off."""
    monkeypatch.setattr(colony, "MAX_GRAPH_ROWS", 50)
    rng = np.random.default_rng(9)
    m = {3 * i: rng.normal(size=4) for i in range(60)}
    links = sorted({(max(a, b), min(a, b)) for a, b in rng.integers(0, 60, (150, 2)).tolist() if a != b})
    edges = spark.createDataFrame([(3 * a, 3 * b, 0.1 + (a * b % 9) / 10, 1.0 + a % 3) for a, b in links], "src bigint, dst bigint, distance double, pheromone double")
    data = vectors(spark, [(i, v.tolist()) for i, v in m.items()])
    found = colony.index_search(data, edges, data.where("id < 12").withColumnRenamed("id", "request_id"), 4, ants=5, steps=6).collect()
    paths = []
    for ant in range(5):
        draw = colony.Uniform(42 + ant)
        path = [3 * int(draw() * 60)]
        while len(path) < 6:
            ends = sorted((y, d, p) for a, b, d, p in edges.collect() for x, y in ((a, b), (b, a)) if x == path[-1] and y not in path)
            if not ends:
                break
            sums = np.cumsum([p / (1 + d) ** 2 for _, d, p in ends])
            path.append(ends[int(np.searchsorted(sums, draw() * sums[-1]))][0])
        paths.append(path)
    cos = lambda a, b: float(m[a] @ m[b] / np.linalg.norm(m[a]) / np.linalg.norm(m[b]))
    for q in range(0, 12, 3):
        best = {max(path, key=lambda x: cos(q, x)) for path in paths}
        assert [r.id for r in sorted(found, key=lambda r: r["rank"]) if r.request_id == q] == sorted(best, key=lambda x: -cos(q, x))[:4]


@pytest.mark.parametrize("search", ["explore_all", "best_paths"])
def test_graph_too_large_to_send(spark, monkeypatch, search):
    """Step by step over the graph's own rows: the same walks; a hub's entries span batches."""
    rng = np.random.default_rng(10)
    ends = {(0, int(x)) for x in range(1, 30)} | {tuple(x) for x in rng.integers(0, 30, (90, 2)).tolist() if x[0] != x[1] and x[0] != 7}
    edges = spark.createDataFrame([(a, b, 0.2 + (a * 7 + b) % 11, b) for a, b in ends], "src bigint, dst bigint, weight double, adj_pos bigint")
    starts = spark.createDataFrame([(0,), (7,), (5,), (5,), (99,)], "start bigint")
    run = lambda: sorted(map(repr, getattr(colony, search)(starts, edges, colony.Settings(ants=3, iterations=4, max_steps=5)).collect()))
    sent = run()
    monkeypatch.setattr(colony, "MAX_GRAPH_ROWS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert run() == sent and len(sent) == (15 if search == "explore_all" else 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_classifier(spark):
    own = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "pattern_idx int, vector array<double>")
    found = {r.id: r for r in immune.classify(vectors(spark, [(1, [1.0, 0.05]), (2, [-1.0, -1.0]), (3, [1.0])]), own).collect()}
    assert (found[1].label, found[2].label, found[3].label) == ("Self", "NonSelf", "NonSelf")
    assert immune.classify(vectors(spark, TRIO), own.limit(2)).first().confidence == 0.5


def test_nearest_pattern(spark):
    p = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [10.0, 0.0])], "pattern_idx int, vector array<double>")
    assert retrieval.nearest(vectors(spark, [(1, [0.9, 0.0])]), p).first().pattern_idx == 1


def test_expiry(spark):
    day = immune.DAY_MS
    d = spark.createDataFrame([(0,), (day,)], "seen bigint")
    assert [r[0] for r in d.select(immune.expired(F.col("seen"), 91 * day)).collect()] == [True, False]


def test_amplifier(spark):
    t = spark.createDataFrame([(1, 0, 0, "Low"), (2, 0, 0, "Critical"), (3, 0, 0, "Low"), (3, 2, 1, "Low"), (4, 0, 0, "High"), (4, 0, 1, "High")], "context bigint, cycle bigint, seq bigint, severity string")
    assert {r.context: r.level for r in immune.amplify(t).collect()} == {1: 3, 2: 10, 3: 4, 4: 10}


def test_regulation(spark):
    m = spark.createDataFrame([(10.0, 0.01, 0.5, 2.0, 0.5), (10.0, 0.01, 0.5, 2.0, 0.95), (200.0, 0.01, 0.5, 2.0, 0.5), (10.0, 0.01, 0.5, 20.0, 0.5), (10.0, 0.01, 0.1, 2.0, 0.5)], "latency_p95_ms double, error_rate double, pheromone_entropy double, anomaly_rate double, resource_utilization double")
    assert [r[0] for r in m.select(regulation.action()).collect()] == ["None", "CircuitBreak", "ReduceLoad", "TightenSecurity", "IncreaseExploration"]
    many = m.where("latency_p95_ms > 100").crossJoin(spark.range(100)).withColumns({"engine": F.lit(1), "seq": F.col("id")})
    assert regulation.regulate(many).first().detection_threshold == 0.95


def test_memory(spark):
    s = spark.createDataFrame([([100.0] * 8, 0, 0.15, 100.0), ([100.0] * 8, 0, 0.95, 100.0)], "modes array<double>, then bigint, alpha double, cached double")
    month = F.lit(30 * immune.DAY_MS)
    slow, fast = (r[0] for r in s.select(memory_kernel.peek(F.col("modes"), F.col("then"), F.col("alpha"), F.col("cached"), month)).collect())
    assert slow == pytest.approx(53.586, abs=1e-2) and fast == pytest.approx(0.03265, abs=1e-4)


def test_fast_exponential(spark):
    d = spark.range(0, 201).select((F.col("id") / 10).alias("x"))
    assert d.where(F.abs(memory_kernel.exp_neg(F.col("x")) / F.exp(-F.col("x")) - 1) > 0.005).count() == 0


def test_payload_hash(spark):
    d = spark.createDataFrame([(bytearray(b"hello world, this is long enough to wrap"),), (bytearray(b""),)], "p binary")
    want = []
    for text in (b"hello world, this is long enough to wrap", b""):
        h = 0
        for b in text:
            h = (h * 31 + b) % 2**64
        want.append(h)
    assert [int(r[0]) for r in d.select(action.hash_codes(action.byte_values(F.col("p")))).collect()] == want


def test_log(spark, tmp_path):
    w = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "a", "y"), (3, 3, "b", "z")], "seq bigint, timestamp_ms bigint, key string, data string")
    storage.append(storage.entries(w), f"{tmp_path}/log")
    log = storage.replay(spark, f"{tmp_path}/log")
    assert {(r.key, r.data) for r in storage.latest(log).collect()} == {("a", "y"), ("b", "z")}
    assert storage.entries(w.limit(1).withColumn("data", F.lit("hello"))).first().checksum == 907060870
    broken = log.withColumn("checksum", F.when(F.col("seq") == 2, 0).otherwise(F.col("checksum")))
    assert {(r.key, r.data) for r in storage.recover(broken).collect()} == {("a", "x"), ("b", "z")}


def test_packets(spark):
    good = storage.encode_packet("12345678-1234-5678-1234-567812345678", 7, "AntigenSync", 99, b"pay")
    d = spark.createDataFrame([(bytearray(good),), (bytearray(good[:20]),), (bytearray(b"\x04" + good[1:]),), (bytearray(good[:21] + b"\x09" + good[22:]),)], "packet binary")
    rows = storage.decode_packets(d).collect()
    assert (rows[0].node_id, rows[0].sequence_number, rows[0].message_type, int(rows[0].causal_watermark), bytes(rows[0].payload)) == ("12345678-1234-5678-1234-567812345678", 7, "AntigenSync", 99, b"pay")
    assert [r.error for r in rows] == [None, "packet too short", "invalid magic byte", "unknown message type: 0x09"]


def test_pipeline_errors(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, [-1.0, -1.0])], "request_id bigint, vector array<double>")
    edges = graph_of(spark, [(1, 3, 0.7)])
    found = {r.request_id: r for r in pipeline.run(vectors(spark, TRIO), asked, edges, k=2).collect()}
    assert found[1].error is None and found[1].hits == 2 and found[1].nodes == 6
    assert found[2].error.startswith("validate") and found[3].error == "execute: empty payload"


def test_detect_counts_calls(spark):
    """Repeated ids are judged one by one; without patterns all is odd; other dimensions fail."""
    own = spark.createDataFrame([(0, [0.0, 0.0])], "pattern_idx int, vector array<double>")
    calls = spark.createDataFrame([(1, 7, [0.0, 0.0]), (2, 7, [5.0, 1.0])], "seq int, id bigint, vector array<double>")
    assert [round(r.min_distance, 3) for r in immune.detect(calls, own).orderBy("seq").collect()] == [0.0, 5.099]
    none = immune.detect(calls, own.where("false")).collect()
    assert [(r.min_distance, r.closest_pattern_idx, r.score, r.is_anomaly, r.fpr) for r in none] == [(float("inf"), -1, 1.0, True, 0.0)] * 2
    with pytest.raises(Exception, match="dimension mismatch"):
        immune.detect(spark.createDataFrame([(1, 7, [0.0])], "seq int, id bigint, vector array<double>"), own).collect()


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_QUERY_BYTES", 100)
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(40)]
    p = spark.createDataFrame([(i, v) for i, v in rows if i < 20] + [(99, [1.0])], "pattern_idx int, vector array<double>")
    found = {r.id: (r.pattern_idx, r.distance) for r in retrieval.with_nearest(vectors(spark, [*rows, (77, [3.0]), (78, [1.0, 2.0, 3.0])]), p).collect()}
    for i, v in rows:
        want = min((((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2) ** 0.5, j) for j, w in rows if j < 20)
        assert found[i] == (want[1], want[0])
    assert found[77] == (99, 2.0) and found[78] == (None, None)


def test_mutations_like_plain_draws(spark):
    v = spark.createDataFrame([(3, [1.0, 2.0, 3.0]), (4, [0.5]), (5, [])], "id bigint, vector array<double>")
    got = {(r.id, r.variant_no): (r.variant, r.score) for r in immune.mutations(v, n=3, fitness=lambda x: float(x.sum())).collect()}
    for i, vector in ((3, [1.0, 2.0, 3.0]), (4, [0.5]), (5, [])):
        draw = immune._Shift((42 + i * 0x9E3779B97F4A7C15) % (1 << 64) or 1)
        for k in range(3):
            want = [x + draw.normal() * 0.05 for x in vector]
            assert np.allclose(got[i, k][0], want, atol=1e-12) and abs(got[i, k][1] - sum(want)) < 1e-12


def test_sql_functions_like_columns(spark):
    from spindrel.functions import vector as V
    from spindrel.operators import memory_kernel

    V.register(spark)
    rows = [([1.0, 2.0], [2.0, 1.0], 0.5), ([1.0], [1.0, 2.0], 88.0), ([0.0], [1.0], -3.0), ([float("nan")], [1.0], 700.0), ([], [], 1e-9)]
    f = spark.createDataFrame(rows, "a array<double>, b array<double>, x double")
    both = f.select(F.expr("cos_sim(a, b)"), V.cosine(F.col("a"), F.col("b")), F.expr("l2_dist(a, b)"), V.l2(F.col("a"), F.col("b")), F.expr("exp_neg_fast(x)"), memory_kernel.exp_neg(F.col("x"))).collect()
    for r in both:
        assert all(repr(r[i]) == repr(r[i + 1]) for i in (0, 2, 4)), r


def test_breaker_states(spark):
    """Closed, open, half-open and back, against a plain fold."""
    rng = __import__("random").Random(3)
    rows, ms = [], 0
    for i in range(400):
        ms += rng.choice([500, 2_000, 9_000, 31_000])
        rows.append((f"s{i % 3}", i, ms, rng.random() < (0.6 if (i // 60) % 2 else 0.05)))
    got = {r.seq: (r.state, r.allowed) for r in regulation.breaker_states(spark.createDataFrame(rows, "service string, seq bigint, ms bigint, failed boolean"), key="service").collect()}
    for service in ("s0", "s1", "s2"):
        state, opened, log = "Closed", None, []
        for s, seq, ms, failed in rows:
            if s != service:
                continue
            if state == "Open" and ms - opened >= 30_000:
                state = "HalfOpen"
            assert got[seq] == (state, state != "Open")
            if state == "Open":
                continue
            log = [(t, f) for t, f in log if t > ms - 60_000] + [(ms, failed)]
            if not failed and state == "HalfOpen":
                state, log = "Closed", [(t, f) for t, f in log if not f]
            elif failed and len(log) >= 5 and sum(f for _, f in log) > 0.2 * len(log):
                state, opened = "Open", ms
    assert {s for s, _ in got.values()} == {"Closed", "Open", "HalfOpen"}
