"""Ant walks over a weighted graph, with reproducible random numbers.

A colony is a sequential process from one start; many starts run in parallel, one group each.
A graph of up to ``MAX_GRAPH_ROWS`` entries is sent to every task.  A larger one stays where it
is: its nodes' entries are written as one row each, and all ants of all starts take a step at a
time, where the entries of the nodes they are at lie.  Both give the same walks.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.operators import retrieval
from spindrel.sources.storage import cut

_MASK = (1 << 64) - 1
MAX_GRAPH_ROWS = 2_000_000
#: Ants on their way are sent to the graph's rows up to so many bytes; more of them are joined.
MAX_ANT_BYTES = 64 << 20


class Uniform:
    """Numbers in [0, 1]: a 64-bit xorshift started by splitmix64."""

    def __init__(self, seed: int):
        z = (seed + 0x9E3779B97F4A7C15) & _MASK
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ z >> shift) * factor & _MASK
        self.state = (z ^ z >> 31) or 1

    def __call__(self) -> float:
        x = self.state
        x ^= x << 13 & _MASK
        x ^= x >> 7
        x ^= x << 17 & _MASK
        self.state = x
        return float(x) / float(_MASK)


@dataclass(frozen=True)
class Settings:
    ants: int = 5
    iterations: int = 10
    alpha: float = 1.0
    beta: float = 2.0
    max_steps: int = 20
    q: float = 1.0
    rho: float = 0.1
    variance: float = 0.05
    window: int = 5
    tau_min: float = 0.01
    tau_max: float = 10.0


class Graph:
    """Each node's entries in the order of ``adj_pos``, as flat arrays."""

    def __init__(self, src, dst, weight, adj_pos):
        order = np.lexsort((dst, adj_pos, src))
        self.nodes, self.at = np.unique(src[order], return_index=True)
        self.dst, self.weight = dst[order], weight[order]

    def get(self, node: int, default=()):
        i = int(np.searchsorted(self.nodes, node))
        if i == len(self.nodes) or self.nodes[i] != node:
            return default
        own = slice(self.at[i], self.at[i + 1] if i + 1 < len(self.at) else None)
        return self.dst[own], self.weight[own]


Adjacency = dict[int, list[tuple[int, float]]] | Graph


def step(path: list[int], to: np.ndarray, w: np.ndarray, level: dict, alpha: float, beta: float, draw: Uniform) -> tuple[int, float] | None:
    """One of the ends that the path has not met, by a roulette over level ** alpha * (1 / weight) ** beta."""
    new = ~(to[:, None] == np.array(path)).any(1)
    to, w = to[new], w[new]
    tau = np.ones(len(to))
    for (src, dst), x in level.items():
        if src == path[-1]:
            tau[to == dst] = x
    sums = np.cumsum(tau**alpha * np.divide(1, w, out=np.ones(len(w)), where=w > 0) ** beta)
    if not len(to) or not sums[-1]:
        return None
    at = min(int(np.searchsorted(sums, draw() * sums[-1])), len(to) - 1)
    return int(to[at]), float(w[at])


def walk(start: int, graph: Adjacency, level: dict, alpha: float, beta: float, max_steps: int, draw: Uniform) -> tuple[list[int], float]:
    """A path without revisits, and its cost."""
    path, cost = [start], 0.0
    while len(path) < max_steps and len(entries := graph.get(path[-1], ())):
        to, w = entries if isinstance(graph, Graph) else map(np.array, zip(*entries))
        if not (found := step(path, to, np.asarray(w, float), level, alpha, beta, draw)):
            break
        path.append(found[0])
        cost += found[1]
    return path, cost


def _weighings(s: Settings) -> list[tuple[float, float]]:
    """(alpha, beta) of each ant; ants differ in how they weigh level and length."""
    scales = [0.8 + 0.4 * (ant / max(s.ants, 1)) for ant in range(s.ants)]
    return [(s.alpha * x, s.beta * x) for x in scales]


def explore(start: int, graph: Adjacency, level: dict, s: Settings, seed: int):
    """Each ant's (path, cost, alpha, beta)."""
    for ant, (alpha, beta) in enumerate(_weighings(s)):
        yield *walk(start, graph, level, alpha, beta, s.max_steps, Uniform(seed + ant & _MASK)), alpha, beta


@dataclass
class Search:
    """How a colony's search stands."""

    path: list[int] = field(default_factory=list)
    cost: float = float("inf")
    stale: int = 0
    iterations: int = 0
    converged: bool = False
    progression: list[float] = field(default_factory=list)
    levels: dict[tuple[int, int], float] = field(default_factory=dict)

    def after(self, path: list[int], cost: float, s: Settings) -> Search:
        """After one more round, whose best path is given."""
        costs, best, best_cost, stale = [*self.progression, cost], self.path, self.cost, self.stale
        stale = 0 if cost < best_cost else stale + 1
        if cost < best_cost:
            best, best_cost = path, cost
        level = dict(self.levels)
        if best_cost > 0:
            for pair in zip(best, best[1:]):
                level[pair] = min(max(level.get(pair, 1.0) + s.q / best_cost, s.tau_min), s.tau_max)
        level = {pair: max(s.tau_min, x * (1 - s.rho)) for pair, x in level.items()}
        converged = len(costs[-s.window :]) >= 3 and float(np.var(costs[-s.window :])) < s.variance or stale >= s.window
        return Search(best, best_cost, stale, self.iterations + 1, converged, costs, level)


def colony(start: int, graph: Adjacency, s: Settings) -> dict:
    """The best path found, and how the search went."""
    found = Search()
    while found.iterations < s.iterations and not found.converged:
        path, cost, *_ = min(explore(start, graph, found.levels, s, 42 + found.iterations), key=lambda x: x[1])
        found = found.after(path, cost, s)
    return asdict(found) | {"cost": found.cost if found.path else 0.0, "used_fallback": not found.converged}


def adjacency(edges: DataFrame) -> Graph | None:
    """The graph (src, dst, weight, adj_pos) on the driver; None beyond ``MAX_GRAPH_ROWS``."""
    if edges.count() > MAX_GRAPH_ROWS:
        return None
    rows = edges.select("src", "dst", F.col("weight").cast("double"), "adj_pos").toArrow()
    return Graph(*[rows.column(c).to_numpy() for c in ("src", "dst", "weight", "adj_pos")])


# --- graphs that are not sent along --------------------------------------------------------

def _lists(edges: DataFrame) -> DataFrame:
    """(node, ends, weights), written: each node's entries in order, as bytes."""
    dealt = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), "adj_pos").repartition("src").sortWithinPartitions("src", "adj_pos", "dst")

    def rows(nodes, ends, weights):
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ends, pa.binary()), pa.array(weights, pa.binary())], names=["node", "ends", "weights"])

    def run(batches):
        node, ends, weights = None, [], []  # the one whose entries may go on in the next batch
        for batch in batches:
            src, dst, w = (batch.column(c).to_numpy() for c in ("src", "dst", "weight"))
            cuts = [0, *(np.flatnonzero(np.diff(src)) + 1).tolist(), len(src)]
            whole = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if src[a] != node:
                    if node is not None:
                        whole.append((node, b"".join(ends), b"".join(weights)))
                    node, ends, weights = int(src[a]), [], []
                ends.append(dst[a:b].tobytes())
                weights.append(w[a:b].tobytes())
            if whole:
                yield rows(*zip(*whole))
        if node is not None:
            yield rows([node], [b"".join(ends)], [b"".join(weights)])

    return cut(dealt.mapInArrow(run, "node bigint, ends binary, weights binary"))


_LEVELS = "array<struct<src:bigint,dst:bigint,level:double>>"
_ANT = f"start bigint, ant int, alpha double, beta double, levels {_LEVELS}, state bigint, path array<bigint>, cost double"
_SEARCH = f"start bigint, path array<bigint>, cost double, stale int, iterations int, converged boolean, progression array<double>, levels {_LEVELS}"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _steps(searches: DataFrame, lists: DataFrame, s: Settings, seed: int) -> DataFrame:
    """(start, ant, alpha, beta, path, cost): the ants of one round from (start, levels)."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    made = F.array(*[F.struct(F.lit(i).alias("ant"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(signed(Uniform(seed + i & _MASK).state)).cast("bigint").alias("state")) for i, (a, b) in enumerate(_weighings(s))])
    ants = searches.select("start", "levels", F.explode(made).alias("x")).select("start", "x.ant", "x.alpha", "x.beta", "levels", "x.state", F.array("start").alias("path"), F.lit(0.0).alias("cost"))
    kind = _arrow(_ANT)

    def run(batches):
        for batch in batches:
            ends, weights = batch.column("ends"), batch.column("weights")
            out = []
            for i, ant in enumerate(batch.select(kind.names).to_pylist()):
                draw = Uniform(0)
                draw.state = ant["state"] & _MASK
                level = {(x["src"], x["dst"]): x["level"] for x in ant["levels"]}
                found = step(ant["path"], np.frombuffer(ends[i].as_buffer(), np.int64), np.frombuffer(weights[i].as_buffer()), level, ant["alpha"], ant["beta"], draw)
                if found:
                    out.append(ant | {"path": [*ant["path"], found[0]], "cost": ant["cost"] + found[1], "state": draw.state - (1 << 64) if draw.state >> 63 else draw.state})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    walked = [now := cut(ants)]
    while len(walked) < s.max_steps and (n := now.count()):
        here = now.withColumn("node", F.element_at("path", -1))
        small = n * (200 + (8 + 24 * s.iterations) * s.max_steps) <= MAX_ANT_BYTES
        walked.append(now := cut(lists.join(F.broadcast(here) if small else here, "node").drop("node").mapInArrow(run, _ANT)))
    # An ant that could not go on is in no later table.
    every = reduce(DataFrame.unionByName, walked).withColumn("size", F.size("path"))
    return every.groupBy("start", "ant").agg(F.max_by(F.struct("alpha", "beta", "path", "cost"), "size").alias("x")).select("start", "ant", "x.*")


def _searches(starts: DataFrame, lists: DataFrame, s: Settings) -> DataFrame:
    """:func:`colony` from each start, all of them a round at a time."""
    kind = _arrow(_SEARCH)

    def row(start: int, x: Search) -> dict:
        return {"start": start, **asdict(x), "levels": [{"src": a, "dst": b, "level": v} for (a, b), v in x.levels.items()]}

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                best = min(r.pop("ants"), key=lambda x: (x["cost"], x["ant"]))
                start, levels = r.pop("start"), {(x["src"], x["dst"]): x["level"] for x in r.pop("levels")}
                out.append(row(start, Search(**r, levels=levels).after(best["path"], best["cost"], s)))
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    none = Search()
    new = [F.array().cast("array<bigint>").alias("path"), F.lit(none.cost).alias("cost"), F.lit(0).alias("stale"), F.lit(0).alias("iterations"), F.lit(False).alias("converged"), F.array().cast("array<double>").alias("progression"), F.array().cast(_LEVELS).alias("levels")]
    going, ended = cut(starts.select("start").distinct().select("start", *new)), []
    for i in range(s.iterations):
        ants = _steps(going, lists, s, 42 + i).groupBy("start").agg(F.collect_list(F.struct("ant", "path", "cost")).alias("ants"))
        now = cut(going.join(ants, "start").mapInArrow(run, _SEARCH))
        ended.append(now.where("converged") if i + 1 < s.iterations else now)
        going = now.where("not converged")
        if going.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended) if ended else going


def best_paths(starts: DataFrame, edges: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(start, path, cost, iterations, converged, used_fallback) for each start, in parallel."""
    graph = adjacency(edges)
    if graph is None:
        found = _searches(starts, _lists(edges), s)
        return starts.select("start").join(found, "start").select("start", "path", "cost", "iterations", "converged", (~F.col("converged")).alias("used_fallback"))
    sent = starts.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        for batch in batches:
            ids = batch.column("start").to_pylist()
            found = [colony(x, sent.value, s) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f["path"] for f in found], pa.list_(pa.int64())), pa.array([f["cost"] for f in found], pa.float64()), pa.array([f["iterations"] for f in found], pa.int32()), pa.array([f["converged"] for f in found]), pa.array([f["used_fallback"] for f in found])], names=["start", "path", "cost", "iterations", "converged", "used_fallback"])

    return starts.select("start").repartition("start").mapInArrow(run, "start bigint, path array<bigint>, cost double, iterations int, converged boolean, used_fallback boolean")


def explore_all(starts: DataFrame, edges: DataFrame, s: Settings = Settings(), seed: int = 42) -> DataFrame:
    """(start, ant_id, path, cost, alpha, beta): one round of ants from each start."""
    graph = adjacency(edges)
    if graph is None:
        fresh = starts.select("start").distinct().withColumn("levels", F.array().cast(_LEVELS))
        return starts.select("start").join(_steps(fresh, _lists(edges), s, seed), "start").select("start", F.col("ant").alias("ant_id"), "path", "cost", "alpha", "beta")
    sent = starts.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        for batch in batches:
            rows = [(x, i, *a) for x in batch.column("start").to_pylist() for i, a in enumerate(explore(x, sent.value, {}, s, seed))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.float64()))], names=["start", "ant_id", "path", "cost", "alpha", "beta"])

    return starts.select("start").repartition("start").mapInArrow(run, "start bigint, ant_id int, path array<bigint>, cost double, alpha double, beta double")


def index_edges(data: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, distance, pheromone): a node links to the near ones that came before it;
    'distance' is the cosine, as the walk's heuristic takes it."""
    return pairs.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"), F.col("score").alias("distance"), F.lit(1.0).alias("pheromone"))


def index_search(data: DataFrame, edges: DataFrame, queries: DataFrame, k: int, *, ants: int = 10, steps: int = 10, seed: int = 42, alpha: float = 1.0, beta: float = 2.0, invert: bool = False) -> DataFrame:
    """(request_id, rank, id, score): an approximate search by seeded walks over the index.

    Ant i of a request starts at the node that the first draw of seed + i picks; a step weighs
    1 / (1 + distance) (``invert``: distance itself); each ant brings its best cosine.
    """
    draws = [Uniform(seed + ant) for ant in range(ants)]
    walks = [[x] for x in _ids_at(data, [draw() for draw in draws])]
    # Walks do not depend on the request.  Only the entries of the nodes where the ants are get read.
    links = cut(edges.select("src", "dst", "distance", "pheromone"))
    going = list(range(len(walks)))
    for _ in range(steps - 1):
        here = [(ant, walks[ant][-1], walks[ant], draws[ant]()) for ant in going]
        if not here:
            break
        nodes = list({x[1] for x in here})
        near = links.where(F.col("src").isin(nodes) | F.col("dst").isin(nodes))
        both = near.select(F.explode(F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("to")) for a, b in (("src", "dst"), ("dst", "src"))])).alias("x"), "distance", "pheromone").select("x.*", "distance", "pheromone")
        at = F.broadcast(data.sparkSession.createDataFrame(here, "ant int, node bigint, path array<bigint>, u double"))
        open_ = both.join(at, "node").where(~F.array_contains("path", F.col("to"))).select("ant", "to", "distance", "pheromone", "u")

        def choose(group):
            to, d, p = (group.column(c).to_numpy() for c in ("to", "distance", "pheromone"))
            order = np.lexsort((p, d, to))
            to, d, p = to[order], d[order], p[order]
            sums = np.cumsum(p**alpha * (d if invert else 1 / (1 + d)) ** beta)
            place = min(int(np.searchsorted(sums, group.column("u")[0].as_py() * sums[-1])), len(to) - 1)
            return pa.table({"ant": group.column("ant")[:1], "to": pa.array(to[place : place + 1])})

        moved = {r["ant"]: r["to"] for r in open_.groupBy("ant").applyInArrow(choose, "ant int, to bigint").collect()}
        for ant, to in moved.items():
            walks[ant] = [*walks[ant], to]
        going = sorted(moved)
    rows = data.where(F.col("id").isin(list({x for path in walks for x in path}))).collect()
    sent = data.sparkSession.sparkContext.broadcast((walks, {r["id"]: i for i, r in enumerate(rows)}, np.array([r["vector"] for r in rows], float)))

    def run(batches):
        walks, place, matrix = sent.value
        for batch in batches:
            out = []
            for request, vector in zip(batch.column("request_id").to_pylist(), batch.column("vector").to_pylist()):
                near = retrieval.cosines(matrix, np.broadcast_to(np.array(vector, float), matrix.shape)) if walks else []
                best: dict[int, float] = {}
                for path in walks:
                    node = max(path, key=lambda x: (near[place[x]], -x))
                    best[node] = float(near[place[node]])
                out += [(request, i + 1, n, s) for i, (n, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["request_id", "rank", "id", "score"])

    return queries.select("request_id", "vector").mapInArrow(run, "request_id bigint, rank int, id bigint, score double")


def _ids_at(data: DataFrame, shares: list[float]) -> list[int]:
    """The ids at these shares (0 to 1) of all ids in order; none without rows."""
    placed = cut(data.select("id").orderBy("id").select("id", F.monotonically_increasing_id().alias("place")))
    # A place is a partition, in the upper bits, and a row of it.
    parts = sorted(tuple(r) for r in placed.groupBy(F.shiftright("place", 33)).count().collect())
    ends = np.cumsum([n for _, n in parts])
    if not parts:
        return []
    places = []
    for share in shares:
        rank = min(int(share * ends[-1]), int(ends[-1]) - 1)
        i = int(np.searchsorted(ends, rank, side="right"))
        places.append((parts[i][0] << 33) + rank - int(ends[i]) + parts[i][1])
    found = {r["place"]: r["id"] for r in placed.where(F.col("place").isin(places)).collect()}
    return [found[x] for x in places]


def uniform_sequence(spark: SparkSession, seeds: int, n: int) -> DataFrame:
    """(seed, i, u): the first n numbers of seeds 0 ... seeds - 1."""

    def run(batches):
        for batch in batches:
            rows = [(s, i, u) for s in batch.column("id").to_pylist() for draw in [Uniform(s)] for i in range(n) for u in [draw()]]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], names=["seed", "i", "u"])

    return spark.range(seeds).mapInArrow(run, "seed bigint, i int, u double")
