"""Exact cosine retrieval: one query, a batch of queries, and all pairs within a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions import vector as V

#: A batch of queries is broadcast up to so many bytes; more go block after block.
MAX_QUERY_BYTES = 64 << 20
#: Pairs that are compared at once, in a task; queries from which rows are dealt to all cores.
TILE, MANY = 1 << 18, 512
#: How far a cosine from a product of matrices may be off.
NEARLY = 1e-9


def dataset(df: DataFrame, id_column: str, vector_column: str, dimension: int | None = None) -> DataFrame:
    """(id, vector): rows with an empty vector, or of another dimension, are refused (left out)."""
    out = df.select(F.col(id_column).cast("bigint").alias("id"), V.doubles(vector_column).alias("vector"))
    return out.where(F.size("vector") == dimension if dimension else F.size("vector") > 0)


def check_query(query: list[float], top_k: int, dimension: int | None = None) -> str | None:
    """Why a query is refused, or None."""
    if not query:
        return "empty query vector"
    if top_k <= 0:
        return "top_k must be positive"
    if not np.isfinite(query).all():
        return "query vector is not finite"
    return "dimension mismatch" if dimension and len(query) != dimension else None


def refusal(vector: Column, top_k: Column | int, dimension: int | None = None) -> Column:
    """Why a request is refused, or null: the rules of :func:`check_query` as an expression."""
    k = F.lit(top_k) if isinstance(top_k, int) else top_k
    why = F.when(F.coalesce(F.size(vector), F.lit(0)) <= 0, "empty query vector").when(k <= 0, "top_k must be positive").when(~V.finite(vector), "query vector is not finite")
    return why.when(F.size(vector) != dimension, "dimension mismatch") if dimension else why


def refused(queries: DataFrame, k: int, dimension: int | None = None) -> DataFrame:
    """(request_id, error) of the requests that :func:`batch_top_k` has no answer for."""
    return queries.select("request_id", refusal(F.col("vector"), k, dimension).alias("error")).where("error is not null")


def score(data: DataFrame, query: list[float], *, weight: float = 1.0, threshold: float = 0.1) -> DataFrame:
    """(id, score, cosine_score) of vectors with a score of the threshold or more."""
    given = F.array(*[F.lit(float(x)) for x in query])
    return data.select("id", V.cosine(F.col("vector"), given).alias("cosine_score")).where(F.col("cosine_score").isNotNull()).select("id", (weight * F.col("cosine_score")).alias("score"), "cosine_score").where(F.col("score") >= threshold)


def top_k(data: DataFrame, query: list[float], k: int, *, weight: float = 1.0, threshold: float = 0.1) -> DataFrame:
    """The best k by score, then id: one pass, and k rows a task are merged."""
    if why := check_query(query, k):
        raise ValueError(why)
    return score(data, query, weight=weight, threshold=threshold).orderBy(F.desc("score"), "id").limit(k)


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the dimension as a matrix, and which rows they are."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(sizes == dimension)
    chosen = column if len(keep) == len(column) else column.take(pa.array(keep))
    return np.asarray(chosen.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dimension), keep


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (zero rows stay), and which rows are finite."""
    good = np.isfinite(m).all(1)
    size = np.sqrt((m * m).sum(1))
    with np.errstate(invalid="ignore"):
        return m / np.where(size > 0, size, 1)[:, None], good


def _spread(data: DataFrame, asked: int) -> DataFrame:
    """``data`` over all cores where each row meets many queries: a small file is one task else."""
    return data.repartition(data.sparkSession.sparkContext.defaultParallelism) if asked >= MANY else data


def _blocks(queries: DataFrame, more: int = 0) -> tuple[int, list[DataFrame]]:
    """How many queries there are, and blocks of them of ``MAX_QUERY_BYTES`` at most; ``more``: the
    bytes that a task keeps for each query besides."""
    size, n = queries.agg(F.sum(F.size("vector") * 8 + 16 + more), F.count(F.lit(1))).first()
    blocks = max(1, -(-int(size or 0) // MAX_QUERY_BYTES))
    return n, [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == b) for b in range(blocks)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _collected(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a block of queries by their dimension, as arrays all the way."""
    rows = queries.where(F.size("vector") > 0).select("request_id", "vector").toArrow()  # under MAX_QUERY_BYTES
    ids, vectors = rows.column("request_id").to_numpy(), rows.column("vector").combine_chunks()
    out = {}
    for size in np.unique(pc.list_value_length(vectors).to_numpy(zero_copy_only=False)).tolist():
        m, of = _matrix(vectors, size)
        out[size] = ids[of], m
    return out


def _tiles(rows: int, columns: int) -> Iterator[tuple[slice, slice]]:
    """Rows by columns in tiles of ``TILE`` pairs at most."""
    wide = min(columns, TILE // 256)
    high = TILE // max(wide, 1)
    for j in range(0, columns, max(wide, 1)):
        for i in range(0, rows, high):
            yield slice(i, i + high), slice(j, j + wide)


def cosines(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in the order of the elements: equal vectors have equal cosines
    wherever they stand, which a product of matrices does not promise."""
    out = np.empty(len(one))
    for i in range(0, len(one), 1 << 15):
        x, y = one[i : i + (1 << 15)], two[i : i + (1 << 15)]
        dot, a, b = (np.cumsum(v, axis=1)[:, -1] for v in (x * y, x * x, y * y))
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            scale = np.sqrt(a * b)
            scale = np.where((scale > 0) & (scale < np.inf), scale, np.sqrt(a) * np.sqrt(b))
            out[i : i + (1 << 15)] = np.clip(np.where(scale > 0, dot / scale, 0), -1, 1)
    return out


class _Best:
    """The best k (score, then id) of each query among the rows seen so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def least(self, of: slice) -> np.ndarray:
        return self.score[of, -1]

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(of)
        known = self.score[touched].ravel()
        of = np.concatenate([np.repeat(touched, self.k), of])
        score, ids = np.concatenate([known, score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = rank < self.k
        self.score[of[keep], rank[keep]], self.id[of[keep], rank[keep]] = score[keep], ids[keep]

    def rows(self, requests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(requests), step := max(1, TILE // self.k)):
            of, at = np.nonzero(self.score[i : i + step] > -np.inf)
            yield requests[i + of], self.id[i + of, at], self.score[i + of, at]


_PAIR = ["request_id", "id", "score"]


def batch_scores(data: DataFrame, queries: DataFrame, *, threshold: float = 0.1, k: int | None = None) -> DataFrame:
    """(request_id, id, score) of every query (request_id, vector) against every vector.

    The queries, checked in size, are one matrix that each task multiplies its vectors with, tile
    by tile; only pairs above the threshold, or the task's best ``k`` of a request, leave Python.
    """
    n, blocks = _blocks(queries, 16 * (k or 0))
    data = _spread(data, n)
    return _union([_block(data, block, threshold, k) for block in blocks])


def _block(data: DataFrame, queries: DataFrame, threshold: float, k: int | None) -> DataFrame:
    by_size = {}
    for size, (requests, m) in _collected(queries).items():
        unit, good = _unit(m)
        by_size[size] = requests[good], m[good], unit[good]
    sent = data.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: _Best(len(requests), k) for size, (requests, _, _) in sent.value.items()} if k else {}
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for size, (requests, asked, q) in sent.value.items():
                m, rows_of = _matrix(batch.column("vector"), size)
                unit, good = _unit(m)
                m, unit, own = m[good], unit[good], ids[rows_of[good]]
                for rows, of in _tiles(len(own), len(requests)):
                    scores = unit[rows] @ q[of].T
                    # What the product leaves open is decided by the sums in order.
                    floor = np.maximum(best[size].least(of), threshold) if k else threshold
                    hit = scores >= floor - NEARLY
                    if k and len(scores) > k and np.count_nonzero(hit) > 4 * k * scores.shape[1]:
                        hit &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] - NEARLY
                    at, to = np.nonzero(hit)
                    for i in range(0, len(at), 1 << 18):
                        x, y = at[i : i + (1 << 18)] + rows.start, to[i : i + (1 << 18)] + of.start
                        exact = np.concatenate([cosines(m[x[j : j + (1 << 15)]], asked[y[j : j + (1 << 15)]]) for j in range(0, len(x), 1 << 15)])
                        x, y, exact = x[keep := exact >= threshold], y[keep], exact[keep]
                        if k and len(x):
                            best[size].add(y, exact, own[x])
                        elif len(x):
                            yield pa.RecordBatch.from_arrays([pa.array(requests[y]), pa.array(own[x]), pa.array(exact)], names=_PAIR)
        for size, found in best.items():
            for columns in found.rows(sent.value[size][0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PAIR)

    return data.select("id", "vector").mapInArrow(run, "request_id bigint, id bigint, score double")


def batch_top_k(data: DataFrame, queries: DataFrame, k: int, *, threshold: float = 0.1) -> DataFrame:
    """(request_id, rank, id, score): the best k of each request by score, then id; requests that
    :func:`refused` names have none."""
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    ranked = batch_scores(data, queries, threshold=threshold, k=k).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("request_id", "rank", "id", "score")


def batch_distances(data: DataFrame, queries: DataFrame) -> DataFrame:
    """(request_id, id, distance): every query (request_id, vector) and every vector of its
    dimension, by Euclidean distance.  Nothing is joined: each task measures its vectors against
    the queries, which are sent along as in :func:`batch_scores`."""
    n, blocks = _blocks(queries)
    data = _spread(data, n)
    return _union([_far(data, block) for block in blocks])


def _far(data: DataFrame, queries: DataFrame) -> DataFrame:
    sent = data.sparkSession.sparkContext.broadcast({size: (requests, np.ascontiguousarray(m.T)) for size, (requests, m) in _collected(queries).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for size, (requests, q) in sent.value.items():
                m, rows_of = _matrix(batch.column("vector"), size)
                for rows, of in _tiles(len(m), len(requests)):
                    total = np.zeros((len(m[rows]), len(requests[of])))
                    for x, y in zip(m[rows].T, q[:, of]):
                        total += (x[:, None] - y) ** 2
                    pairs = np.tile(requests[of], len(total)), np.repeat(ids[rows_of[rows]], total.shape[1]), np.sqrt(total).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], names=["request_id", "id", "distance"])

    return data.select("id", "vector").mapInArrow(run, "request_id bigint, id bigint, distance double")


def all_pairs(data: DataFrame, *, threshold: float, block: int = 4096) -> DataFrame:
    """(a, b, score), a < b, of all pairs with a cosine of the threshold or more.

    Exact, so quadratic: vectors are dealt into blocks, each pair of blocks is one group, and a
    group holds two blocks at most.
    """
    n = data.count()
    blocks = max(4, -(-n // block))
    dealt = data.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def compare(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        own, ids = table.column("own").to_numpy(), table.column("id").to_numpy()
        vectors = table.column("vector").combine_chunks()
        found = []
        for size in set(pc.list_value_length(vectors).to_pylist()) - {None, 0}:
            m, rows_of = _matrix(vectors, size)
            unit, good = _unit(m)
            unit, rows = unit[good], rows_of[good]
            left, right = rows[own[rows] == i], rows[own[rows] == j]
            place = np.full(len(ids), -1)
            place[rows] = np.arange(len(rows))
            at, of = np.nonzero((s := unit[place[left]] @ unit[place[right]].T) >= threshold)
            a, b, v = ids[left[at]], ids[right[of]], s[at, of]
            keep = (a < b) if i == j else (a != b)
            found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], v[keep]))
        a, b, v = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(v, pa.float64())})

    return meets.groupBy("i", "j").applyInArrow(compare, "a bigint, b bigint, score double")


def with_nearest(data: DataFrame, patterns: DataFrame) -> DataFrame:
    """``data`` with pattern_idx and distance: the nearest pattern (pattern_idx, vector) of its
    dimension, the lowest index on ties; nulls where no pattern has its dimension.

    Rows count one by one, whatever their ids, and are not shuffled.  Patterns are sent along up
    to ``MAX_QUERY_BYTES``, more of them block after block.
    """
    size = patterns.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // MAX_QUERY_BYTES))
    index = patterns.schema["pattern_idx"].dataType
    out = data.withColumns({"pattern_idx": F.lit(None).cast(index), "distance": F.lit(None).cast("double")})
    for block in range(blocks):
        out = _nearer(out, patterns if blocks == 1 else patterns.where(F.pmod(F.xxhash64("pattern_idx"), F.lit(blocks)) == block))
    return out


def _nearer(data: DataFrame, patterns: DataFrame) -> DataFrame:
    rows = patterns.where(F.size("vector") > 0).select("pattern_idx", "vector").orderBy("pattern_idx").collect()  # under MAX_QUERY_BYTES
    by_size = {n: (np.array([r["pattern_idx"] for r in rows if len(r["vector"]) == n], np.int64), np.array([r["vector"] for r in rows if len(r["vector"]) == n], float)) for n in {len(r["vector"]) for r in rows}}
    sent = data.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            best = pc.fill_null(batch.column("distance"), np.inf).to_numpy(zero_copy_only=False).copy()
            at = pc.fill_null(batch.column("pattern_idx"), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for size, (indexes, known) in sent.value.items():
                m, of = _matrix(batch.column("vector"), size)
                step = max(1, (8 << 20) // known.size)
                for i in range(0, len(m), step):
                    far = np.sqrt(((m[i : i + step, None, :] - known) ** 2).sum(2))
                    least, row = far.argmin(1), of[i : i + step]
                    d, j = far[np.arange(len(far)), least], indexes[least]
                    nearer = (at[row] < 0) | (d < best[row]) | ((d == best[row]) & (j < at[row]))
                    best[row[nearer]], at[row[nearer]] = d[nearer], j[nearer]
            none = at < 0
            new = {"pattern_idx": pa.array(at, mask=none).cast(batch.schema.field("pattern_idx").type), "distance": pa.array(best, mask=none)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return data.mapInArrow(run, data.schema)


def nearest(data: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern_idx, distance) of each row that has a pattern of its dimension."""
    return with_nearest(data.select("id", "vector"), patterns).where("pattern_idx is not null").select("id", "pattern_idx", "distance")
