"""Anomaly detection and self / non-self classification against pattern sets."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators.retrieval import with_nearest

DAY_MS = 86_400_000
#: What each severity multiplies the boost by (fixed values).
MULTIPLIER = {"Low": 1.5, "Medium": 2.0, "High": 3.0, "Critical": 5.0}


def detect(calls: DataFrame, patterns: DataFrame, *, threshold: float = 0.7, window: int = 10_000, warmup: int = 50, stream: list[str] | None = None) -> DataFrame:
    """Calls (seq, id, vector) in order of seq, judged against patterns (pattern_idx, vector).

    Adds min_distance, closest_pattern_idx, score (the distance over the greatest one so far, at
    least 1), is_anomaly, baseline_mean and baseline_std (of the last ``window`` calls), and fpr
    (of anomalies after warm-up, the share within one deviation of the mean).  ``stream`` names
    columns of which each value is a detector of its own; without it all calls are one
    sequence and one partition.

    Calls count one by one, whatever their ids.  Without patterns every call is an anomaly of
    score 1, infinitely far from pattern -1, and leaves no baseline.  A call of another dimension
    than the patterns fails the query.
    """
    sizes = [r[0] for r in patterns.select(F.size("vector")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("patterns of several dimensions")
    if not sizes:
        order = (Window.partitionBy(*stream) if stream else Window.partitionBy(F.lit(0))).orderBy("seq")
        none = F.lit(None).cast("double")
        return calls.drop("vector").withColumns({"closest_pattern_idx": F.lit(-1), "min_distance": F.lit(float("inf")), "call": F.row_number().over(order), "baseline_mean": none, "baseline_std": none, "score": F.lit(1.0), "is_anomaly": F.lit(True), "fpr": F.lit(0.0)})
    near = with_nearest(calls, patterns).drop("vector").withColumnRenamed("pattern_idx", "closest_pattern_idx")
    mismatch = F.raise_error(F.lit(f"dimension mismatch: patterns have {sizes[0]}")).cast("double")
    base = near.withColumn("min_distance", F.coalesce("distance", mismatch)).drop("distance")
    order = (Window.partitionBy(*stream) if stream else Window.partitionBy(F.lit(0))).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = order.rowsBetween(1 - window, 0)
    out = base.withColumns({"seen": F.greatest(F.lit(1.0), F.max("min_distance").over(upto)), "call": F.row_number().over(order), "baseline_mean": F.avg("min_distance").over(last), "baseline_std": F.stddev_pop("min_distance").over(last), "in_window": F.count(F.lit(1)).over(last)})
    out = out.withColumn("score", F.least(F.col("min_distance") / F.col("seen"), F.lit(1.0))).withColumn("is_anomaly", F.col("score") > threshold)
    warm = F.col("call") >= warmup
    false = warm & F.col("is_anomaly") & (F.col("in_window") >= 2) & (F.col("min_distance") <= F.col("baseline_mean") + F.col("baseline_std"))
    out = out.withColumns({"false_n": F.sum(false.cast("long")).over(upto), "warm_n": F.sum(warm.cast("long")).over(upto)})
    out = out.withColumn("fpr", F.when(F.col("warm_n") > 0, F.col("false_n") / F.greatest(F.col("warm_n"), F.lit(1))).otherwise(0.0))
    return out.drop("seen", "in_window", "false_n", "warm_n")


def classify(data: DataFrame, own: DataFrame, *, radius: float = 0.3, min_patterns: int = 3, detectors: DataFrame | None = None) -> DataFrame:
    """(id, label, confidence): Self within ``radius`` of a pattern (pattern_idx, vector) of its
    own; else NonSelf, surer by a fifth of the gap if a detector is within it too."""
    if own.count() < min_patterns:
        return data.select("id", F.lit("NonSelf").alias("label"), F.lit(0.5).alias("confidence"))
    near = with_nearest(data.select("id", "vector"), own).select("id", "vector", F.coalesce("distance", F.lit(float("inf"))).alias("to_own"))
    if detectors is not None:
        near = with_nearest(near, detectors).withColumn("hit", F.col("distance") <= radius)
    else:
        near = near.withColumn("hit", F.lit(None).cast("boolean"))
    near = near.withColumn("distance", F.col("to_own"))
    excess = F.col("distance") - radius
    far = F.when(F.col("distance") == float("inf"), 1.0).otherwise(excess / (1 + excess))
    surer = F.when(F.col("hit"), far + (1 - far) * 0.2).otherwise(far)
    inside = F.col("distance") <= radius
    return near.select("id", F.when(inside, "Self").otherwise("NonSelf").alias("label"), F.when(inside, 1 - F.col("distance") / radius).otherwise(surer).alias("confidence"))


class _Shift:
    """The 64-bit xorshift behind detectors and mutations."""

    def __init__(self, state: int = 42):
        self.state = state

    def bits(self) -> int:
        x, mask = self.state, (1 << 64) - 1
        x ^= x << 13 & mask
        x ^= x >> 7
        self.state = x = x ^ (x << 17 & mask)
        return x

    def signed(self) -> float:
        return (self.bits() >> 11) / float(1 << 53) * 2 - 1

    def unit(self) -> float:
        return float(self.bits()) / float((1 << 64) - 1)

    def normal(self) -> float:
        u = max(self.unit(), 1e-10)
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self.unit())


def generate_detectors(own: DataFrame, count: int, dimension: int, *, radius: float = 0.3, seed: int = 42) -> DataFrame:
    """(pattern_idx, vector): the first ``count`` of ten times as many random vectors that are
    farther than ``radius`` from every pattern of its own."""
    draw = _Shift(seed)
    rows = [(i, [draw.signed() for _ in range(dimension)]) for i in range(max(count * 10, count))]
    candidates = own.sparkSession.createDataFrame(rows, "id bigint, vector array<double>")
    near = with_nearest(candidates, own)
    kept = near.where(F.col("distance").isNull() | (F.col("distance") > radius)).orderBy("id").limit(count)
    return kept.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1).cast("int").alias("pattern_idx"), "vector")


def _normals(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One normal number of each generator, and the generators after it."""
    drawn = []
    for _ in range(2):
        state = state ^ (state << np.uint64(13))
        state = state ^ (state >> np.uint64(7))
        state = state ^ (state << np.uint64(17))
        drawn.append(state.astype(float) / float((1 << 64) - 1))
    return np.sqrt(-2 * np.log(np.maximum(drawn[0], 1e-10))) * np.cos(2 * np.pi * drawn[1]), state


def mutations(data: DataFrame, *, n: int = 5, rate: float = 0.05, seed: int = 42, fitness: Callable[[np.ndarray], float] | None = None) -> DataFrame:
    """(id, variant_no, variant, score): Gaussian variants of each vector, scored by ``fitness``
    of a variant (its L1 norm if none is given).

    Each vector has its own sequence, started by the seed and its id.
    """

    def run(batches):
        for batch in batches:
            ids = pc.fill_null(batch.column("id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            vectors = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float)
            first = np.cumsum(sizes) - sizes
            out = np.repeat(values.reshape(1, -1), n, axis=0)
            state = np.uint64(seed) + ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            state[state == 0] = 1
            # all rows draw at once: one step for each element of each variant
            for k in range(n):
                for j in range(int(sizes.max(initial=0))):
                    live = np.flatnonzero(sizes > j)
                    drawn, state[live] = _normals(state[live])
                    out[k, first[live] + j] += drawn * rate
            order = np.repeat(np.arange(len(ids)), n)
            variants = [out[k, first[i] : first[i] + sizes[i]] for i, k in zip(order.tolist(), np.tile(np.arange(n), len(ids)).tolist())]
            scores = [float(np.abs(v).sum()) if fitness is None else float(fitness(v)) for v in variants]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(order)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(ids))), pa.array(variants, pa.list_(pa.float64())), pa.array(scores, pa.float64())], names=["id", "variant_no", "variant", "score"])

    return data.select("id", "vector").mapInArrow(run, "id bigint, variant_no int, variant array<double>, score double")


def best_mutation(variants: DataFrame) -> DataFrame:
    """(id, best_idx, best_score): the best variant, the last on ties."""
    return variants.groupBy("id").agg(F.max(F.struct("score", "variant_no")).alias("b")).select("id", F.col("b.variant_no").alias("best_idx"), F.col("b.score").alias("best_score"))


def explored(variants: DataFrame, originals: DataFrame) -> DataFrame:
    """(id, is_mutation, selected_score, improvements, total_attempts): elitism; a variant counts
    as an improvement if it beats the original and all before it."""
    run = Window.partitionBy("id").orderBy("variant_no").rowsBetween(Window.unboundedPreceding, -1)
    both = variants.join(originals.select("id", F.col("score").alias("original_score")), "id")
    best = both.withColumn("before", F.greatest("original_score", F.max("score").over(run)))
    return best.groupBy("id").agg(F.bool_or(F.col("score") > F.col("original_score")).alias("is_mutation"), F.greatest(F.max("score"), F.first("original_score")).alias("selected_score"), F.count_if(F.col("score") > F.col("before")).alias("improvements"), F.count(F.lit(1)).alias("total_attempts"))


def expired(first_seen: Column, now: Column | int, days: int = 90) -> Column:
    """Whether more than so many days have passed since the first sighting (0: never)."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.lit(days > 0) & (F.greatest(now - first_seen, F.lit(0)) > days * DAY_MS)


def match_antigens(data: DataFrame, antigens: DataFrame, *, threshold: float, now: int, days: int = 90) -> DataFrame:
    """(id, antigen_id, distance): the nearest antigen (id, pattern, first_seen_ms) that has not
    expired and is nearer than the threshold; nulls where there is none."""
    alive = antigens.where(~expired(F.col("first_seen_ms"), now, days)).select(F.col("id").alias("pattern_idx"), F.col("pattern").alias("vector"))
    near = F.col("distance") < threshold
    return with_nearest(data.select("id", "vector"), alive).select("id", F.when(near, F.col("pattern_idx")).alias("antigen_id"), F.when(near, F.col("distance")).alias("distance"))


def evict(antigens: DataFrame, capacity: int) -> DataFrame:
    """The antigens that stay: those met most often, of equals the later ones."""
    return antigens.orderBy(F.desc("encounter_count"), F.desc("id")).limit(capacity)


def record_encounters(antigens: DataFrame, met: DataFrame) -> DataFrame:
    """Counts and last sightings brought up to date by encounters (id, ms)."""
    seen = met.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.max("ms").alias("ms"))
    out = antigens.join(seen, "id", "left")
    return out.withColumns({"encounter_count": F.col("encounter_count") + F.coalesce("times", F.lit(0)), "last_seen_ms": F.coalesce(F.greatest("ms", "last_seen_ms"), "last_seen_ms")}).drop("times", "ms")


def load_antigens(known: DataFrame, loaded: DataFrame) -> DataFrame:
    """The known antigens, and those loaded whose id is new."""
    return known.unionByName(loaded.join(known.select("id"), "id", "left_anti").select(*known.columns))


def csv_rows(antigens: DataFrame) -> DataFrame:
    """(antigen_id, severity, first_seen_ms, last_seen_ms, encounter_count, status) as exported."""
    return antigens.select(F.col("id").alias("antigen_id"), "severity", "first_seen_ms", "last_seen_ms", "encounter_count", F.upper("status").alias("status"))


def boost(severity: Column, per_trigger: int = 2) -> Column:
    """What a trigger adds to a level."""
    factor = F.lit(0.0)
    for name, value in MULTIPLIER.items():
        factor = F.when(severity == name, value).otherwise(factor)
    return F.round(per_trigger * factor).cast("int")


def amplify(triggers: DataFrame, *, cap: int = 10, decay: int = 1) -> DataFrame:
    """(context, level) after triggers (context, cycle, seq, severity): each adds its boost up to
    the cap, each cycle in between takes ``decay`` away; the fold is one pass per context."""
    events = triggers.select("context", F.struct("cycle", "seq", boost(F.col("severity")).alias("boost")).alias("e"))
    ordered = events.groupBy("context").agg(F.array_sort(F.collect_list("e")).alias("es"))
    zero = F.struct(F.lit(0).alias("level"), F.col("es")[0]["cycle"].alias("cycle"))
    step = lambda s, e: F.struct(F.least(F.greatest(s["level"] - (decay * (e["cycle"] - s["cycle"])).cast("int"), F.lit(0)) + e["boost"], F.lit(cap)).alias("level"), e["cycle"].alias("cycle"))
    return ordered.select("context", F.aggregate("es", zero, step)["level"].alias("level"))


def as_matrix(patterns: DataFrame) -> np.ndarray:
    """A small pattern set as a matrix, in order of its index."""
    return np.array([r["vector"] for r in patterns.orderBy("pattern_idx").collect()], float)
