"""Fractional memory: eight exponential modes whose weights depend on the order alpha.

Everything is an expression in double precision (single precision in the states of others
differs by some 1e-6 of the value); a fold over stimuli runs per key in Arrow batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODES, STEPS = 8, 99
#: The slowest and the fastest decay a second, and the spread of the weights (fixed values).
SLOWEST, FASTEST, SPREAD = 3.17e-9, 2.0, 1.45

THETAS = [FASTEST * (FASTEST / SLOWEST) ** (-m / (MODES - 1)) for m in range(MODES)]


def omegas(alpha: float) -> list[float]:
    """The weights of the modes: a bell around (1 - alpha) * 7, summing to one."""
    raw = [math.exp(-0.5 * ((m - (1 - alpha) * (MODES - 1)) / SPREAD) ** 2) for m in range(MODES)]
    return [w / sum(raw) for w in raw]


def kernel_table(spark: SparkSession) -> DataFrame:
    """(idx, mode, alpha, theta, omega): 99 orders of 8 modes, by expressions."""
    grid = spark.range(STEPS).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(MODES - 1))).alias("mode"))
    grid = grid.withColumn("alpha", (F.col("idx") + 1) * 0.01)
    raw = F.exp(-0.5 * F.pow((F.col("mode") - (1 - F.col("alpha")) * (MODES - 1)) / SPREAD, 2))
    from pyspark.sql import Window

    return grid.withColumns({"theta": FASTEST * F.pow(F.lit(FASTEST / SLOWEST), -F.col("mode") / F.lit(float(MODES - 1))), "raw": raw}).withColumn("omega", F.col("raw") / F.sum("raw").over(Window.partitionBy("idx"))).drop("raw")


def exp_neg(x: Column) -> Column:
    """exp(-x) by a quartic at x / 64 and six squarings; x is held to [0, 88]."""
    u = F.least(F.greatest(x, F.lit(0.0)), F.lit(88.0)) / 64.0
    p = 1.0 + u * (1.0 + u * (0.5 + u * (0.16666667 + u * 0.04166667)))
    return 1.0 / F.pow(p, F.lit(64.0))


def clamp_alpha(alpha: Column) -> Column:
    return F.least(F.greatest(alpha, F.lit(0.01)), F.lit(0.99))


def weights(alpha: Column) -> Column:
    """The weights of an order, from a constant table of 99 rows."""
    table = F.array(*[F.array(*[F.lit(w) for w in omegas((i + 1) * 0.01)]) for i in range(STEPS)])
    return table[F.greatest(F.round(clamp_alpha(alpha) * 100), F.lit(1.0)).cast("int") - 1]


def seconds(now: Column, then: Column) -> Column:
    return F.greatest(now - then, F.lit(0)) * 0.001


def decayed(modes: Column, dt: Column) -> Column:
    theta = F.array(*[F.lit(t) for t in THETAS])
    return F.zip_with(modes, theta, lambda m, t: m * exp_neg(t * dt))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def peek(modes: Column, then: Column, alpha: Column, cached: Column, now: Column) -> Column:
    """The intensity now, the state left as it is."""
    dt = seconds(now, then)
    return F.when(dt <= 0, cached).otherwise(_dot(decayed(modes, dt), weights(alpha)))


def step(modes: Column, then: Column, alpha: Column, now: Column, stimulus: Column) -> Column:
    """The state after decay and a stimulus: struct of modes, last_updated_ms, alpha, cached_intensity."""
    new = F.transform(decayed(modes, seconds(now, then)), lambda m: m + stimulus)
    return F.struct(new.alias("modes"), now.alias("last_updated_ms"), alpha.alias("alpha"), _dot(new, weights(alpha)).alias("cached_intensity"))


def modulate(modes: Column, then: Column, alpha: Column, new_alpha: Column, now: Column) -> Column:
    """The state brought to now and given another order; the intensity is that cached before
    the change (nothing has elapsed since)."""
    new = decayed(modes, seconds(now, then))
    return F.struct(new.alias("modes"), now.alias("last_updated_ms"), clamp_alpha(new_alpha).alias("alpha"), _dot(new, weights(alpha)).alias("cached_intensity"))


def stage(vitality: Column, alpha: Column) -> Column:
    """Struct of the stage and the order that go with an intensity."""
    pair = lambda name, a: F.struct(F.lit(name).alias("stage"), a.alias("alpha"))
    return (
        F.when(vitality < 0.05, pair("Apoptosis", alpha))
        .when((vitality > 50) & (alpha > 0.20), pair("Specialized", F.lit(0.15)))
        .when((vitality > 15) & (alpha > 0.60), pair("Progenitor", F.lit(0.55)))
        .otherwise(pair("Stem", alpha))
    )


def fold(events: DataFrame, *, alpha: float, key: list[str]) -> DataFrame:
    """(key, deposits, level): each key's stimuli (ms, amount, seq) applied in order.

    The fold is an aggregate over the key's sorted events, in the JVM.
    """
    ordered = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ms", "seq", "amount"))).alias("e"))
    zero = F.struct(F.array_repeat(F.lit(0.0), MODES).alias("modes"), F.col("e")[0]["ms"].alias("last_updated_ms"))
    state = F.aggregate("e", zero, lambda s, e: F.struct(F.transform(decayed(s["modes"], seconds(e["ms"], s["last_updated_ms"])), lambda m: m + e["amount"]).alias("modes"), e["ms"].alias("last_updated_ms")))
    return ordered.select(*key, F.size("e").cast("bigint").alias("deposits"), _dot(state["modes"], weights(F.lit(alpha))).alias("level"))
