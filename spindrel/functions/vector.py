"""Vector expressions over ARRAY<DOUBLE> columns, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def doubles(c) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(a: Column) -> Column:
    """Whether all elements are numbers and neither NaN nor infinite."""
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, not clamped.  Null where sizes differ or an element is not finite; 0
    where a vector is empty or of length zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & finite(a) & finite(b), F.when(scale == 0, 0.0).otherwise(dot(a, b) / F.when(scale == 0, 1.0).otherwise(scale)))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; null where sizes differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def l1(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def normalize(a: Column) -> Column:
    """The vector of length one; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


#: Distance metrics by name.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "l2": l2}


def register(spark: SparkSession) -> None:
    """cos_sim, l2_dist and exp_neg_fast as SQL functions, inlined by the optimizer; they agree
    with :func:`cosine`, :func:`l2` and ``memory_kernel.exp_neg``."""
    pair = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
    own = lambda v: f"sqrt(aggregate({v}, 0D, (s, x) -> s + x * x))"
    odd = lambda v: f"exists({v}, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    cos = f"coalesce(try_divide({pair.format('x * y')}, {own('a')} * {own('b')}), 0D)"
    spark.sql(f"create or replace temporary function cos_sim(a array<double>, b array<double>) returns double return case when size(a) = size(b) and not {odd('a')} and not {odd('b')} then {cos} end")
    spark.sql(f"create or replace temporary function l2_dist(a array<double>, b array<double>) returns double return case when size(a) = size(b) then sqrt({pair.format('(x - y) * (x - y)')}) end")
    u = "(least(greatest(x, 0D), 88D) / 64D)"
    spark.sql(f"create or replace temporary function exp_neg_fast(x double) returns double return 1D / power(1D + {u} * (1D + {u} * (0.5D + {u} * (0.16666667D + {u} * 0.04166667D))), 64D)")
