"""Fixed-bucket latency histogram and its percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH_US, BUCKETS = 10, 10_000


def histogram(samples: DataFrame, column: str = "latency_us", *, width: int = WIDTH_US, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): what lies beyond the range is counted in the last bucket."""
    bucket = F.least(F.floor(F.col(column) / width), F.lit(buckets - 1)).cast("bigint")
    return samples.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def summary(samples: DataFrame, column: str = "latency_us") -> DataFrame:
    """One row: n, sum_us, min_us, max_us, mean_us (zeros without samples)."""
    c = F.col(column)
    return samples.agg(
        F.count(c).alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("sum_us"), F.coalesce(F.min(c), F.lit(0)).alias("min_us"),
        F.coalesce(F.max(c), F.lit(0)).alias("max_us"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_us"),
    )


def percentiles(hist: DataFrame, per_mille: tuple[int, ...] = (500, 950, 990, 999), *, width: int = WIDTH_US) -> DataFrame:
    """(p, value_us): the first bucket whose cumulated count reaches floor(n * p / 1000), with
    the place within it interpolated; zeros without samples.

    The window runs over buckets, of which there is a fixed number, never over samples.
    """
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = hist.withColumn("upto", F.sum("n").over(run))
    whole = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    wanted = whole.select(F.explode(F.array(*[F.lit(p) for p in per_mille])).alias("p"), "total").withColumn("target", F.floor(F.col("total") * F.col("p") / 1000).cast("bigint"))
    hit = wanted.join(F.broadcast(upto), F.col("upto") >= F.col("target"), "left").groupBy("p", "target").agg(F.min(F.struct("bucket", "n", "upto")).alias("b"))
    inside = F.floor((F.col("target") - F.col("b.upto") + F.col("b.n")) / F.col("b.n") * width)
    return hit.select("p", F.coalesce(F.col("b.bucket") * width + inside, F.lit(0)).cast("bigint").alias("value_us"))
