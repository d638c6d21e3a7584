"""The engine's event stream: five kinds of JSON events, read from files or any text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of events and the fields that each may have (the others are null).
KINDS = ("query_completed", "node_updated", "node_deleted", "pheromone_deposited", "ais_anomaly")
SCHEMA = "type string, ts timestamp, request_id string, tenant_id string, pipeline_ms double, node_id bigint, state string, src bigint, dst bigint, amount double, score double, vector array<double>, stream_id string, seq bigint"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; lines of other kinds, or that cannot be read, are left out."""
    return lines.select(F.from_json(column, SCHEMA).alias("e")).select("e.*").where(F.col("type").isin(*KINDS))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events in a folder of JSON files."""
    return spark.readStream.schema(SCHEMA).json(path).where(F.col("type").isin(*KINDS))


def per_minute(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """(start, type, n) of each minute; late events count up to the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 minute").alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def first_requests(events: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """Requests without those whose id came before, within the watermark."""
    return events.where("type = 'query_completed'").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["request_id"])


def log_to(events: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to a Parquet log, once: a batch that is run again overwrites its
    own part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
