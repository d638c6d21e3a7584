"""Streams give the results of their batch forms."""

import json
import os

import pytest
from pyspark.sql import functions as F

from spindrel.operators import immune, pheromone
from spindrel.streaming import events, stateful


def collected(query, spark, name, mode="append"):
    query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@pytest.fixture
def folder(tmp_path):
    lines = []
    for i in range(90):
        lines.append({"type": "ais_anomaly", "ts": f"2024-01-01T00:{i % 60:02d}:00Z", "stream_id": f"s{i % 2}", "seq": i, "vector": [float(i % 7), float(i % 5)], "src": i % 3, "dst": 1, "amount": 0.25 * (i % 9), "request_id": f"r{i % 10}"})
    for part in range(3):
        (file := tmp_path / f"{part}.json").write_text("\n".join(json.dumps(x) for x in lines[part * 30 : part * 30 + 30]))
        os.utime(file, (1_700_000_000 + part, 1_700_000_000 + part))  # files are taken by their times
    return str(tmp_path)


def one_file_at_a_time(spark, path):
    return spark.readStream.schema(events.SCHEMA).option("maxFilesPerTrigger", 1).json(path)


def test_detector(spark, folder):
    batch = spark.read.schema(events.SCHEMA).json(folder)
    own = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 3.0])], "pattern_idx int, vector array<double>")
    found = collected(stateful.detect(one_file_at_a_time(spark, folder), immune.as_matrix(own), threshold=0.5, window=10, warmup=5), spark, "detections")
    wanted = immune.detect(batch.select(F.col("seq").alias("id"), "seq", "stream_id", "vector"), own, threshold=0.5, window=10, warmup=5, stream=["stream_id"])
    columns = ["seq", F.round("min_distance", 9), "closest_pattern_idx", F.round("score", 9), "is_anomaly", F.round("fpr", 9)]
    assert sorted(found.select(*columns).collect()) == sorted(wanted.select(*columns).collect())


def test_deposits(spark, folder):
    batch = spark.read.schema(events.SCHEMA).json(folder)
    found = collected(stateful.deposit(one_file_at_a_time(spark, folder)), spark, "levels", "update")
    last = {(r.src, r.dst): r.level for r in sorted(found.collect(), key=lambda r: r.deposit_count)}
    wanted = {(r.src, r.dst): r.level for r in pheromone.deposit(None, batch.select("seq", "src", "dst", "amount")).collect()}
    assert last == pytest.approx(wanted)


def test_windows_and_first_requests(spark, folder):
    n = collected(events.per_minute(events.read(spark, folder)), spark, "minutes")
    assert n.columns == ["start", "type", "n"]
    done = events.read(spark, folder).withColumn("type", F.lit("query_completed"))
    assert collected(events.first_requests(done), spark, "firsts").count() == 10


def test_parse(spark):
    lines = spark.createDataFrame([('{"type": "node_deleted", "node_id": 3}',), ('{"type": "other"}',), ("not json",)], "value string")
    assert [r.node_id for r in events.parse(lines).collect()] == [3]


def test_log(spark, folder, tmp_path):
    log = str(tmp_path / "log")
    events.log_to(events.read(spark, folder), log, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(log).count() == 90
