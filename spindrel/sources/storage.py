"""A key-value store as an append-only log table, its recovery, and byte codecs."""

from __future__ import annotations

import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A log row.  ``checksum`` is the CRC-32 of ``data``.
LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("timestamp_ms", T.LongType()), T.StructField("operation", T.StringType()), T.StructField("key", T.StringType()), T.StructField("data", T.StringType()), T.StructField("checksum", T.LongType())])


def entries(writes: DataFrame) -> DataFrame:
    """Writes (seq, timestamp_ms, key, data) as log rows."""
    return writes.select("seq", "timestamp_ms", F.lit("INSERT").alias("operation"), "key", "data", F.crc32(F.col("data").cast("binary")).alias("checksum"))


def append(log: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines; each task writes its own file."""
    log.write.mode("append").json(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log; a line that cannot be read fails the replay."""
    return spark.read.schema(LOG).option("mode", "FAILFAST").json(path)


def latest(log: DataFrame) -> DataFrame:
    """(key, data, seq): the last write of each key; tasks combine before the shuffle."""
    return log.groupBy("key").agg(F.max(F.struct("seq", "data")).alias("m")).select("key", "m.data", "m.seq")


def read(log: DataFrame, key: str) -> DataFrame:
    return latest(log.where(F.col("key") == key))


def sound(data: str = "data", checksum: str = "checksum") -> Column:
    return F.crc32(F.col(data).cast("binary")) == F.col(checksum)


def recover(log: DataFrame) -> DataFrame:
    """The state after replaying sound INSERT rows."""
    return latest(log.where(sound() & (F.col("operation") == "INSERT")))


def recovery_report(log: DataFrame) -> DataFrame:
    """One row: how many rows were replayed, were corrupt, were skipped, were applied."""
    return log.agg(F.count(F.lit(1)).alias("replayed"), F.count_if(~sound()).alias("corrupt"), F.count_if(sound() & (F.col("operation") != "INSERT")).alias("skipped"), F.count_if(sound() & (F.col("operation") == "INSERT")).alias("applied"))


def read_range(binary: Column, offset: int, length: int) -> Column:
    """Bytes [offset, offset + length); null if they reach beyond the end."""
    return F.when(F.lit(offset >= 0) & (F.octet_length(binary) >= offset + length), F.substring(binary, offset + 1, length))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names in spark.checkpoint.dir.

    Where none is named, a local session gets one of this machine; a cluster is refused, since
    its executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.conf.get("spark.master", "") or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spindrel-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a written table: loops that join their own result would else double
    their plan each round, and a lost executor would cost all rounds."""
    return snapshot(df, scratch(df.sparkSession))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a state and read it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Eight modes, the time, the order and the intensity, little-endian.
_STATE = np.dtype([("modes", "<f4", 8), ("last_updated_ms", "<u8"), ("alpha", "<f4"), ("cached_intensity", "<f4")])


def encode_states(states: DataFrame) -> DataFrame:
    """(id, page, checksum): fractional states (id, modes, last_updated_ms, alpha,
    cached_intensity) as 48 bytes each, a batch at a time."""

    def run(batches):
        for b in batches:
            pages = np.zeros(len(b), _STATE)
            pages["modes"] = b.column("modes").flatten().to_numpy(zero_copy_only=False).reshape(len(b), 8)
            for name in ("last_updated_ms", "alpha", "cached_intensity"):
                pages[name] = b.column(name).to_numpy(zero_copy_only=False)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_STATE.itemsize), len(b), [None, pa.py_buffer(pages.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("id"), fixed.cast(pa.binary())], names=["id", "page"])

    return states.select("id", "modes", "last_updated_ms", "alpha", "cached_intensity").mapInArrow(run, "id bigint, page binary").withColumn("checksum", F.crc32("page"))


def decode_states(pages: DataFrame) -> DataFrame:
    """The states of pages whose checksum and size hold."""

    def run(batches):
        for b in batches:
            rows = np.frombuffer(b"".join(b.column("page").to_pylist()), _STATE)
            modes = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(rows) + 1, 8, dtype=np.int32)), pa.array(rows["modes"].ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), modes, pa.array(rows["last_updated_ms"].astype(np.int64)), pa.array(rows["alpha"].copy()), pa.array(rows["cached_intensity"].copy())], names=["id", "modes", "last_updated_ms", "alpha", "cached_intensity"])

    sound_ = (F.crc32("page") == F.col("checksum")) & (F.octet_length("page") == _STATE.itemsize)
    return pages.where(sound_).select("id", "page").mapInArrow(run, "id bigint, modes array<float>, last_updated_ms bigint, alpha float, cached_intensity float")


#: A packet: marker, node, sequence, type, watermark, all big-endian, then the payload.
_HEAD = ">B16sIBQ"
MARKER, TYPES = 3, {1: "PheromoneSync", 2: "AntigenSync", 3: "GraphDeltaSync"}


def encode_packet(node: str, sequence: int, kind: str, watermark: int, payload: bytes) -> bytes:
    number = {v: k for k, v in TYPES.items()}[kind]
    return struct.pack(_HEAD, MARKER, uuid.UUID(node).bytes, sequence, number, watermark) + payload


def decode_packets(packets: DataFrame, column: str = "packet") -> DataFrame:
    """Packets with node_id, sequence_number, message_type, causal_watermark, payload and error,
    by expressions over the bytes."""
    raw = F.hex(column)
    number = lambda first, size: F.conv(F.substring(raw, 2 * first + 1, 2 * size), 16, 10)
    kind = F.lit(None).cast("string")
    for n, name in TYPES.items():
        kind = F.when(number(21, 1) == str(n), name).otherwise(kind)
    error = F.when(F.octet_length(column) < 30, "packet too short").when(number(0, 1) != str(MARKER), "invalid magic byte").when(kind.isNull(), F.concat(F.lit("unknown message type: 0x"), F.lower(F.substring(raw, 43, 2))))
    node = F.lower(F.regexp_replace(F.substring(raw, 3, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    good = lambda c: F.when(F.col("error").isNull(), c)
    out = packets.withColumn("error", error)
    return out.withColumns({"node_id": good(node), "sequence_number": good(number(17, 4).cast("bigint")), "message_type": good(kind), "causal_watermark": good(number(22, 8).cast("decimal(20,0)")), "payload": good(F.expr(f"substring({column}, 31)"))})


def idempotent(requests: DataFrame, ttl_ms: int | None = None, capacity: int | None = None) -> DataFrame:
    """The requests (request_id, seq, ...) that are answered anew: the first of each id.

    With ``ttl_ms`` an answer is kept so long from the request (ms) it was made for, so later
    ones are answered anew; with ``capacity`` only the ids answered last keep theirs.
    """
    if ttl_ms is not None:
        times = requests.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("ms", "seq"))).alias("es"))
        zero = F.struct(F.lit(None).cast("bigint").alias("kept"), F.array().cast("array<bigint>").alias("seqs"))
        # an id's own requests, one after the other
        step = lambda s, e: F.when(s["kept"].isNull() | (e["ms"] - s["kept"] >= ttl_ms), F.struct(e["ms"].alias("kept"), F.array_append(s["seqs"], e["seq"]).alias("seqs"))).otherwise(s)
        anew = times.select("request_id", F.explode(F.aggregate("es", zero, step)["seqs"]).alias("seq"))
        out = requests.join(anew, ["request_id", "seq"], "left_semi")
    else:
        out = requests.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))).where("n = 1").drop("n")
    if capacity is None:
        return out
    last = out.groupBy("request_id").agg(F.max("seq").alias("last")).orderBy(F.desc("last")).limit(capacity).select("request_id")
    return out.join(last, "request_id", "left_semi")

