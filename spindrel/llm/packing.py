"""Packed rows: documents and number arrays as binary blobs, one per group and batch.

A shuffle of a few large binary rows costs the JVM little, and zstd makes them a third of the
text.  Groups are dealt by a hash of id and text, sized by the bytes of all texts, so that a
group fits a Python worker at any scale; a lost executor costs the groups of its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_OPTIONS) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def joined(column: pa.ChunkedArray) -> pa.Table | None:
    """The tables of a column of blobs, one after the other."""
    parts = [from_bytes(x) for x in column.to_pylist()]
    return pa.concat_tables(parts) if parts else None


def groups_for(docs: DataFrame, group_bytes: int) -> int:
    """As many groups as hold about ``group_bytes`` of text each."""
    total = docs.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    return max(1, -(-int(total) // group_bytes))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text each, at least one row; what
    their predecessors took is given back to the system."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1).tolist(), len(batch)] if len(batch) else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
            pa.default_memory_pool().release_unused()


def pack(docs: DataFrame, groups: int, columns: list[str], chunk: int = 2048) -> DataFrame:
    """(grp, packed): the given columns (``text`` among them) in blobs by group.

    The group is a hash of all of the columns, so only wholly equal rows must share one.
    """
    given = docs.select(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(groups)).cast("int").alias("grp"), *[F.col(f"`{c}`") for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("grp").to_numpy(zero_copy_only=False), kind="stable")
            rows = pa.Table.from_batches([batch]).take(pa.array(order))
            grp = rows.column("grp").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(grp)) + 1, len(grp)] if len(grp) else np.array([0])
            body = rows.drop_columns(["grp"])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield pa.RecordBatch.from_arrays([pa.array([grp[a]], pa.int32()), pa.array([to_bytes(body.slice(a, b - a))], pa.binary())], names=["grp", "packed"])

    return given.mapInArrow(run, "grp int, packed binary")


class Hashes(dict):
    """Word to its XXH64; kept for the words to come, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = number = xxhash.xxh64_intdigest(word)
        return number


HASHES = Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the keys."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def encode_sorted(keys: np.ndarray) -> bytes:
    """Rising keys by their differences, the needless high bytes left out."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = 8 if not len(steps) else max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
