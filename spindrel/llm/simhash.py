"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints link when they differ in at most ``radius`` bits.  Every bit gets a non-zero
vector of ``radius + 1`` bits; every non-zero vector v gives a mask of the bits whose vector is
odd against v.  Up to ``radius`` differing bits span at most ``radius`` dimensions, so some v is
even against all of them: its mask leaves them out, and the pair collides in that table.  No
pair within the radius is lost, whatever the random choice.

Equal fingerprints are collapsed first, so copies cost one row.  A bucket holds the distinct
fingerprints that agree under a mask; a task gets its buckets one after the other, sorted by the
JVM (which spills), holds some whole ones at a time, compares them in blocks and hands on a
spanning forest of the links it found, never all pairs.  A bucket over ``max_bucket`` is split exactly:
of ``radius + 1`` blocks of bits, two fingerprints within the radius agree in one.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero, linked like
any other; texts of fewer words than a shingle are one shingle; repeated rows share a
component; rows with a null id link like any other, and get the smallest id reachable (null if
there is none); ids may be of any type that has an order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import written
from spindrel.llm.components import components

WORDS, RADIUS = 4, 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    last = ends[min(words, len(parts)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first, last)], np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fp, kept columns): fp is the fingerprint as a signed long."""
    names = list(dict.fromkeys(["doc_id", *(keep or [])]))
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("text of it"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column("text of it").to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found.view(np.int64))], names=[*names, "fp"])

    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in names)
    return given.mapInArrow(run, f"{kinds}, fp bigint")


def masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks over 64 bits."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(64)]
    np.random.default_rng(seed).shuffle(vectors)
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size)]


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def flat(self) -> np.ndarray:
        while (up := self.root[self.root]) is not None and (up != self.root).any():
            self.root = up
        return self.root

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return int(x)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.flat()
            differ = root[a] != root[b]
            a, b = a[differ], b[differ]
            for x, y in zip(a[:10_000].tolist(), b[:10_000].tolist()):
                i, j = self._find(x), self._find(y)
                if i != j:
                    self.root[max(i, j)] = min(i, j)
                    self.edges.append((x, y))
            a, b = a[10_000:], b[10_000:]


def _compare(key: np.ndarray, fp: np.ndarray, rows: np.ndarray, forest: _Forest, radius: int, max_bucket: int) -> None:
    """Link rows of equal key within the radius.  ``key`` is sorted."""
    cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    sizes = np.diff(cuts)
    for i in np.flatnonzero(sizes > max_bucket):
        part = slice(cuts[i], cuts[i + 1])
        width = -(-64 // (radius + 1))
        for block in range(radius + 1):
            of = (fp[part] >> np.uint64(block * width)) & np.uint64((1 << width) - 1)
            order = np.argsort(of, kind="stable")
            _compare(of[order], fp[part][order], rows[part][order], forest, radius, len(fp) + 1)
    small = np.repeat((sizes > 1) & (sizes <= max_bucket), sizes)
    key, fp, rows = key[small], fp[small], rows[small]
    step = 1
    while len(key) > step:
        near = (key[step:] == key[:-step]) & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= radius)
        at = np.flatnonzero(near)
        forest.link(rows[at], rows[at + step])
        same = key[step:] == key[:-step]
        if not same.any():
            break
        step += 1
        if step % 64 == 0:  # buckets smaller than the step are done
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            more = np.repeat(np.diff(cuts) > step, np.diff(cuts))
            key, fp, rows = key[more], fp[more], rows[more]


def links(distinct: DataFrame, *, radius: int = RADIUS, max_bucket: int = 8192, max_rows: int = 200_000) -> DataFrame:
    """(a, b): links between the ``rep`` of fingerprints within the radius, enough of them to
    connect whatever is connected.  ``distinct`` has one row (fp, rep) per fingerprint; ``rep``
    is a long of its own.  A task holds ``max_rows`` rows, or one bucket if that is larger."""
    patterns = np.array(masks(radius), np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 16384) for i in range(0, len(batch), 16384)):
                fp = part.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
                rep = part.column("rep").to_numpy(zero_copy_only=False).astype(np.int64)
                under = fp.view(np.uint64)[None, :] & patterns[:, None]
                mixed = (under ^ (np.arange(1, len(patterns) + 1, dtype=np.uint64) << np.uint64(59))[:, None]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
                yield pa.RecordBatch.from_arrays([pa.array(mixed.ravel().view(np.int64)), pa.array(np.tile(fp, len(patterns))), pa.array(np.tile(rep, len(patterns)))], names=["bucket", "fp", "rep"])

    def linked(bucket: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, rows = np.unique(rep, return_inverse=True)
        forest = _Forest(len(ids))
        _compare(bucket, fp.view(np.uint64), rows, forest, radius, max_bucket)
        if forest.edges:
            pairs = ids[np.array(forest.edges)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp", "rep")))
            rows += len(batch)
            if rows >= max_rows:
                bucket, fp, rep = (np.concatenate(x) for x in zip(*held))
                # the last bucket may go on in the next batch
                whole = int(np.searchsorted(bucket, bucket[-1], "left"))
                yield from linked(bucket[:whole], fp[:whole], rep[:whole])
                held, rows = [(bucket[whole:], fp[whole:], rep[whole:])], len(bucket) - whole
        if rows:
            yield from linked(*(np.concatenate(x) for x in zip(*held)))

    tables = distinct.select("fp", "rep").mapInArrow(spread, "bucket bigint, fp bigint, rep bigint")
    return tables.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(found, "a bigint, b bigint")


def cluster(prints: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint; component: its smallest
    fingerprint (as a signed long); component_id: its smallest doc_id, null if none has one."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius=radius))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return grouped.join(ids, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = written(fingerprints(docs.select("doc_id", "text"), words=words), "simhash")
    of = cluster(prints, radius=radius)
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents, one of each component: a row of the smallest doc_id (null last), of several
    that of the smallest fingerprint.

    Texts without words (null, empty, white space) hold nothing and all share fingerprint zero:
    one of them stays like of any other.
    """
    safe = docs.toDF(*[c if c in ("doc_id", "text") else f"given {c}" for c in docs.columns])
    marked = written(fingerprints(safe, words=words, keep=safe.columns), "simhash-docs")
    of = cluster(marked.select("doc_id", "fp"), radius=radius)
    # Of the fingerprints whose smallest id is that of the component, the smallest one stays.
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(of, "fp").where("least <=> component_id")
    stays = least.groupBy("component").agg(F.min("fp").alias("fp"), F.first("component_id").alias("component_id")).select("fp", "component_id")
    first = marked.join(stays, "fp").where("doc_id <=> component_id").dropDuplicates(["fp"])
    return first.select(*[F.col(f"`{new}`").alias(c) for c, new in zip(docs.columns, safe.columns)])
