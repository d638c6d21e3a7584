"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's windows.

Each item's words (``[0-9A-Za-z]`` and all non-ASCII, A-Z lower-cased) give the windows of
``window`` consecutive words; an item of fewer words is one window.  The windows of all items,
framed by spaces, form one automaton.  A document is normalised once, byte by byte, so each
byte keeps its offset; the automaton scans its joined words once, and the ends of the matches
lead back to word numbers and byte offsets of the original text.

The windows are broadcast only up to ``max_bytes`` of benchmark text; a larger benchmark is
dealt into blocks by item, each with its own automaton and scan, and the hits of the blocks are
joined per document.  Documents are never shuffled when one block is enough.

Edge cases: null or empty texts have no words and are not contaminated; items without words,
and null items, have no window; rows with the same item id count as one item, and a null item
id counts as an empty one; repeated documents give repeated rows (with several blocks they are
joined by 256 bits of hash of the whole row, which count them apart); extra columns are ignored by :func:`scan` and kept
by :func:`remove`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import shuffle_partitions

WINDOW = 13
#: Lower-cases A-Z and turns all other ASCII that is no word character into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Matcher:
    """The automaton over the windows of (item id, text) rows."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(b" ".join(words[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, frozenset(ids)))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [from, to) under occurring windows, merged, and the items concerned."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.any or not words:
            return ranges, items
        text = f" {b' '.join(words).decode('latin-1')} "
        counted = number = 0
        for end, (size, ids) in self.automaton.iter(text):
            number += text.count(" ", counted, end)  # spaces before the closing one: words that have begun
            counted = end
            items |= ids
            start = number - size
            if ranges and start <= ranges[-1][1]:
                while ranges and start <= ranges[-1][1]:
                    start = min(start, ranges.pop()[0])
                ranges.append((start, number))
            else:
                ranges.append((start, number))
        return ranges, items


_MATCHERS: dict = {}


def _matcher(items: list[tuple[str, str]], window: int) -> Matcher:
    key = (window, hash(tuple(items)))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, window)
    return _MATCHERS[key]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original UTF-8 text of word ranges."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, raw, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_bytes: int = 32 << 20, keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are byte ranges of the original text under occurring windows.  ``keep`` names
    columns of ``docs`` to return besides.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-int(total) // max_bytes))
    kept = keep or []
    given = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", "text", *kept])])
    if blocks == 1:
        return _scan_block(given, _collected(items), window, kept, True)
    # Larger than the bound: block after block, and the hits meet per document.
    keyed = given.withColumn("row_key", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in given.columns]), {"ignoreNullFields": "false"}), 256))
    n = shuffle_partitions(spark)
    parts = []
    for block in range(blocks):
        rows = _collected(items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block))
        parts.append(_scan_block(keyed, rows, window, [*kept, "row_key"], False).withColumn("block", F.lit(block)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    copies = keyed.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))
    joined = every.groupBy("row_key", "block").agg(*[F.first(c).alias(c) for c in every.columns if c not in ("row_key", "block")])
    joined = joined.groupBy("row_key").agg(*[F.first(f"`{c}`").alias(c) for c in dict.fromkeys(["doc_id", "n_words", *kept])], F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    joined = joined.join(copies, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("row_key", "copies", "copy")
    return _totals(joined.repartition(n), kept)


def _collected(items: DataFrame) -> list[tuple[str, str]]:
    """The items of one block; :func:`scan` has checked that they are under the bound."""
    return sorted((r["item"], r["text"]) for r in items.collect())


def _schema(given: DataFrame, names: list[str]) -> list[str]:
    return [f"`{c}` {given.schema[c].dataType.simpleString()}" for c in names]


_TOTALS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<first:bigint,last:bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode("utf-8", "surrogatepass")).hexdigest()


def _scan_block(given: DataFrame, rows: list[tuple[str, str]], window: int, kept: list[str], final: bool) -> DataFrame:
    names = list(dict.fromkeys(["doc_id", *kept]))
    sent = given.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(sent.value, window)
        for batch in batches:
            n_words, found, spans = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ranges, items = matcher.hits(words)
                n_words.append(len(words))
                found.append((ranges, items))
                spans.append([{"first": a, "last": b} for a, b in byte_spans(text, ranges)] if ranges else [])
            columns = [batch.column(c) for c in names]
            if final:
                n_hit = [sum(b - a for a, b in r) for r, _ in found]
                columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for _, i in found], pa.int64()), pa.array([_digest(i) for _, i in found], pa.string()), pa.array([h > 0 and 20 * h >= w for h, w in zip(n_hit, n_words)], pa.bool_()), pa.array(spans, _SPANS)]
                out = [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
            else:
                columns += [pa.array(n_words, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in r] for r, _ in found], _SPANS), pa.array([sorted(i) for _, i in found], pa.list_(pa.string())), pa.array(spans, _SPANS)]
                out = [*names, "n_words", "ranges", "items", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names=out)

    rest = _TOTALS if final else "n_words bigint, ranges array<struct<first:bigint,last:bigint>>, items array<string>, spans array<struct<first:bigint,last:bigint>>"
    return given.mapInArrow(run, ", ".join([*_schema(given, names), rest]))


def _totals(joined: DataFrame, kept: list[str]) -> DataFrame:
    names = list(dict.fromkeys(["doc_id", *[c for c in kept if c != "row_key"]]))
    given = joined.select(*[f"`{c}`" for c in names], "n_words", "ranges", "items", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = batch.column("n_words").to_pylist()
            n_hit = [sum(b - a for a, b in _merged([(x["first"], x["last"]) for x in r])) for r in batch.column("ranges").to_pylist()]
            items = [set(i) for i in batch.column("items").to_pylist()]
            spans = [[{"first": a, "last": b} for a, b in _merged([(x["first"], x["last"]) for x in s])] for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([_digest(i) for i in items], pa.string()), pa.array([h > 0 and 20 * h >= w for h, w in zip(n_hit, n_words)], pa.bool_()), pa.array(spans, _SPANS)], names=[*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return given.mapInArrow(run, ", ".join([*_schema(given, names), _TOTALS]))


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``."""
    clash = [c for c in docs.columns if c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")]
    safe = docs.withColumnsRenamed({c: f"given {c}" for c in clash})
    found = scan(safe, benchmark, window=window, keep=safe.columns).where("not contaminated")
    return found.select(*[F.col(f"`given {c}`").alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns])
