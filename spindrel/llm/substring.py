"""Substring dedup with an FM-index per shard.

A window is ``window`` consecutive words.  Every word under a window whose word sequence also
starts earlier (smaller doc_id, or the same document and an earlier start) is removed.

1. Windows are dealt to shards by content: the least hash of the word runs of ``anchor`` words
   within a window.  Equal windows have equal least hashes, so they meet in one shard, and no
   document is streamed to any other.  Consecutive windows with one anchor make a segment.
2. Segments travel as hashes.  A segment whose anchor stands in no other one is done.  Of equal
   segments of one batch only the first goes on, once their words have been compared, so a
   passage in a third of all documents costs its shard a row a batch.
3. What shares an anchor gets its words.  Each shard builds a compressed FM-index over its
   distinct segments, each at its first place.  All segments are streamed through it (equal
   ones once) by backward search over the wavelet matrix; the interval of each match of a
   window's length gives the earliest place of its words, and a window is removed wherever it
   starts later than that.
4. The word ranges found come back to the documents by groups.

Nothing is collected to the driver but one sum.  Edge cases: null, empty and blank texts have no
words; texts shorter than a window lose nothing; documents are ordered by id (whole numbers as
such, all else as text; null last), then by a hash of the text, so wholly equal rows count as
one document and get one result each; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm import packing
from spindrel.llm.common import id_key, written
from spindrel.llm.fmindex import FMIndex

WINDOW, ANCHOR = 20, 8
#: Segments are cut after so many windows, so that a text that repeats itself has no endless one.
MAX_RUN = 64
#: Windows that are judged at once.
_WINDOWS = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | bytes | None) -> list[bytes]:
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).split() if text else []


def _power_sums(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by Horner's rule."""
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out = out * _P + hashes[i : i + len(out)]
    return packing.mix(out)


def segments(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, whether the anchor stands in it twice) of the segments of
    one document.  Only with its anchor twice can a segment hold a window twice."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    grams = least = _power_sums(hashes, anchor)
    width, have = window - anchor + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    # long runs are cut at fixed distances from their start
    sizes = np.diff(np.append(new, n))
    parts = -(-sizes // MAX_RUN)
    at = np.repeat(new, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * MAX_RUN
    windows = np.diff(np.append(at, n))
    sizes = windows + width - 1
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    hits = grams[np.repeat(at, sizes) + inside] == np.repeat(least[at], sizes)
    return at, windows, least[at], np.add.reduceat(hits.astype(np.int64), begin) > 1


def _segment_hash(hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of 48 bits of the words of each segment (its anchor is one of 64 bits besides)."""
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) if len(sizes) else 0, _P)]))
    at = np.repeat(first, sizes)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spread = packing.mix(hashes[at + inside] ^ np.uint64(0xD6E8FEB86659FD93)) * powers[inside]
    if not len(first):
        return np.empty(0, np.uint64)
    return packing.mix(np.add.reduceat(spread, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)) >> np.uint64(16)


def _identity(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"", 7) >> 1


def _group_of(text_hash: np.ndarray, groups: int) -> np.ndarray:
    return packing.bucket_of(packing.mix(text_hash.astype(np.uint64)), groups)


def _table(**columns) -> pa.Table:
    return pa.table({name: x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for name, x in columns.items()})


def _document(rows: pa.Table) -> np.ndarray:
    """The place of each row's document in the order of documents: by id, null last, then text."""
    null, own = rows.column("null").to_numpy(), rows.column("own").to_numpy()
    ids = np.unique(rows.column("id").to_numpy(), return_inverse=True)[1]
    order = np.lexsort((own, ids, null))
    new = np.r_[False, (null[order][1:] != null[order][:-1]) | (ids[order][1:] != ids[order][:-1]) | (own[order][1:] != own[order][:-1])]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _split(table: pa.Table, of: np.ndarray):
    """The rows of each value of ``of``, as blobs."""
    if not len(of):
        return
    order = np.argsort(of, kind="stable")
    of, table = of[order], table.take(pa.array(order))
    cuts = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(of[a]), packing.to_bytes(table.slice(a, b - a))


def _deal(shards: int, window: int, anchor: int):
    """Documents to segments, by shard; copies within the batch are marked."""

    def run(batches):
        for batch in packing.chunks(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            documents: list[list[bytes]] = []
            parts: list[tuple] = []
            for row, text in enumerate(texts):
                words = _words(text)
                if len(words) < window:
                    continue
                hashes = packing.hash_words(words)
                first, windows, least, twice = segments(hashes, window, anchor)
                parts.append((np.full(len(first), row), np.full(len(first), _identity(text)), np.full(len(first), len(documents)), first, windows, least, _segment_hash(hashes, first, windows + window - 1), twice))
                documents.append(words)
            if not parts:
                continue
            row, own, at, first, windows, least, digest, twice = (np.concatenate(x) for x in zip(*parts))
            rows = _table(id=batch.column("id").take(pa.array(row)), null=batch.column("null").take(pa.array(row)), own=own, first=first.astype(np.int32), windows=windows.astype(np.int32), least=least, digest=digest, twice=twice)
            order = np.lexsort((first, _document(rows), digest, least))
            least, digest = least[order], digest[order]
            same = np.r_[False, (least[1:] == least[:-1]) & (digest[1:] == digest[:-1])]
            # a copy is one whose words are those of the first with these hashes
            spelt = lambda i: documents[at[i]][first[i] : first[i] + windows[i] + window - 1]
            copy, leader = np.zeros(len(order), bool), 0
            leaders = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            for k in np.flatnonzero(same).tolist():
                if not k or leaders[k] != leader:
                    leader = int(leaders[k])
                    words = spelt(order[leader])
                copy[order[k]] = spelt(order[k]) == words
            del documents
            shard = packing.bucket_of(rows.column("least").to_numpy(), shards)
            # copies are spread by document, since their place is known to be of no account
            shard[copy] = _group_of(own[copy], shards)
            for name in ("least", "digest"):
                value = rows.column(name).to_numpy().copy()
                value[copy] = 0
                rows = rows.set_column(rows.column_names.index(name), name, pa.array(value))
            for s, blob in _split(rows.append_column("copy", pa.array(copy)), shard):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "packed"])

    return run


_KEPT = ["id", "null", "own", "first", "windows"]


def _compare(groups: int):
    """The segments of a shard: copies, and those whose words are needed."""

    def compare(key, table):
        rows = packing.joined(table.column("packed"))
        copy = rows.column("copy").to_numpy()
        found, rows = rows.filter(pa.array(copy)).select(_KEPT), rows.filter(pa.array(~copy))
        least = rows.column("least").to_numpy()
        order = np.argsort(least)
        same = least[order][1:] == least[order][:-1]
        need = rows.column("twice").to_numpy().copy()
        need[order] |= (np.r_[False, same] | np.r_[same, False]) if len(order) else False
        asked = rows.filter(pa.array(need)).select([*_KEPT, "least"])
        out = [("found", g, b) for g, b in _split(found, _group_of(found.column("own").to_numpy(), groups))]
        out += [("asked", g, b) for g, b in _split(asked, _group_of(asked.column("own").to_numpy(), groups))]
        kind, grp, blob = zip(*out) if out else ((), (), ())
        return pa.table({"kind": pa.array(kind, pa.string()), "grp": pa.array(grp, pa.int32()), "packed": pa.array(blob, pa.binary())})

    return compare


def _documents(docs: pa.Table):
    """((id, identity), words) of the documents of a group; a null id is None."""
    rows = packing.joined(docs.column("packed")) if len(docs) else None
    if rows is not None:
        for i, null, text in zip(rows.column("id").to_pylist(), rows.column("null").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()):
            yield (None if null else i, _identity(text)), _words(text)


def _names(rows: pa.Table):
    return zip((None if n else i for i, n in zip(rows.column("id").to_pylist(), rows.column("null").to_pylist())), rows.column("own").to_pylist())


def _fetch(shards: int, window: int):
    """The words of the segments asked for, by shard."""

    def fetch(key, docs, asked):
        out = []
        if len(asked):
            rows = packing.joined(asked.column("packed"))
            wanted: dict[tuple, list[int]] = {}
            for at, k in enumerate(_names(rows)):
                wanted.setdefault(k, []).append(at)
            first, windows = rows.column("first").to_numpy(), rows.column("windows").to_numpy()
            text: list[bytes | None] = [None] * len(rows)
            for k, words in _documents(docs):
                for at in wanted.pop(k, ()):
                    text[at] = b" ".join(words[first[at] : first[at] + windows[at] + window - 1])
            full = rows.append_column("text", pa.array(text, pa.binary()))
            out = list(_split(full, packing.bucket_of(rows.column("least").to_numpy(), shards)))
        shard, blob = zip(*out) if out else ((), ())
        return pa.table({"shard": pa.array(shard, pa.int32()), "packed": pa.array(blob, pa.binary())})

    return fetch


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def repeated(texts: list[bytes], document: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, windows): the intervals of windows of the segments that start earlier in
    another segment, or in the same one, by the shard's FM-index."""
    order = np.lexsort((first, document))
    distinct: dict[bytes, int] = {}
    of = np.empty(len(texts), np.int64)
    source = []
    for i in order.tolist():
        of[i] = distinct.setdefault(texts[i], len(distinct))
        if of[i] == len(source):
            source.append(i)
    numbers: dict[bytes, int] = {}
    parts = [np.array([numbers.setdefault(w, len(numbers) + 2) for w in text.split()], np.int32) for text in distinct]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    words = np.concatenate(parts)
    del parts, numbers, distinct
    # the distinct segments one after the other, a 1 behind each; the value of a place is its
    # order in the corpus: by document, then by start
    begin = np.cumsum(sizes) - sizes
    text = np.ones(len(words) + len(sizes), np.int32)
    inside = _within(sizes)
    at = np.repeat(begin + np.arange(len(sizes)), sizes) + inside
    text[at] = words
    place = np.full(len(text), np.iinfo(np.int64).max)
    place[at] = np.repeat(document[source] << 32 | first[source], sizes) + inside
    index = FMIndex(text, window, place)
    del text, place, at, inside
    earliest = np.full(len(words), np.iinfo(np.int64).max)
    for _, start, low, _ in index.matching(words, begin, begin + sizes):
        earliest[start] = index.least[index.group_of(low)]
    # every segment, copies too, against the earliest places of its words
    n = sizes[of] - window + 1
    out = []
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // _WINDOWS)) + 1, len(n)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        inside = _within(n[a:b])
        segment = np.repeat(np.arange(a, b), n[a:b])
        hit = earliest[begin[of[segment]] + inside] < (document[segment] << 32 | first[segment]) + inside
        at = np.flatnonzero(hit)
        if len(at):
            new = np.r_[True, (np.diff(at) != 1) | (np.diff(segment[at]) != 0)]
            out.append((segment[at[new]], inside[at[new]], np.diff(np.append(np.flatnonzero(new), len(at)))))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _search(groups: int, window: int):
    """One shard's segments through its FM-index."""

    def search(key, table):
        rows = packing.joined(table.column("packed"))
        first = rows.column("first").to_numpy().astype(np.int64)
        document, texts = _document(rows), rows.column("text").to_pylist()
        rows = rows.select(["id", "null", "own"])
        pa.default_memory_pool().release_unused()
        segment, offset, windows = repeated(texts, document, first, window)
        part = rows.select(["id", "null", "own"]).take(pa.array(segment))
        found = part.append_column("first", pa.array((first[segment] + offset).astype(np.int32))).append_column("windows", pa.array(windows.astype(np.int32)))
        out = list(_split(found, _group_of(found.column("own").to_numpy(), groups)))
        grp, blob = zip(*out) if out else ((), ())
        return pa.table({"grp": pa.array(grp, pa.int32()), "packed": pa.array(blob, pa.binary())})

    return search


def _clean(window: int, id_type: pa.DataType):
    """The ranges found, applied to the documents of a group."""

    def clean(key, docs, found):
        hits: dict[tuple, list[tuple[int, int]]] = {}
        if len(found):
            rows = packing.joined(found.column("packed"))
            for k, first, windows in zip(_names(rows), rows.column("first").to_pylist(), rows.column("windows").to_pylist()):
                hits.setdefault(k, []).append((first, first + windows + window - 1))
        pa.default_memory_pool().release_unused()
        ids, n_words, n_removed, kept = [], [], [], []
        for k, words in _documents(docs):
            ranges = hits.get(k, ())
            if ranges:
                mask = np.zeros(len(words) + 1, np.int32)
                for a, b in ranges:
                    mask[a] += 1
                    mask[b] -= 1
                left = [w for w, m in zip(words, np.cumsum(mask).tolist()) if not m]
            else:
                left = words
            ids.append(k[0])
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        return pa.table({"doc_id": pa.array(ids, id_type), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})

    return clean


def deduplicate(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, group_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id (LONG, or STRING where ids are no whole numbers), n_words, n_removed,
    kept (the words left, one space apart), kept_sha256."""
    rows = docs.select(id_key(docs).alias("id"), F.col("doc_id").isNull().alias("null"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    groups = packing.groups_for(rows, group_bytes)
    dealt = rows.mapInArrow(_deal(groups, window, anchor), "shard int, packed binary")
    compared = written(dealt.groupBy("shard").applyInArrow(_compare(groups), "kind string, grp int, packed binary"), "segments")
    packed = _by_identity(rows, groups)
    asked = compared.where("kind = 'asked'").select("grp", "packed")
    words = packed.groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(_fetch(groups, window), "shard int, packed binary")
    searched = written(words.groupBy("shard").applyInArrow(_search(groups, window), "grp int, packed binary"), "repeats")
    found = compared.where("kind = 'found'").select("grp", "packed").unionByName(searched)
    return packed.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_clean(window, pa.int64() if kind == "bigint" else pa.string()), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string")


def _by_identity(rows: DataFrame, groups: int) -> DataFrame:
    """(grp, packed): documents by the hash of their text that their segments carry."""

    def run(batches):
        for batch in packing.chunks(batches):
            own = np.fromiter((_identity(t) for t in batch.column("text").cast(pa.binary()).to_pylist()), np.int64, len(batch))
            for g, blob in _split(pa.Table.from_batches([batch]), _group_of(own, groups)):
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([blob], pa.binary())], names=["grp", "packed"])

    return rows.mapInArrow(run, "grp int, packed binary")
