"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The text of a task is split into pieces by the pattern, and each distinct piece is kept once.
All distinct pieces lie in one flat token array, linked left and right.  An inverted index
leads from the rank of a token pair to the positions where the pair stands; ranks are popped
in rising order, each merge is applied to all its positions at once, and only the pairs with
the merged token's neighbours are looked up and indexed anew.

There is no shuffle: pieces are interned per Python worker (and kept between its batches up
to ``max_pieces``), so memory is bounded by the batch and that parameter, and a lost executor
costs its tasks alone.

Edge cases: null text encodes like empty text (no tokens); a text of any length is encoded
whole; repeated rows give repeated rows; extra columns do not matter, since only the id and
text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Left and right token of a pair are packed into one key.
SHIFT = 32


class Vocabulary:
    """The ranks of a ``.tiktoken`` file, and the pairs that merge into each token."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.of_byte = np.full(256, -1, np.int64)
        for value in range(256):
            if (rank := self.ranks.get(bytes([value]))) is None:
                raise ValueError(f"byte {value} has no token")
            self.of_byte[value] = rank
        pairs, early = {}, set()
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << SHIFT | right] = rank
                    early.update(x for x in (left, right) if x > rank and len(self.tokens[x]) > 1)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        #: Tokens that take part in a pair of lower rank than their own: after such a merge an
        #: earlier rank can come up again, and the words concerned are encoded one by one.
        self.early = early
        self.pairs = pairs

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair merges into, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode_piece(self, piece: bytes) -> list[int]:
        """One piece by the definition: the leftmost pair of lowest rank merges first."""
        ids = [int(self.of_byte[b]) for b in piece]
        while len(ids) > 1:
            best, at = min((self.pairs.get(a << SHIFT | b, 1 << 62), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if best == 1 << 62:
                break
            ids[at : at + 2] = [best]
        return ids

    def replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, all merges replayed over all pieces together."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        if not n:
            return [np.empty(0, np.uint32) for _ in pieces]
        token = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), sizes)
        ends = np.cumsum(sizes)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends[sizes > 0] - 1] = -1
        left[(ends - sizes)[sizes > 0]] = -1
        alive, odd = np.ones(n, bool), set()
        rank = np.full(n, -1, np.int64)  # of the pair that starts here
        inner = np.flatnonzero(right >= 0)
        rank[inner] = self.rank_of(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(ranks: np.ndarray, at: np.ndarray) -> None:
            keep = ranks >= 0
            ranks, at = ranks[keep], at[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, positions in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if r not in index:
                    index[r] = [positions]
                    heapq.heappush(heap, r)
                else:
                    index[r].append(positions)

        add(rank[inner], inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            gone = right[at]
            if len(at) > 1 and (meets := gone[:-1] == at[1:]).any():
                # pairs that overlap: every second one of a chain, from the left
                steps = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.r_[False, meets], 0, steps))
                keep = (steps - first) % 2 == 0
                at, gone = at[keep], gone[keep]
            if r in self.early:
                self._flag_early(r, at, gone, token, left, right, word, odd)
            after = right[gone]
            token[at], right[at], alive[gone], rank[gone] = r, after, False, -1
            left[after[after >= 0]] = at[after >= 0]
            new_right = np.where(after >= 0, self.rank_of(np.full(len(at), r), token[after]), -1)
            rank[at] = new_right
            before = left[at]
            has = before >= 0
            before = before[has]
            new_left = self.rank_of(token[before], token[right[before]])
            rank[before] = new_left
            add(np.concatenate([new_right, new_left]), np.concatenate([at, before]))
        counts = np.bincount(word[alive], minlength=len(pieces))
        out = np.split(token[alive].astype(np.uint32), np.cumsum(counts)[:-1])
        for w in odd:
            out[w] = np.array(self.encode_piece(pieces[w]), np.uint32)
        return out

    def _flag_early(self, r, at, gone, token, left, right, word, odd) -> None:
        """Mark the words in which this merge can bring up a pair of a lower rank."""
        after, before = right[gone], left[at]
        merged = np.full(len(at), r)
        for there, ranks in ((after >= 0, self.rank_of(merged, token[after])), (before >= 0, self.rank_of(token[before], merged))):
            odd.update(word[at[there & (ranks >= 0) & (ranks < r)]].tolist())
        both = self.rank_of(merged[:1], merged[:1])[0]
        if 0 <= both < r:
            odd.update(word[at].tolist())


class _Pieces(dict):
    """Piece to its number; a piece not seen before gets the next one."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Codec:
    """Encodes batches of texts; pieces once replayed are kept, up to ``max_pieces``."""

    def __init__(self, vocabulary: Vocabulary, max_pieces: int):
        self.vocabulary, self.max_pieces = vocabulary, max_pieces
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.starts, self.sizes, self.flat = _Pieces(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > self.max_pieces:
            self._reset()
        find, number, known = self.vocabulary.pattern.findall, self.pieces.__getitem__, len(self.pieces)
        numbers = [np.fromiter(map(number, found), np.int32, len(found)) for found in map(find, texts)]
        if len(self.pieces) > known:
            fresh = [p.encode("utf-8", "surrogatepass") for p in list(self.pieces)[known:]]
            ids = self.vocabulary.replay(fresh)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, *ids])
        out = []
        for of in numbers:
            sizes = self.sizes[of]
            upto = np.cumsum(sizes)
            at = np.repeat(self.starts[of] - upto + sizes, sizes)
            at += np.arange(len(at))
            out.append(self.flat[at])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


_CODECS: dict = {}


def _codec(content: bytes, pattern: str, max_pieces: int) -> Codec:
    key = hashlib.sha256(content + pattern.encode()).digest() + max_pieces.to_bytes(8, "little")
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Vocabulary(content, pattern), max_pieces)
    return _CODECS[key]


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; executors get its content (under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text each, at least one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)] if len(batch) else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text", max_pieces: int = 600_000, batch_bytes: int = 16 << 20) -> DataFrame:
    """(id, ids): the ids of each whole text, as an array of INT.  Null text has no ids."""
    return _run(docs, path, pattern, id_column, text_column, max_pieces, batch_bytes, False)


def digests(docs: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text", max_pieces: int = 600_000, batch_bytes: int = 16 << 20) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text: encoded, then decoded from the ids."""
    return _run(docs, path, pattern, id_column, text_column, max_pieces, batch_bytes, True)


def _run(docs, path, pattern, id_column, text_column, max_pieces, batch_bytes, digest) -> DataFrame:
    given = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    name, kind = f"`{id_column}`", given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern, max_pieces)
        for batch in _chunks(batches, batch_bytes):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = codec.encode(texts)
            if digest:
                columns = [
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in found], pa.string()),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns, names = [pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], ["ids"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[id_column, *names])

    rest = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    return given.mapInArrow(run, f"{name} {kind}, {rest}")


def decode(encoded: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id") -> DataFrame:
    """(id, text): the inverse of :func:`encode`; null ids decode to empty text.

    Ids cut out of a longer text can end inside a character; such bytes become U+FFFD.
    """
    given = encoded.select(F.col(f"`{id_column}`").alias("id"), F.col("ids"))
    content = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern, 600_000)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_column, "text"])

    return given.mapInArrow(run, f"`{id_column}` {given.schema['id'].dataType.simpleString()}, text string")
