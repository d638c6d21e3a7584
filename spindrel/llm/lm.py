"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

p(w | h) = a * c(h w) / c(h) + b * c(w) / N + g / (V + 1), where (a, b, g) belong to the bucket of
the context's frequency, floor(log2 c(h)).  The weights are learned by expectation-maximisation
on held-out counts: one in ``HELD_OUT`` of the training documents, whose own occurrence is
deleted from each count it is judged by.

Counts cover the whole corpus and never meet in one place.  Documents are dealt into groups; a
group asks for the counts of its distinct n-grams by 64-bit keys, in blobs by key range; the
task of a key range sums the training counts of all groups and answers each group with the sums
in the order asked; the groups then score their texts.  Each n-gram is sent once a group, not
once an occurrence, so a word of a third of all text is summed before the shuffle.  The driver
gathers N, V and a histogram with a bounded number of cells.

Edge cases: null and empty texts are the end token alone; with no training documents all
estimates but the uniform are zero; repeated rows are counted as often as they stand; null ids
hash like empty text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm import packing
from spindrel.llm.common import crc_of_id, written

HELD_OUT = 16
BUCKETS = 32
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: No word holds white space, so these stand for themselves.
_END, _START = b"\n", b"\t"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Grams:
    """The tokens of a group as numbers, its distinct n-grams and their keys."""

    def __init__(self, texts: list[bytes | None]):
        numbers = _Numbers({_END: 0, _START: 1})
        parts = []
        for text in texts:
            words = text.translate(_LOWER).split() if text else []
            words.append(_END)
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.token = np.concatenate(parts)
        del parts
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first] = 1
        self.words = len(numbers)
        pair = before.astype(np.int64) * self.words + self.token
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.pair_of = self.pair_of.astype(np.int32)
        hashes = packing.hash_words(list(numbers))
        left, right = hashes[self.pairs // self.words], hashes[self.pairs % self.words]
        one = packing.mix(hashes) & ~np.uint64(1)
        two = packing.mix(left * np.uint64(0x9E3779B97F4A7C15) ^ packing.mix(right + np.uint64(0x632BE59BD9B4E019))) | np.uint64(1)
        keys = np.concatenate([one, two])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, docs: np.ndarray) -> np.ndarray:
        """How often each n-gram, in the order of the keys, stands in the documents marked."""
        of = np.repeat(docs, self.sizes)
        one = np.bincount(self.token[of], minlength=self.words)
        return np.concatenate([one, np.bincount(self.pair_of[of], minlength=len(self.pairs))])[self.order]

    def answered(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words and of the pairs, from the sums in the order of the keys."""
        back = np.empty(len(sums), np.int64)
        back[self.order] = sums
        back[1] = back[0]  # as many starts as ends
        return back[: self.words], back[self.words :]


def _numbers_blob(x: np.ndarray) -> bytes:
    """Counts of four bytes each, or of eight where one needs them; the first byte says which."""
    width = 8 if len(x) and int(x.max()) >> 32 else 4
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(x.astype(f"<u{width}").tobytes())


def _blob_numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


def _texts(rows: pa.Table) -> list[bytes | None]:
    return rows.column("text").cast(pa.binary()).to_pylist()


def _ask(buckets: int, groups: int):
    def ask(key, table):
        rows = packing.joined(table.column("packed"))
        grams = _Grams(_texts(rows))
        # groups from ``groups`` on hold the held-out documents once more, to ask only
        train = ~rows.column("held_out").to_numpy(zero_copy_only=False) if key[0].as_py() < groups else np.zeros(len(rows), bool)
        counts = grams.counts(train)
        bucket = packing.bucket_of(grams.keys, buckets)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        found = [(b, packing.encode_sorted(grams.keys[x:y]), _numbers_blob(counts[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        b, k, c = zip(*found)
        return pa.table({"bucket": pa.array(b, pa.int32()), "grp": pa.array([key[0].as_py()] * len(b), pa.int32()), "keys": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary())})

    return ask


def _answer(key, table):
    """Sum the counts of a key range over all groups."""
    keys = [packing.decode_sorted(x) for x in table.column("keys").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate([_blob_numbers(x) for x in table.column("counts").to_pylist()]))
    cuts = np.cumsum([len(k) for k in keys])
    sums = [_numbers_blob(x) for x in np.split(total[at], cuts[:-1])]
    words = (distinct & np.uint64(1)) == 0
    own, none = [None] * len(keys), [None]
    return pa.table({
        "bucket": pa.array([key[0].as_py()] * (len(keys) + 1), pa.int32()), "grp": pa.array([*table.column("grp").to_pylist(), -1], pa.int32()), "sums": pa.array([*sums, *none], pa.binary()),
        "tokens": pa.array([*own, int(total[words].sum())], pa.int64()), "words": pa.array([*own, int((total[words] > 0).sum())], pa.int64()),
    })


def _sums(table: pa.Table) -> np.ndarray:
    order = np.argsort(table.column("bucket").to_numpy())
    blobs = table.column("sums").to_pylist()
    return np.concatenate([_blob_numbers(blobs[i]) for i in order])


def _estimates(grams: _Grams, one: np.ndarray, two: np.ndarray, tokens: int, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair: the bucket of its context, its bigram and its unigram estimate; ``less`` is
    deleted from every count."""
    context = np.maximum(one[grams.pairs // grams.words] - less, 0)
    bucket = np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)
    return bucket, np.maximum(two - less, 0) / np.maximum(context, 1), np.maximum(one[grams.pairs % grams.words] - less, 0) / max(tokens - less, 1)


#: Estimates are gathered in cells of a quarter of a power of two; the last cell is zero.
_CELLS = 256


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(np.round(-4 * np.log2(np.maximum(p, 1e-300))), _CELLS - 2), _CELLS - 1).astype(np.int64)


def _histogram(tokens: int):
    def gather(key, docs, answers):
        cells = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(docs):
            grams = _Grams(_texts(packing.joined(docs.column("packed"))))
            bucket, p2, p1 = _estimates(grams, *grams.answered(_sums(answers)), tokens, 1)
            cell = (bucket * _CELLS + _cell(p2)) * _CELLS + _cell(p1)
            cells, at = np.unique(cell, return_inverse=True)
            cells = cells, np.bincount(at, weights=np.bincount(grams.pair_of, minlength=len(cell))).astype(np.int64)
        return pa.table({"cell": pa.array(cells[0], pa.int64()), "n": pa.array(cells[1], pa.int64())})

    return gather


def learn(cells: dict[int, int], words: int, rounds: int = 100) -> np.ndarray:
    """Weights (bigram, unigram, uniform) by context bucket, from the held-out histogram.

    Each bucket counts one imagined token for each of the three, so none is ever zero; a
    bucket for unseen contexts has no bigram estimate, and its bigram weight ends at zero.
    """
    out = np.full((BUCKETS, 3), 1 / 3)
    cell = np.fromiter(cells, np.int64, len(cells))
    n = np.fromiter(cells.values(), np.float64, len(cells))
    value = lambda c: np.where(c == _CELLS - 1, 0.0, 2.0 ** (-c / 4))
    p = np.stack([value(cell // _CELLS % _CELLS), value(cell % _CELLS), np.full(len(cell), 1 / (words + 1))], 1)
    bucket = cell // _CELLS**2
    for b in range(BUCKETS):
        of, m = p[bucket == b], n[bucket == b][:, None]
        for _ in range(rounds):
            share = of * out[b]
            share /= share.sum(1, keepdims=True)
            new = (share * m).sum(0) + 1
            out[b] = new / new.sum()
    # Unseen contexts have no bigram estimate: its weight goes to the other two.
    out[0] = [0, out[0][1] / (out[0][1] + out[0][2]), out[0][2] / (out[0][1] + out[0][2])]
    return out


def _scored(tokens: int, words: int, weights: np.ndarray, id_type: pa.DataType):
    def score(key, docs, answers):
        rows = packing.joined(docs.column("packed"))
        grams = _Grams(_texts(rows))
        one, two = grams.answered(_sums(answers))
        bucket, p2, p1 = _estimates(grams, one, two, tokens, 0)
        w = weights[bucket]
        of_pair = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (words + 1))
        of_word = np.log10((one + 0.5) / (tokens + 0.5 * (words + 1)))
        known = np.add.reduceat((one > 0)[grams.token].astype(np.int64), grams.first)
        base, full = np.add.reduceat(of_word[grams.token], grams.first), np.add.reduceat(of_pair[grams.pair_of], grams.first)
        return pa.table({
            "doc_id": rows.column("doc_id").cast(id_type), "held_out": rows.column("held_out"), "n_tokens": pa.array(grams.sizes), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(rows), tokens), pa.int64()), "base_score": pa.array(base), "score": pa.array(full),
        })

    return score


def score(docs: DataFrame, *, group_bytes: int = 16 << 20) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id as text) mod 5 = 1 are held out and not learned from.
    """
    crc = crc_of_id()
    rows = docs.select("doc_id", "text", (crc % 5 == 1).alias("held_out"), ((crc % 5 != 1) & (F.floor(crc / 5) % HELD_OUT == 0)).alias("judge"))
    groups = packing.groups_for(rows, group_bytes)
    judges = -(-groups // HELD_OUT)
    names = ["doc_id", "held_out", "text"]
    packed = packing.pack(rows, groups, names)
    judging = packing.pack(rows.where("judge"), judges, names).withColumn("grp", F.col("grp") + groups)
    asked = packed.unionByName(judging).groupBy("grp").applyInArrow(_ask(groups, groups), "bucket int, grp int, keys binary, counts binary")
    answers = written(asked.groupBy("bucket").applyInArrow(_answer, "bucket int, grp int, sums binary, tokens bigint, words bigint"), "ngrams")
    tokens, words = (int(x or 0) for x in answers.where("grp = -1").agg(F.sum("tokens"), F.sum("words")).first())
    sums = answers.where("grp >= 0").select("grp", "bucket", "sums")
    cells = judging.groupBy("grp").cogroup(sums.where(F.col("grp") >= groups).groupBy("grp")).applyInArrow(_histogram(tokens), "cell bigint, n bigint")
    histogram = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most BUCKETS * 256 * 256
    weights = learn(histogram, words)
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return packed.groupBy("grp").cogroup(sums.where(F.col("grp") < groups).groupBy("grp")).applyInArrow(
        _scored(tokens, words, weights, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
