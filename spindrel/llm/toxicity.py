"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all training documents.  What looks written over
(digits or symbols among letters, a letter three times running, three or more characters that
stand alone in a row) becomes a lattice: a letter stands for itself, a repeated one perhaps once,
a symbol for the letters it is used for, for nothing, or for the end of a word, and so does the
space between characters that stand alone.  Viterbi finds the likeliest words under channel and
model, in time linear in the length, however long the token or the run; the restored text is
scored by a logistic model over words and word beginnings.

Labels are used only from rows whose crc32(doc_id as text) mod 3 is not 1, and of those at most
``fit_rows`` (the least by a hash of the id): they choose the features and fit the logistic
model.  The driver gathers the character counts (a table of fixed size), the features that weigh
enough among those rows, and ``fit_rows`` lists of them.  Scoring is one scan without a shuffle.

Edge cases: null and empty texts have no features and get the score of the intercept; without
labels every score is one half of nothing learned (the intercept zero); repeated rows get equal
scores; null ids hash like empty text; a label row without toxic, or without a document, is
left out; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import crc_of_id, written

#: What characters stand for in written-over words (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "%": "x", "#": "h"}
#: Costs of the channel, in natural logarithms: of a letter written as a symbol, of a symbol that
#: is nothing or ends a word, of a run of letters that is one, of a space that is nothing.
COST_LEET, COST_DROP, COST_RUN, COST_GAP = 1.0, 2.5, 0.7, 0.5
_LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåçèéêëíìîïñóòôöõúùûüßœæ"
#: Classes of characters for the model: 0 is what stands outside of words.
_CLASS = {c: i + 1 for i, c in enumerate(_LETTERS)}
SIZE = 64
_ODD = re.compile(r"[^\W\d_][^\s]*[\d@$!|+(€£%#*._-][^\s]*[^\W\d_]|^[\d@$!|+(€£%#][^\W\d_]|[^\W\d_][\d@$!|+€£]|([^\W\d_])\1\1")
#: So many characters that stand alone in a row are read as one run.
SPACED = 3
_EDGES = "\"'.,;:!?()[]{}<>*#$%&|-_/\\~`"


class Model:
    """-log p of a character after two others, as a table of SIZE ** 3."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        used = len(_LETTERS) + 1
        two = counts.sum(0)
        one = two.sum(0)
        p1 = (one + 1) / (one.sum() + used)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (counts + 5 * p2) / (counts.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()


def class_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the character triples of lower-cased texts, blanks before and behind."""
    table = np.zeros(0x250, np.uint8)
    for c, i in _CLASS.items():
        table[ord(c)] = i
    joined = "\n\n" + "\n\n".join(t.lower() for t in texts if t) + "\n\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], 0).astype(np.int64)
    keep = np.r_[True, (classes[1:] > 0) | (classes[:-1] > 0)]  # one blank between words
    classes = classes[keep]
    index = (classes[:-2] * SIZE + classes[1:-1]) * SIZE + classes[2:]
    return np.bincount(index, minlength=SIZE**3)


def options(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of ``n`` times the character may be, with its cost; a space ends a word."""
    if c in _CLASS:
        found = [(c * min(n, 2), 0.0 if n <= 2 else COST_RUN)]
        if n > 1:
            found.append((c, COST_RUN))
    elif c == " ":
        found = [(" ", 0.0), ("", COST_GAP)]
    else:
        price = COST_DROP if n == 1 else COST_RUN + COST_DROP
        found = [("", price), (" ", price)]
    return found + [(x * k, COST_LEET * k if k == n else COST_LEET + COST_RUN) for x in LEET.get(c, "") for k in {1, min(n, 2)}]


def decode(text: str, model: Model) -> tuple[float, str]:
    """(cost, words) of the likeliest reading of what is written over, by Viterbi."""
    cost = model.cost
    # a state is the classes of the last two characters; its history a chain of what was read
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for c, run in itertools.groupby(text.lower()):
        given = options(c, sum(1 for _ in run))
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (total, history) in states.items():
            for written_as, price in given:
                x, y, value = a, b, total + price
                for letter in written_as:
                    if letter == " " and not y:
                        continue  # no word to end
                    z = _CLASS.get(letter, 0)
                    value += cost[x][y][z]
                    x, y = y, z
                if (x, y) not in after or value < after[(x, y)][0]:
                    after[(x, y)] = (value, (history, written_as))
        states = after
    best, history = min(((total + (cost[a][b][0] if b else 0.0), history) for (a, b), (total, history) in states.items()), key=lambda x: x[0])
    parts = []
    while history:
        history, written_as = history
        parts.append(written_as)
    return best, "".join(reversed(parts))


def restore(text: str, model: Model) -> str:
    """The likeliest words of what is written over, one space apart."""
    return " ".join(decode(text, model)[1].split())


#: A feature weighs enough if its log odds times the root of its rows are so far from even.
MIN_WEIGHT = 6.0
#: Beginnings of words of these sizes are features, besides whole words.
PREFIXES = (4, 5, 6, 7)


class Restorer:
    """Words of texts, written-over ones restored; what was restored once is kept."""

    def __init__(self, model: Model, bound: int = 400_000):
        self.model, self.bound, self.known = model, bound, {}

    def _token(self, token: str) -> tuple[str, ...]:
        plain = token.strip(_EDGES)
        out = [plain] if plain.isalpha() else []
        if _ODD.search(token):
            out += [x for given in dict.fromkeys((token, plain)) for x in restore(given, self.model).split()]
        elif not out and plain:
            out = [x for x in re.split(r"[\W\d_]+", plain) if x]
        return tuple(x for x in dict.fromkeys(out) if x)

    def words(self, text: str | None) -> set[str]:
        if not text:
            return set()
        if len(self.known) > self.bound:
            self.known.clear()
        text = text.lower()
        found: set[str] = set()
        tokens = text.split()
        for token in set(tokens):
            if (got := self.known.get(token)) is None:
                got = self.known[token] = self._token(token)
            found.update(got)
        for alone, run in itertools.groupby(tokens, lambda t: len(t) == 1):
            if alone and len(spaced := list(run)) >= SPACED:
                found.update(restore(" ".join(spaced), self.model).split())
        found.discard("")
        return found


def features(words: set[str]) -> set[str]:
    return {f"={w}" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


_STATE: dict = {}


def _restorer(counts: np.ndarray) -> Restorer:
    key = hash(counts.tobytes())
    if _STATE.get("key") != key:
        _STATE.clear()
        _STATE.update(key=key, restorer=Restorer(Model(counts)))
    return _STATE["restorer"]


def character_counts(docs: DataFrame) -> np.ndarray:
    """Character triples of the training documents, summed over all tasks."""

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 500):
                total += class_counts(texts[i : i + 500])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    rows = docs.where(crc_of_id() % 3 != 1).select("text").mapInArrow(run, "at int, n bigint")
    out = np.zeros(SIZE**3, np.int64)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 64 ** 3 rows
        out[r["at"]] = r["n"]
    return out


def fit_logistic(rows: list[list[int]], labels: np.ndarray, size: int, *, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on sparse 0/1 rows; the two labels
    count alike, however rare one is."""
    if not len(rows):
        return np.zeros(size), 0.0
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    counts = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    at = np.fromiter((j for r in rows for j in r), np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, w, b = len(rows), np.zeros(size), 0.0
    seen = np.bincount(at, weights=counts[of], minlength=size)
    momentum, scale = np.zeros(size + 1), 1.0 / (0.25 * (seen + 1) * 4 + ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(of, weights=w[at], minlength=n), -30, 30)))
        error = (p - labels) * counts
        step = np.append((np.bincount(at, weights=error[of], minlength=size) + ridge * w) * scale, error.mean())
        momentum = 0.8 * momentum + step
        w, b = w - momentum[:-1], b - float(momentum[-1])
    return w, b


class Scorer:
    def __init__(self, counts: np.ndarray, weights: dict[str, float], intercept: float):
        self.counts, self.weights, self.intercept = counts, weights, intercept

    def __call__(self, words: set[str]) -> float:
        total = self.intercept + sum(self.weights.get(f, 0.0) for f in features(words))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 20_000, min_weight: float = MIN_WEIGHT, min_rows: int = 3) -> Scorer:
    """The character model of ``docs`` and the logistic model of the labelled training rows."""
    counts = character_counts(docs)
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    marked = labels.where(F.col("toxic").isNotNull() & (crc_of_id() % 3 != 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.where(crc_of_id() % 3 != 1).select("doc_id", "text").join(F.broadcast(few), "doc_id")  # two numbers a row, fit_rows of them

    def run(batches):
        restorer = _restorer(sent.value)
        for batch in batches:
            found = [sorted(features(restorer.words(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "features"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    read = written(rows.select("doc_id", "text", "toxic").mapInArrow(run, f"doc_id {kind}, toxic int, features array<string>"), "toxic-features")
    n, positive = read.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not positive or positive == n:
        return Scorer(counts, {}, 0.0)
    each = read.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (positive + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - positive + 1.0))
    # What weighs: how far the odds are from even, by how many rows stand behind them.
    chosen = each.where((F.col("n") >= min_rows) & (F.abs(odds) * F.sqrt("n") >= min_weight)).orderBy("feature")
    names = [r["feature"] for r in chosen.select("feature").collect()]  # features of at most fit_rows documents
    numbers = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def own(batches):
        place = numbers.value
        for batch in batches:
            found = [sorted(place[f] for f in row if f in place) for row in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])

    sample = read.mapInArrow(own, f"doc_id {kind}, toxic int, features array<int>").orderBy("doc_id").collect()  # short lists of at most fit_rows documents
    weights, intercept = fit_logistic([r["features"] for r in sample], np.array([r["toxic"] for r in sample], float), len(names))
    return Scorer(counts, dict(zip(names, weights.tolist())), intercept)


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, fit_rows: int = 20_000, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    scorer = train(docs, labels, fit_rows=fit_rows, min_weight=min_weight)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        model = sent.value
        restorer = _restorer(model.counts)
        weight: dict[str, tuple[tuple[str, float], ...]] = {}
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                hits: dict[str, float] = {}
                for word in restorer.words(text):
                    if (got := weight.get(word)) is None:
                        if len(weight) > 400_000:
                            weight.clear()
                        got = weight[word] = tuple((f, model.weights[f]) for f in features({word}) if f in model.weights)
                    if got:
                        hits.update(got)
                scores.append(float(1 / (1 + np.exp(-np.clip(model.intercept + sum(hits.values()), -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", (crc_of_id() % 3 == 1).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
