"""Quality rules by weak supervision, in DataFrame operations.

Each rule votes that a text is good (1) or bad (-1), or abstains (0): good within its sound range,
bad beyond its bounds, nothing in between.  Rules are not trusted alike: expectation-maximisation
over the counts of the vote patterns (at most 3 ** rules rows, whatever the input) estimates the
chances of each rule's three votes on good and on bad texts, and the share of good texts.  All
rules start from the same chances and none is held to a bound, so what a vote weighs comes from
how it agrees with the others.  The posterior probability of good decides: a lone bad vote of a
rule that is often alone with it rejects nothing, two weak ones that agree may.

Documents are not shuffled: words, repeated windows and lines are counted within the row by
array functions, in n log n; only vote patterns are aggregated.

Edge cases: null texts have no words, no votes, and fail the base rules; rows are judged one by
one, so repeated rows and ties get equal verdicts; an empty table gives an empty result and the
chances of the start; clashing column names are kept aside by :func:`filter_documents`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import written

#: The base rules: too few words, or too many of them within repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: (name, ratio, bad below, good from, good to, bad above)
RULES = (
    ("symbols to words", "n_symbols / n_words", None, 0.0, 0.02, 0.10),
    ("punctuation in words", "n_punct / word_chars", None, 0.005, 0.08, 0.15),
    ("distinct words", "n_distinct / n_words", 0.40, 0.50, 1.0, None),
    ("words in repeated windows", "n_repeat_words / n_words", None, 0.0, 0.20, 0.30),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.0, 0.20, 0.30),
    ("capitals", "n_upper / word_chars", None, 0.001, 0.10, 0.30),
    ("digits", "n_digits / word_chars", None, 0.0, 0.08, 0.20),
    ("words of one character", "n_short / n_words", None, 0.0, 0.10, 0.25),
    ("length of words", "word_chars / n_words", 2.5, 3.0, 7.0, 10.0),
)
_SPACE = r"[\x20\x09-\x0D]+"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts
    that the rules need (n_lines, n_upper, n_digits, n_short, n_distinct, n_punct); all are longs."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn("q_words", F.filter(F.split(body, _SPACE), lambda w: w != ""))
    out = out.withColumn("q_joined", F.array_join("q_words", ""))
    out = out.withColumn("q_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("q_words").cast("long"))
    # The hash of each word, then of each window; a text without a hash twice has no repeated window.
    out = out.withColumn("q_hash", F.transform("q_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("q_windows", F.when(F.col("n_words") > WINDOW, F.expr(f"transform(slice(q_hash, 1, greatest(size(q_hash) - {WINDOW - 1}, 0)), (h, i) -> xxhash64(h, q_hash[i + 1], q_hash[i + 2]))")).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), F.expr("array_sort(transform(q_windows, (h, i) -> struct(h as h, i as i)))")))
    out = out.withColumn("q_at", F.expr("array_sort(transform(filter(q_sorted, (s, k) -> s.h <=> get(q_sorted, k - 1).h or s.h <=> get(q_sorted, k + 1).h), s -> s.i))"))
    # A window adds the words that the next one does not begin within.
    out = out.withColumn("n_repeat_words", F.expr(f"coalesce(cast(aggregate(transform(q_at, (i, k) -> least({WINDOW}, coalesce(get(q_at, k + 1) - i, {WINDOW}))), 0, (a, x) -> a + x) as bigint), 0L)"))
    long = lambda c: c.cast("long")
    out = out.withColumns({
        "word_chars": long(F.length("q_joined")), "n_symbols": long(F.regexp_count(body, F.lit(r"[#*$%&|<>]"))), "n_lines": long(F.size("q_lines")),
        "n_dup_lines": long(F.size("q_lines") - F.size(F.array_distinct("q_lines"))), "n_upper": long(F.regexp_count("q_joined", F.lit(r"\p{Lu}"))), "n_digits": long(F.regexp_count("q_joined", F.lit("[0-9]"))),
        "n_short": long(F.size(F.filter("q_words", lambda w: F.length(w) == 1))), "n_distinct": long(F.size(F.array_distinct("q_hash"))), "n_punct": long(F.regexp_count("q_joined", F.lit(r"[^\p{L}\p{M}\p{N}]"))),
    })
    return out.drop("q_words", "q_joined", "q_lines", "q_hash", "q_windows", "q_sorted", "q_at")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_short", "n_distinct", "n_punct"]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes() -> Column:
    """The votes of all rules as one array of -1, 0 and 1; a text without words gets none."""

    def vote(ratio, low, a, b, high):
        x = "try_divide(cast({} as double), {})".format(*ratio.split(" / "))
        bad = " or ".join(f"{x} {sign} {bound}D" for sign, bound in (("<", low), (">", high)) if bound is not None)
        return f"case when n_words = 0 then 0 when {bad} then -1 when {x} between {a}D and {b}D then 1 else 0 end"

    return F.expr(f"array({', '.join(vote(*rule) for _, *rule in RULES)})")


#: Where the estimate starts, alike for all rules: the share of good texts, and the chances of a
#: bad vote, none and a good vote on good and on bad texts.  With these one bad vote among good
#: ones leaves a text good and two make it bad; a fault shows in few of the rules.
SHARE, GOOD, BAD = 0.8, (0.02, 0.10, 0.88), (0.25, 0.15, 0.60)

Chances = list[tuple[tuple[float, ...], tuple[float, ...]]]


def fit(patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 500, weight: float = 20.0) -> tuple[float, Chances]:
    """Expectation-maximisation over (votes, rows): the share of good texts, and of each rule the
    chances of its three votes on good and on bad texts.

    The start also counts as ``weight`` imagined rows of each kind, so that a rule that never
    votes, or an empty table, has chances too.
    """
    cast = np.array([v for v, _ in patterns], int).reshape(len(patterns), len(RULES))
    voted = np.stack([cast == kind for kind in (-1, 0, 1)], axis=2).astype(float)
    rows = np.array([n for _, n in patterns], float)
    begin = np.array([[GOOD] * len(RULES), [BAD] * len(RULES)])
    share, chances = SHARE, begin
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + np.tensordot(voted, np.log(chances[0] / chances[1]), 2)
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        hits = np.stack([np.tensordot(rows * part, voted, 1) for part in (good, 1 - good)]) + weight * begin
        chances = hits / hits.sum(2, keepdims=True)
        before, share = share, float((rows @ good + SHARE * weight) / (rows.sum() + weight))
        if abs(share - before) < 1e-10:
            break
    return share, [(tuple(g), tuple(b)) for g, b in zip(chances[0].tolist(), chances[1].tolist())]


def weights(share: float, chances: Chances) -> tuple[float, list[tuple[float, ...]]]:
    """The log odds of good: at the start, and what a bad vote, none and a good vote of each rule add."""
    return float(np.log(share / (1 - share))), [tuple(np.log(np.divide(g, b)).tolist()) for g, b in chances]


def judged(counted: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``counted`` (with the columns of :func:`measured`) with base_failed, posterior and kept."""
    voted = counted.withColumn("q_votes", votes())
    found = voted.groupBy("q_votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(RULES) rows
    start, each = weights(*fit(sorted((tuple(r["q_votes"]), r["n"]) for r in found)))
    odds = F.lit(start)
    for j, (bad, none, good) in enumerate(each):
        odds = odds + F.when(F.col("q_votes")[j] < 0, bad).when(F.col("q_votes")[j] > 0, good).otherwise(none)
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("q_votes")


def verdicts(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, posterior, kept."""
    counted = written(measured(docs.select("doc_id", "text")).select("doc_id", *COUNTS), "quality")
    return judged(counted, threshold=threshold).select("doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")


def filter_documents(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    safe = docs.toDF(*[c if c == "text" else f"given {c}" for c in docs.columns])
    kept = judged(written(measured(safe), "quality-docs"), threshold=threshold).where("kept")
    return kept.select(*[F.col(c if c == "text" else f"`given {c}`").alias(c) for c in docs.columns])
