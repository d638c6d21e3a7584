"""Stateful operators over streams, with the results of their batch forms.

State is kept per stream or edge, so keys are spread over the cluster; the state of a detector
is its window and four numbers.  Rows of a micro-batch are taken in order of seq.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrel.operators import regulation

def _timeout(idle: str | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout


DETECTION = "stream_id string, seq bigint, min_distance double, closest_pattern_idx int, score double, is_anomaly boolean, fpr double"


def detect(events: DataFrame, patterns: np.ndarray, *, threshold: float = 0.7, window: int = 10_000, warmup: int = 50, idle: str | None = None) -> DataFrame:
    """Anomaly detection of events (stream_id, seq, vector), a detector per stream.

    ``patterns`` is a small matrix (see ``immune.as_matrix``); without patterns every event is
    an anomaly of score 1.  With ``idle`` (such as "1 day") a stream without events for so long is
    forgotten.
    """
    known = np.asarray(patterns, float)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, seen, calls, false, warm = state.get if state.exists else ([], 1.0, 0, 0, 0)
        recent = deque(recent, maxlen=window)
        total, squares = sum(recent), sum(d * d for d in recent)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, vector in zip(rows["seq"], rows["vector"]):
            calls += 1
            if not len(known):
                out.append((key[0], seq, float("inf"), -1, 1.0, True, 0.0))
                continue
            if len(vector) != known.shape[1]:
                raise ValueError(f"dimension mismatch: patterns have {known.shape[1]}")
            far = np.sqrt(((known - np.asarray(vector, float)) ** 2).sum(1))
            at = int(far.argmin())
            d = float(far[at])
            seen = max(seen, d)
            score = min(d / seen, 1.0)
            # running sums of the window, so an event costs the same whatever the window
            gone = recent[0] if len(recent) == window else 0.0
            recent.append(d)
            total, squares = total + d - gone, squares + d * d - gone * gone
            odd = score > threshold
            if calls >= warmup:
                warm += 1
                mean = total / len(recent)
                false += int(odd and len(recent) >= 2 and d <= mean + math.sqrt(max(squares / len(recent) - mean * mean, 0.0)))
            out.append((key[0], seq, d, at, score, odd, false / warm if warm else 0.0))
        state.update((list(recent), seen, calls, false, warm))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "min_distance", "closest_pattern_idx", "score", "is_anomaly", "fpr"])

    kept = "recent array<double>, seen double, calls bigint, false_n bigint, warm_n bigint"
    return events.select("stream_id", "seq", "vector").groupBy("stream_id").applyInPandasWithState(run, DETECTION, kept, "append", _timeout(idle))


BREAKER = "service string, seq bigint, ms bigint, failed boolean, state string, allowed boolean"


def breaker(events: DataFrame, *, idle: str = "10 minutes", **rule) -> DataFrame:
    """Requests (service, seq, ms, failed) with the state of the service's circuit breaker that
    each met and whether it was let through; a service that is idle so long starts anew."""
    full = dict(window_ms=60_000, open_ms=30_000, least=5, rate=0.2) | rule

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else (regulation.CLOSED, 0, [], [])
        rows = pd.concat(list(batches)).sort_values(["ms", "seq"])
        out = []
        for seq, ms, failed in zip(rows["seq"], rows["ms"], rows["failed"]):
            now, met, through = regulation.breaker_step(now, int(ms), bool(failed), **full)
            out.append((key[0], seq, ms, failed, met, through))
        state.update((now[0], now[1], list(now[2]), list(now[3])))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["service", "seq", "ms", "failed", "state", "allowed"])

    kept = "name string, opened bigint, failures array<bigint>, successes array<bigint>"
    return events.select("service", "seq", "ms", "failed").groupBy("service").applyInPandasWithState(run, BREAKER, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def deposit(events: DataFrame, *, low: float = 0.01, high: float = 10.0, start: float = 1.0) -> DataFrame:
    """(src, dst, level, deposit_count) of each edge touched, after deposits (seq, src, dst, amount)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, n = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for amount in rows["amount"]:
            level = max(min(level + amount, high), low)
        n += len(rows)
        state.update((level, n))
        yield pd.DataFrame([(*key, level, n)], columns=["src", "dst", "level", "deposit_count"])

    return events.select("src", "dst", "seq", "amount").groupBy("src", "dst").applyInPandasWithState(run, "src bigint, dst bigint, level double, deposit_count bigint", "level double, n bigint", "update", GroupStateTimeout.NoTimeout)
