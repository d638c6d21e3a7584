"""Every query against its SQL twin, on the smallest tables."""

import itertools
import json
import math
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from spindrel.registry import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "NULL"
        if isinstance(v, float):
            return f"{v + 0.0:.9g}"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, con, sf, name):
    found, wanted = queries()[name](spark, sf).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs_and_is_repeatable(spark, sf, name):
    first, again = (sorted(map(repr, queries()[name](spark, sf).collect())) for _ in range(2))
    assert first == again and first


def test_priority_in_any_order(spark, tmp_path):
    """The exact mean of these nodes is a tie, 3.5 tenths; sums of doubles fall on both sides."""
    rows, nodes = [], [(6, 2, 1), (8, 1, 1), (6, 7, 2)]  # usage, span of k, days
    for user, order in enumerate(list(itertools.permutations(nodes)) * 10):
        for kind, (usage, span, days) in zip("abc", order):
            rows += [(3 * user, kind, datetime(2024, 1, 1) + timedelta(days=i % days), json.dumps({"k": span if i else 0})) for i in range(usage)]
    spark.createDataFrame(rows, "user_id bigint, event_type string, ts timestamp, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.priority for r in queries()["priority_calc"](spark, str(tmp_path)).collect()} == {4}
