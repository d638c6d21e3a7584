import pytest

from spindrel import api
from spindrel.operators import graph


def test_functions(spark):
    assert api.cosine_similarity(spark, [1, 0], [1, 1]) == pytest.approx(0.5**0.5)
    with pytest.raises(ValueError):
        api.cosine_similarity(spark, [1], [1, 2])
    assert [i for i, _ in api.retrieve(spark, [1, 0], [[1, 0], [0, 1], [1, 1]], 2)] == [0, 2]
    assert api.classify(spark, [1, 0.05], [[1, 0]])[0] == "Self"
    assert api.classify(spark, [0, 1], [[1, 0]])[0] == "NonSelf"
    assert set(api.latency_percentiles(spark, [5000] * 10)) == {"p50", "p95", "p99", "p99.9"}


def test_engine(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b")], "id bigint, vector array<double>, tenant_id string")
    edges = graph.build(spark.createDataFrame([(1, 2, 0.5, 0)], "a bigint, b bigint, weight double, seq bigint"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "request_id bigint, vector array<double>")
    engine = api.Engine(vectors, edges)
    assert engine.query(asked).first().hits == 2 and engine.query(asked, tenant="a").first().hits == 1
    paid = engine.deposit(spark.createDataFrame([(0, 1, 2, 4.0), (1, 1, 2, -3.0), (2, 1, 2, float("nan"))], "seq bigint, src bigint, dst bigint, amount double"))
    view = paid.graph_view().first()
    assert view.level == 5.0 and view.highway
