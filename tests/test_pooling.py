"""Windows are pooled where they are, and cut once for several classifiers."""

import pytest

from logweave.operators import features
from logweave.plans import flows


def _windows(spark):
    rows = [
        ("a", 0, 3, [2, 3, 2], 4), ("a", 1, 2, [3, 9, 2], 0), ("b", 0, 0, [2, 2, 2], 1), ("b", 1, 3, [2, 7, 4], 1), ("c", 0, 1, [], 0),
    ]
    return spark.createDataFrame(rows, "session_id string, window_idx long, length int, ids array<int>, anomaly int")


def _pooled(made):
    return {(r.session_id, r.window_idx): [round(x, 9) for x in r.features] for r in made.collect()}


def test_pooling_in_place_moves_no_window(spark, monkeypatch):
    given = spark.createDataFrame([(2, [1.0, 2.0]), (3, [0.5, -1.0]), (4, [0.0, 0.25]), (4, [3.0, 0.0]), (None, [9.0, 9.0])], "template_id int, vec array<double>")
    windows = _windows(spark)
    inside = features.mean_pooled(windows, given, 3, 2, 1)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    monkeypatch.setattr(features, "HELD_NUMBERS", 0)
    joined = features.mean_pooled(windows, given, 3, 2, 1)
    expected = {("a", 0): [2.5, 3.0], ("a", 1): [0.5, -1.0], ("b", 0): [0.0, 0.0], ("b", 1): [4.0, 2.25], ("c", 0): [0.0, 0.0]}
    assert _pooled(inside) == _pooled(joined) == {k: [round(x / 3, 9) for x in v] for k, v in expected.items()}


def test_null_components_are_not_held(spark):
    given = spark.createDataFrame([(2, [1.0, None])], "template_id int, vec array<double>")
    assert features._held(given, "template_id", 2) is None
    assert features._held(spark.createDataFrame([], given.schema), "template_id", 2)[1].tolist() == [[0.0, 0.0]]


@pytest.mark.parametrize("kind", ["embedding", "tfidf"])
def test_windows_cut_once_give_the_same_metrics(spark, kind):
    words = ["open file", "close file", "read block", "lost node"]
    lines = spark.createDataFrame(
        [(f"s{k % 9}", k, words[(k * k + k // 5) % 4], int((k * k + k // 5) % 4 == 3)) for k in range(90)],
        "session_id string, line_id long, template string, label int")
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate(["open", "file", "close", "read", "node"])], "token string, vec array<double>")
    cut = flows.cut_windows(lines, 4, 1)
    assert flows.window_classification(lines, 4, 1, features=kind, vectors=vectors, cut=cut).first() == flows.window_classification(
        lines, 4, 1, features=kind, vectors=vectors).first()
