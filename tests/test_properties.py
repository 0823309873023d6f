"""Random inputs against plain loops, with limits set low enough to take every path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import loops
from logweave.operators import detect, evaluate, sessions, windows


def many_sessions(spark, lengths, seed=0):
    rng = random.Random(seed)
    data = {
        f"s{i}": [(rng.randint(2, 9), int(rng.random() < 0.15)) for _ in range(n)] for i, n in enumerate(lengths)
    }
    rows = [(s, p, t, l) for s, items in data.items() for p, (t, l) in enumerate(items)]
    rng.shuffle(rows)
    return data, spark.createDataFrame(rows, "session_id string, pos long, template_id int, label int")


@pytest.mark.parametrize("size,stride,chunk", [
    (10, 1, None), (10, 3, 16), (5, 5, 1), (3, 7, 16), (1, 1, 1), (4, 9, None), (4, 9, 1), (6, 2, 5),
])
def test_sliding_windows(spark, size, stride, chunk):
    data, lines = many_sessions(spark, [*range(1, 30), 61, 200])
    for compat in (False, True):
        made = windows.sliding_windows(lines, size, stride, chunk=chunk, compat=compat)
        got = {}
        for r in made.collect():
            got.setdefault(r.session_id, []).append((r.window_idx, r.ids, r.next_id, r.anomaly, r.an_classes))
        for session, items in data.items():
            ids, labels = [t for t, _ in items], [l for _, l in items]
            assert sorted(got[session]) == loops.sliding(ids, labels, size, stride, compat=compat), session


def test_sliding_windows_without_tail(spark):
    data, lines = many_sessions(spark, range(1, 25))
    got = {}
    for r in windows.sliding_windows(lines, 6, 4, tail=False, chunk=8).collect():
        got.setdefault(r.session_id, []).append((r.window_idx, r.ids, r.next_id, r.anomaly, r.an_classes))
    for session, items in data.items():
        ids, labels = [t for t, _ in items], [l for _, l in items]
        assert sorted(got.get(session, [])) == loops.sliding(ids, labels, 6, 4, tail=False)


def test_scalar_label(spark):
    _, lines = many_sessions(spark, [9, 5])
    made = windows.sliding_windows(lines.withColumn("label", F.when(F.col("session_id") == "s0", 1).otherwise(0)), 3, 7, scalar_label=True)
    assert {(r.session_id, r.anomaly) for r in made.collect()} == {("s0", 1), ("s1", 0)}


@pytest.mark.parametrize("size,stride,compat", [
    (3, 1, False), (3, 2, False), (4, 2, True), (5, 3, False), (5, 3, True), (2, 5, False), (6, 6, True),
])
def test_frame_windows(spark, size, stride, compat):
    groups = {g: list(range(1, g + 1)) for g in range(1, 25)}
    rows = [(g, v, v % 2) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "group int, id int, label int")
    made = windows.frame_windows(df, "id", size=size, stride=stride, compat=compat, chunk=4, part_rows=6)
    got = {}
    for r in made.orderBy("frame_idx").collect():
        got.setdefault(r.group, []).append(r.window)
    assert got == {g: f for g, v in groups.items() if (f := loops.frames(v, size, stride, compat))}


LOW = {"fold_seconds": 3, "part_rows": 40}


@pytest.mark.parametrize("sort,reach,limits", [
    (True, 5, LOW), (True, 60, {}), (False, 60, LOW), (False, 4000, LOW), (True, 4000, {}),
])
def test_anchored_sessions(spark, sort, reach, limits):
    rng = random.Random(reach)
    secs = [0] + [int(rng.expovariate(1 / 900) * 4) + i * 9 for i in range(400)]
    if sort:
        secs.sort()
    df = spark.createDataFrame(list(enumerate(secs)), "line_id long, sec long").repartition(5)
    got = {r.line_id: r.session_id for r in sessions.anchored_sessions(df, reach, **limits).collect()}
    assert [got[i] for i in range(len(secs))] == loops.anchored(secs, reach)


@pytest.mark.parametrize("limits", [{}, LOW])
def test_anchored_sessions_by_key(spark, limits):
    rng = random.Random(5)
    logs = {h: [rng.randint(0, 3000) for _ in range(n)] for h, n in (("a", 300), ("b", 1), ("c", 60))}
    rows = [(h, i, s) for h, secs in logs.items() for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "host string, line_id long, sec long").repartition(5)
    made = sessions.anchored_sessions(df, 50, partition_cols=["host"], **limits)
    got = {(r.host, r.line_id): r.session_id for r in made.collect()}
    for host, secs in logs.items():
        assert [got[host, i] for i in range(len(secs))] == loops.anchored(secs, 50)


@pytest.mark.parametrize("part_rows", [30, 1_000_000])
def test_gap_chunk_sessions(spark, part_rows):
    rng = random.Random(3)
    logs = {h: sorted(rng.randint(0, 4000) for _ in range(n)) for h, n in (("a", 200), ("b", 1), ("c", 90))}
    rows = [(h, i, t) for h, times in logs.items() for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "host string, i int, t long").select("host", "i", F.timestamp_seconds("t").alias("ts"))
    for interval in (7, 60):
        made = sessions.gap_chunk_sessions(df, interval, partition_cols=["host"], part_rows=part_rows)
        got = {(r.host, r.i): r.session_id for r in made.collect()}
        for host, times in logs.items():
            assert [got[host, i] for i in range(len(times))] == loops.gap_chunk(times, interval)
        alone = sessions.gap_chunk_sessions(df.where("host = 'a'"), interval, part_rows=part_rows).orderBy("i")
        assert [r.session_id for r in alone.collect()] == loops.gap_chunk(logs["a"], interval)


@pytest.mark.parametrize("n", [1, 7, 5000, 150_000])
def test_percentile(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 3 if n > 1000 else 9)
    df = spark.createDataFrame([(float(v),) for v in values], "score double") if n < 10_000 else (
        spark.range(n).select(F.round(F.sin(F.col("id") * 12.9898) * 43758.5453 % 1, 4).alias("score")))
    if n >= 10_000:
        values = np.array([r.score for r in df.collect()])
    for p in (0.0, 0.03, 0.2, 0.5, 0.97, 1.0):
        got = evaluate.percentile(df, p).first().threshold
        assert got == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)


def test_next_event_model_and_scores(spark):
    train, lines = many_sessions(spark, [40, 3, 1, 25, 60], seed=2)
    test, test_lines = many_sessions(spark, [30, 2, 1, 11], seed=3)
    size, order, k = 5, 3, 4
    model = detect.materialize(detect.fit_next_event(windows.sliding_windows(lines, size), order, k))
    cut = []
    for items in train.values():
        ids = [t for t, _ in items]
        for idx, window, nxt, _, _ in loops.sliding(ids, [0] * len(ids), size, 1):
            cut.append((ids[idx:min(idx + size, len(ids) - 1)], nxt))
    expected = loops.next_event_model(cut, order, k)
    assert {tuple(map(int, r.context.split())): r.topk for r in model.collect()} == expected
    # With and without a model small enough to broadcast.
    for rows in (1_000_000, 0):
        scored = detect.score_next_event(windows.sliding_windows(test_lines, size), model, order, broadcast_rows=rows)
        got = {(r.session_id, r.window_idx): r.topk for r in scored.collect()}
        assert len(got) == windows.sliding_windows(test_lines, size).count()
        for session, items in test.items():
            ids = [t for t, _ in items]
            for idx, *_ in loops.sliding(ids, [0] * len(ids), size, 1):
                assert got[session, idx] == loops.predict(expected, ids[idx:min(idx + size, len(ids) - 1)], order)


def test_topk_metrics_equal_flags_rolled_up(spark):
    rng = random.Random(9)
    rows = [(f"s{i % 17}", i, rng.randint(2, 8), int(rng.random() < 0.2), rng.sample(range(2, 9), 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "session_id string, window_idx int, next_id int, anomaly int, topk array<int>")
    direct = evaluate.binary_metrics(evaluate.sum_rollup(evaluate.flags_per_k(df, 4), ["session_id", "k"]), ["k"])
    assert sorted(evaluate.topk_metrics(df, 4).collect()) == sorted(direct.collect())


def test_select_best(spark):
    rng = random.Random(4)
    for patience in (1, 2, 3):
        for _ in range(2):
            f1s = [rng.randint(0, 5) / 5 for _ in range(rng.randint(1, 9))]
            table = spark.createDataFrame(list(enumerate(f1s, 1)), "candidate int, f1 double")
            assert tuple(detect.select_best(table, patience).first()) == loops.chosen(f1s, patience)
            tried = []
            def evaluate_one(f1):
                tried.append(f1)
                return spark.createDataFrame([(f1,)], "f1 double")
            assert tuple(detect.search(f1s, evaluate_one, patience, spark).first()) == loops.chosen(f1s, patience)
            assert len(tried) == loops.chosen(f1s, patience)[2]
