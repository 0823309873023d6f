"""Worked cases, one per operator."""

import pytest
from pyspark.sql import functions as F

from logweave.functions import columns as C
from logweave.operators import evaluate, features, normalize, sessions, splits, vocab, windows


def lines_of(spark, templates, labels, session="s"):
    rows = [(session, i, i, t, l) for i, (t, l) in enumerate(zip(templates, labels))]
    return spark.createDataFrame(rows, "session_id string, line_id long, pos long, template string, label int")


def test_anchored_sessions(spark):
    secs = [0, 30, 60, 61, 100, 125, 122, 200]
    df = spark.createDataFrame(list(enumerate(secs)), "line_id long, sec long")
    got = [r.session_id for r in sessions.anchored_sessions(df, 60).orderBy("line_id").collect()]
    assert got == [0, 0, 0, 61, 61, 125, 125, 200]


def test_gap_chunk_sessions(spark):
    df = spark.createDataFrame(list(enumerate([0, 5, 12, 40, 41, 55])), "line_id long, t long").select(
        "line_id", F.timestamp_seconds("t").alias("ts"))
    got = [r.session_id for r in sessions.gap_chunk_sessions(df, 10).orderBy("line_id").collect()]
    assert got == [1, 1, 2, 3, 3, 4]
    with pytest.raises(ValueError):
        sessions.gap_chunk_sessions(df, 0)


def test_sliding_windows_and_features(spark):
    lines = lines_of(spark, "ABCAD", [0, 0, 1, 0, 0])
    ids = spark.createDataFrame([("A", 2), ("B", 3), ("C", 4), ("D", 5)], "template string, template_id int")
    coded = vocab.encode_templates(lines, ids)
    made = features.quantitative(windows.sliding_windows(coded, 3, text=True), 6).orderBy("window_idx").collect()
    assert [r.window for r in made] == [list("ABC"), list("BCA"), ["C", "A", "PADDING"]]
    assert [r.next_id for r in made] == [2, 5, 5]
    assert [r.anomaly for r in made] == [1, 1, 1]
    assert [r.ids for r in made] == [[2, 3, 4], [3, 4, 2], [4, 2, 1]]
    assert [r.features for r in made] == [[0, 1, 1, 1, 0], [0, 1, 1, 1, 0], [1, 1, 0, 1, 0]]
    assert [r.an_classes for r in made] == [[0, 0, 4], [0, 4, 0], [4, 0, 0]]
    compat = windows.sliding_windows(coded, 3, compat=True).orderBy("window_idx").collect()
    assert [r.an_classes for r in compat] == [[0, 0, 4], [0, 4, 0], [0, 0, 4]]
    assert windows.sliding_windows(coded, 3, tail=False).count() == 2
    sparse = features.count_features(windows.sliding_windows(coded, 3), 6).orderBy("window_idx").collect()
    assert [list(r.features.toArray()) for r in sparse] == [list(map(float, r.features)) for r in made]


def test_one_line_session(spark):
    coded = vocab.encode_templates(
        lines_of(spark, "A", [0]), spark.createDataFrame([("A", 2)], "template string, template_id int"))
    [row] = windows.sliding_windows(coded, 3, text=True).collect()
    assert (row.window, row.next_id, row.length) == (["PADDING"] * 3, 2, 0)


@pytest.mark.parametrize("size,stride,compat,expected", [
    (3, 1, False, [[1, 2, 3], [2, 3, 4], [3, 4, 5]]),
    (3, 1, True, [[1, 2, 3], [2, 3, 4], [3, 4, 5]]),
    (3, 2, False, [[1, 2, 3], [3, 4, 5], [5, 0, 0]]),
    (3, 2, True, [[1, 2, 3]]),
    (4, 2, False, [[1, 2, 3, 4]]),
    (4, 2, True, [[1, 2, 3, 4]]),
])
def test_frame_windows(spark, size, stride, compat, expected):
    df = spark.createDataFrame([("g", i, 0) for i in range(1, 6)], "group string, id int, label int")
    made = windows.frame_windows(df, "id", size=size, stride=stride, compat=compat).orderBy("frame_idx")
    assert [r.window for r in made.collect()] == expected


def test_short_frame(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 0)], "group string, id int, label int")
    [row] = windows.frame_windows(df, "id", size=3).collect()
    assert (row.window, row.labels) == ([1, 2, 0], [1, 0, 0])


def test_tokens(spark):
    text = "Received block <*> from PacketResponder HTTPServer dfs.DataNode$DataXceiver: IOException"
    df = spark.createDataFrame([(text,)], "t string")
    [row] = df.select(C.tokens(F.col("t")).alias("a"), C.tokens(F.col("t"), lower_first=True).alias("b")).collect()
    assert row.a == ("received block from packet responder http server dfs data node data xceiver io exception").split()
    assert row.b == "received block from packetresponder httpserver dfs datanode dataxceiver ioexception".split()


def test_tfidf(spark):
    lines = spark.createDataFrame([("a b",), ("a",)], "template string")
    tokens = vocab.stored(vocab.token_vocabulary(lines))
    made = features.tfidf(lines, lines, tokens)
    got = {(r.template, r.token_id): round(r.weight, 6) for r in made.collect()}
    assert got == {("a b", 2): 0.415720, ("a b", 3): 0.584280, ("a", 2): 1.0}
    dense = {r.template: r.features for r in features.dense_tfidf(made, 4).collect()}
    assert [round(x, 6) for x in dense["a b"]] == [0, 0, 0.415720, 0.584280]


def test_hit_flags(spark):
    df = spark.createDataFrame([("s", 0, 5, 1, [2, 5, 3]), ("s", 1, 9, 0, [2, 5, 3])],
                               "session_id string, window_idx int, next_id int, anomaly int, topk array<int>")
    got = {(r.window_idx, r.k): r.flag for r in evaluate.flags_per_k(df, 3).collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [1, 0, 0]
    assert [got[1, k] for k in (1, 2, 3)] == [1, 1, 1]


def test_percentile_threshold(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "score double")
    cut = evaluate.percentile(df, 1 - 0.3)
    assert cut.first().threshold == pytest.approx(3.8)
    assert sorted(r.score for r in evaluate.flag_above_threshold(df, cut).where("pred = 1").collect()) == [4, 5]


def test_class_report(spark):
    df = spark.createDataFrame([([0, 4], 1), ([3, 0], 0)], "an_classes array<int>, flag int")
    report = evaluate.class_report(df)
    got = {r["class"]: (round(r.pc, 6), r.rc, round(r.f1, 6)) for r in report.collect()}
    assert got == {0: (0.666667, 1.0, 0.8), 3: (0.0, 0.0, 0.0), 4: (1.0, 1.0, 1.0)}
    macro = evaluate.macro_average(report).first()
    assert (round(macro.pc, 6), round(macro.rc, 6), round(macro.f1, 6)) == (0.555556, 0.666667, 0.6)
    counts = evaluate.anomaly_line_counts(df).first()
    assert tuple(counts) == (1, 2, 1, 2, 4)
    assert {r["class"]: (r.predicted, r.actual) for r in evaluate.class_counts(df).collect()} == {0: (3, 2), 3: (0, 1), 4: (1, 1)}


@pytest.mark.parametrize("n,train,test", [(10, 8, 2), (4, 3, 0)])
def test_split_counts(spark, n, train, test):
    df = spark.createDataFrame([(f"s{i}", i) for i in range(n)], "session_id string, first_line long")
    for random in (False, True):
        got = {r.split: r["count"] for r in splits.split_sessions(df, 0.2, random=random).groupBy("split").count().collect()}
        assert (got.get("train", 0), got.get("test", 0)) == (train, test)


def test_ordered_split_leaves_a_gap_and_ratios_are_checked(spark):
    df = spark.createDataFrame([(f"s{i}", i) for i in range(10)], "session_id string, first_line long")
    got = {r.session_id: r.split for r in splits.split_sessions(df, 0.3, train_ratio=0.5, random=False).collect()}
    assert got == {**{f"s{i}": "train" for i in range(5)}, **{f"s{i}": "test" for i in (7, 8, 9)}}
    with pytest.raises(ValueError):
        splits.split_sessions(df, 0.6, train_ratio=0.5)


def test_missing_labels(spark):
    rolled = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, length int")
    labels = spark.createDataFrame([("a", 1)], "entity_id string, label int")
    with pytest.raises(KeyError):
        normalize.label_sessions(rolled, labels)
    got = {r.session_id: r.label for r in normalize.label_sessions(rolled, labels, on_missing="zero").collect()}
    assert got == {"a": 1, "b": 0}


def test_normalize_families(spark):
    hdfs = spark.createDataFrame([(1, 81109, 203518, "got blk_-7 and blk_1", "E1"), (2, 91109, 7, "nothing", "E2")],
                                 "LineId int, Date int, Time int, Content string, EventTemplate string")
    labels = spark.createDataFrame([("blk_-7", 1), ("blk_1", 0)], "entity_id string, label int")
    got = [(str(r.ts), r.label) for r in normalize.normalize(hdfs, "hdfs", labels).orderBy("line_id").collect()]
    assert got == [("2009-11-08 20:35:18", 1), ("2009-11-09 00:00:07", 0)]
    bgl = spark.createDataFrame([(1, "APPREAD", "2005-06-03-15.42.50.675872", "c", "E")],
                                "LineId int, Label string, Time string, Content string, EventTemplate string")
    [row] = normalize.normalize(bgl, "bgl").collect()
    assert (str(row.ts), row.label) == ("2005-06-03 15:42:50.675872", 1)
    bird = spark.createDataFrame([(1, "-", "2005.11.09", "12:01:01", "c", "E")],
                                 "LineId int, Label string, Date string, Time string, Content string, EventTemplate string")
    [row] = normalize.normalize(bird, "thunderbird").collect()
    assert (str(row.ts), row.label) == ("2005-11-09 12:01:01", 0)
    with pytest.raises(ValueError):
        normalize.normalize(bird, "other")


def test_seconds_truncate_toward_zero(spark):
    df = spark.createDataFrame([(0, 10.5), (1, 9.8), (2, 12.2), (3, 8.4)], "line_id long, t double").select(
        "line_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    assert [r.sec for r in normalize.seconds_since_first(df).orderBy("line_id").collect()] == [0, 0, 1, -2]


def test_binary_metrics_of_nothing(spark):
    df = spark.createDataFrame([(0, 0)], "pred int, truth int")
    row = evaluate.binary_metrics(df).first()
    assert (row.f1, row.rc, row.pc, row.acc) == (0.0, 0.0, 0.0, 1.0)
    empty = evaluate.binary_metrics(df.where("pred = 1")).first()
    assert (empty.f1, empty.acc) == (0.0, 0.0)


def test_best_k_takes_the_larger_on_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.1)], "k int, f1 double")
    assert evaluate.best_k(df).first().k == 3


def test_mean_pooled(spark):
    made = spark.createDataFrame([("s", 0, [2, 3, 2], 3), ("s", 1, [3, 1, 1], 1), ("s", 2, [1, 1, 1], 0)],
                                 "session_id string, window_idx long, ids array<int>, length int")
    vectors = spark.createDataFrame([(2, [1.0, 2.0]), (3, [3.0, 0.0])], "template_id int, vec array<double>")
    pooled = features.mean_pooled(made, vectors, 3, 2, 1).orderBy("window_idx").collect()
    assert [r.features for r in pooled] == [pytest.approx([5 / 3, 4 / 3]), pytest.approx([1.0, 0.0]), [0.0, 0.0]]


def test_sparse_counts_of_a_large_vocabulary(spark):
    made = spark.createDataFrame([([99_999, 5, 5],)], "ids array<int>")
    vector = features.count_features(made, 100_000).first().features
    assert (vector.size, list(vector.indices), list(vector.values)) == (99_999, [4, 99_998], [2.0, 1.0])


def test_long_session_is_one_window(spark):
    lines = spark.range(70_000).selectExpr(
        "'s' AS session_id", "id AS pos", "cast(id % 7 AS string) AS template", "cast(id % 7 AS int) AS template_id", "cast(id = 5 AS int) AS label")
    made = windows.session_windows(lines)
    assert made.count() == 70_000
    assert [tuple(r) for r in made.select("length", "anomaly").distinct().collect()] == [(70_000, 1)]


def test_lines_without_key_or_time_stay(spark):
    rows = [(None, 0, 5), (None, 1, None), ("a", 2, None), ("a", 3, 7), ("a", 4, 500), (None, 5, 6)]
    df = spark.createDataFrame(rows, "user string, line_id long, sec long")
    got = {r.line_id: r.session_id for r in sessions.anchored_sessions(df, 60, partition_cols=["user"]).collect()}
    assert got == {0: 5, 1: 5, 2: None, 3: 7, 4: 500, 5: 5}
    timed = df.select("user", "line_id", F.timestamp_seconds("sec").alias("ts"))
    got = {r.line_id: r.session_id for r in sessions.gap_chunk_sessions(timed, 60, partition_cols=["user"]).collect()}
    assert got == {0: 1, 1: None, 2: None, 3: 1, 4: 2, 5: 1}


def test_empty_part_of_a_split_is_reported(spark):
    df = spark.createDataFrame([("train", 1), ("train", 0)], "split string, label int")
    assert {tuple(r) for r in splits.split_report(df).collect()} == {("train", 2, 50.0), ("test", 0, None)}


def test_repeated_entity_keeps_one_session(spark):
    rolled = spark.createDataFrame([("a", 1)], "session_id string, length int")
    labels = spark.createDataFrame([("a", 0), ("a", 1)], "entity_id string, label int")
    assert [r.label for r in normalize.label_sessions(rolled, labels).collect()] == [1]
