import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from logweave.ml.transformers import (
    FirstSeenIndexer,
    FrameWindower,
    GapChunkSessionizer,
    LogFeatureExtractor,
    LogFeatureModel,
)
from logweave.operators import detect, features, vocab, windows
from logweave.plans import flows


@pytest.fixture(scope="module")
def log(spark):
    """Sessions that repeat 'open read close'; anomalous ones contain 'BadBlock error'."""
    rng = random.Random(0)
    rows, line = [], 0
    for s in range(30):
        bad = s % 3 == 0
        for i in range(rng.randint(8, 20)):
            template = ["open File", "read File", "close File"][i % 3]
            label = int(bad and i % 5 == 4)
            rows.append((f"s{s}", line, i, "BadBlock error" if label else template, label))
            line += 1
    return spark.createDataFrame(rows, "session_id string, line_id long, pos long, template string, label int")


def test_stages_chain_and_persist(spark, log, tmp_path):
    timed = log.withColumn("ts", F.timestamp_seconds(F.col("line_id") * 5))
    stages = PipelineModel([
        GapChunkSessionizer(inputCol="ts", outputCol="group", interval=60),
        FirstSeenIndexer(inputCol="template", outputCol="ID"),
        FrameWindower(inputCol="ID", outputCol="frames", windowSize=4, stride=2),
    ])
    made = stages.transform(timed)
    stages.write().overwrite().save(str(tmp_path / "stages"))
    again = PipelineModel.load(str(tmp_path / "stages")).transform(timed)
    assert sorted(made.collect()) == sorted(again.collect())
    assert made.columns == ["group", "frame_idx", "frames", "labels"]


def test_indexer_continues_a_mapping(spark, log):
    prior = spark.createDataFrame([("read File", 7), ("gone", 9)], "template string, ID int")
    indexer = FirstSeenIndexer(inputCol="template", outputCol="ID").setMapping(prior)
    got = {r.template: r.ID for r in indexer.transform(log).select("template", "ID").distinct().collect()}
    assert got == {"read File": 7, "open File": 10, "close File": 11, "BadBlock error": 12}


def test_late_features_equal_carried_ones(spark, log):
    """The mean of the dense rows that windows carry, and of the rows that are looked up by number, are the same."""
    train, test = log.where("session_id < 's2'"), log.where("session_id >= 's2'").withColumn(
        "template", F.when(F.col("pos") == 1, "NewThing File").otherwise(F.col("template")))
    model = LogFeatureExtractor(featureType="semantics", windowSize=4, stride=2, useTfidf=True).fit(train)
    made, dictionary = model.transform_late(test)
    sparse = {(r.session_id, r.window_idx, r.token_id): r.weight for r in features.window_tfidf(made, dictionary, 4).collect()}
    dense = {}
    for r in model.transform(test).collect():
        for token in range(model.vocab_size()):
            if total := sum(line[token] for line in r.features):
                dense[r.session_id, r.window_idx, token] = total / 4
    assert sparse.keys() == dense.keys() and all(abs(sparse[k] - dense[k]) < 1e-12 for k in dense)
    # A window is as long as its lines.
    assert {len(r.feature_ids) for r in made.collect()} == {4}
    whole = LogFeatureExtractor(featureType="semantics", windowSize=4, stride=2).fit(train).transform(test)
    assert {0, 2, 3} >= {len(line) for r in whole.collect() for line in r.features} >= {2, 3}


@pytest.mark.parametrize("kind,tfidf", [("sequentials", False), ("quantitatives", False), ("semantics", False), ("semantics", True)])
def test_extractor_round_trip(spark, log, tmp_path, kind, tfidf):
    train, test = log.where("session_id < 's2'"), log.where("session_id >= 's2'").withColumn(
        "template", F.when(F.col("pos") == 1, "NewThing here").otherwise(F.col("template")))
    model = LogFeatureExtractor(featureType=kind, windowSize=4, stride=2, maxTokenLen=3, useTfidf=tfidf).fit(train)
    made = model.transform(test)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = LogFeatureModel.load(str(tmp_path / "model"))
    assert loaded.uid == model.uid
    columns = ["session_id", "window_idx", "features", "next_id", "anomaly"]
    assert sorted(made.select(columns).collect()) == sorted(loaded.transform(test).select(columns).collect())
    [meta] = loaded.metadata().collect()
    assert meta.num_labels == 6
    row = made.where("session_id = 's20' and window_idx = 0").first()
    if kind == "quantitatives":
        assert len(row.features) == 5 and sum(row.features) == 4
    if kind == "semantics":
        # open/file/read/close/bad/block/error and the two reserved entries
        assert meta.vocab_size == 9 and len(row.features) == 4
        assert all(len(f) == (9 if tfidf else 3) for f in row.features)
        if not tfidf:
            assert row.features[1] == [1, 1, 1]  # new, thing, here: all unknown
            # alphabetical ids: bad 2, block 3, close 4, error 5, file 6, open 7, read 8
            assert row.features[0] == [7, 6, 0]


def test_classifiers_find_the_pattern(spark, log):
    for kind in ("counts", "patterns"):
        row = flows.window_classification(log, 4, 1, features=kind).first()
        assert row.f1 > 0.9


def test_perceptron(spark, log):
    data = flows.prepare(log)
    made = features.count_features(windows.sliding_windows(data.train, 4), data.vocab_size())
    model = detect.fit_classifier(made, "perceptron", layers=[data.vocab_size() - 1, 6, 2])
    scored = detect.score_classifier(model, made)
    # A window's label also covers its next event, which its counts do not show: such windows cannot
    # be told from normal ones. On the others the classes are separable.
    shown = F.exists("an_classes", lambda c: c > 0)
    visible = scored.where((F.col("anomaly") == 0) | shown)
    assert visible.where("flag = anomaly").count() / visible.count() > 0.95
    with pytest.raises(ValueError):
        detect.fit_classifier(made, "other")


def test_reconstruction_scores(spark, log, tmp_path):
    data = flows.prepare(log, train_anomaly_ratio=0.0)
    size = data.vocab_size()
    normal = windows.sliding_windows(data.train, 4)
    model = detect.fit_reconstruction(normal, size, components=2)
    test = windows.sliding_windows(data.test, 4)
    scored = detect.score_reconstruction(model, test, size)
    assert scored.where("score < 0").count() == 0
    detect.save_model(model, str(tmp_path / "pca"))
    again = detect.score_reconstruction(PipelineModel.load(str(tmp_path / "pca")), test, size)
    key = ["session_id", "window_idx", "score"]
    assert sorted(scored.select(key).collect()) == sorted(again.select(key).collect())
    # All directions kept: nothing is left over.
    full = detect.fit_reconstruction(normal, size, components=size - 1)
    assert detect.score_reconstruction(full, normal, size).where("score > 1e-9").count() == 0


def test_next_event_flow_separates(spark, log):
    metrics = {r.k: r for r in flows.next_event_detection(log, 4, order=2, k=3).collect()}
    assert set(metrics) == {1, 2, 3} and max(r.f1 for r in metrics.values()) > 0.9


def test_reconstruction_flow(spark, log):
    row = flows.reconstruction_detection(log, 0.3, 4, components=2).first()
    assert 0 <= row.f1 <= 1 and 0 <= row.acc <= 1


def test_new_templates(spark, log):
    test = log.withColumn("template", F.concat("template", F.lit("!")))
    assert vocab.new_templates(test, log).count() == 4
    assert vocab.new_templates(log, log).count() == 0
