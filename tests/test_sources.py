import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from logweave.operators import detect
from logweave.sources import datasets, logs, models


def test_csv_keeps_empty_strings_and_quotes(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('LineId,Content,EventTemplate\n1,"a, ""b""",\n2,,"E 2"\n3,NA,null\n')
    rows = logs.read_structured_log(spark, str(path), "LineId long, Content string, EventTemplate string").collect()
    assert [tuple(r) for r in rows] == [(1, 'a, "b"', ""), (2, "", "E 2"), (3, "NA", "null")]


def test_entity_labels(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("BlockId,Label\nblk_1,Normal\nblk_-2,Anomaly\nblk_3,\n")
    rows = logs.read_entity_labels(spark, str(path)).collect()
    assert {r.entity_id: r.label for r in rows} == {"blk_1": 0, "blk_-2": 1, "blk_3": 0}


def test_id_sequences_and_caps(spark, tmp_path):
    (tmp_path / "hdfs_train").write_text("5 5 22\n 7\t8 \n")
    (tmp_path / "hdfs_test_normal").write_text("".join(f"{i}\n" for i in range(6)))
    (tmp_path / "hdfs_test_abnormal").write_text("9 9\n\n1\n2\n")
    def read(**caps):
        return {(r.split, r.session_id): (r.templates, r.label) for r in logs.read_id_sequences(spark, str(tmp_path), **caps).collect()}
    got = read()
    assert got["train", 0] == (["5", "5", "22"], 0) and got["train", 1] == (["7", "8"], 0)
    assert got["test", 5] == (["5"], 0) and got["test", 6] == (["9", "9"], 1) and got["test", 7] == ([], 1)
    assert len(got) == 2 + 6 + 4
    capped = read(max_normal=3, max_test_index=4)
    assert sorted(k[1] for k in capped if k[0] == "test") == [0, 1, 2, 3, 4]
    assert capped["test", 3] == (["9", "9"], 1)


def test_numbering_goes_on_across_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        (folder / f"part-{part}").write_text("".join(f"{part}-{i}\n" for i in range(4 + part * 50)))
    rows = logs._numbered_lines(spark, str(folder)).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(4 + 54 + 104))
    assert [r.value for r in rows][:6] == ["0-0", "0-1", "0-2", "0-3", "1-0", "1-1"]


def test_word_vectors(spark, tmp_path):
    path = tmp_path / "v.vec"
    path.write_text("3 2\nthe 0.5 -1\nof 2 3e-1 \nx 1 1\n")
    got = {r.token: r.vec for r in logs.read_word_vectors(spark, str(path), limit_words=2).collect()}
    assert got == {"the": [0.5, -1.0], "of": [2.0, 0.3]}
    stored = str(tmp_path / "v.parquet")
    logs.read_word_vectors(spark, str(path)).write.parquet(stored)
    assert logs.read_word_vectors(spark, stored).count() == 3


def test_dataset_round_trip(spark, tmp_path):
    rows = [("a", 0, "x", 0, "train"), ("a", 1, "y", 1, "train"), ("b", 0, "x", 0, "train"), ("c", 0, "x", 0, "test")]
    lines = spark.createDataFrame(rows, "session_id string, pos int, template string, label int, split string")
    datasets.write_sessions(lines, {"test_ratio": 0.2}, str(tmp_path / "d"))
    read = datasets.read_sessions(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, read.select(*lines.columns).collect())) == sorted(rows)
    assert datasets.read_params(spark, str(tmp_path / "d")).first().test_ratio == 0.2
    summary = {r.split: (r.sessions, r.anomalous_share) for r in datasets.session_summary(read).collect()}
    assert summary == {"train": (2, 0.5), "test": (1, 0.0)}


def test_results_are_appended(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, 1.0)], "f1 double, rc double")
    path = str(tmp_path / "results")
    for ratio in (0.1, 0.2):
        datasets.append_results(metrics, {"ratio": ratio}, "m", path, 1.0, 2.0)
    rows = spark.read.parquet(path).collect()
    assert {r.run_id for r in rows} == {datasets.run_id({"ratio": 0.1}), datasets.run_id({"ratio": 0.2})}
    assert all(r.metrics == '{"f1":0.5,"rc":1.0}' and len(r.run_id) == 8 for r in rows)


def test_cache_builds_once_per_parameters(spark, tmp_path):
    calls = []
    def build():
        calls.append(1)
        return spark.range(3).select(F.col("id") * 2)
    for params in ({"input": "a"}, {"input": "a"}, {"input": "b"}):
        assert datasets.cached_features(spark, str(tmp_path / "cache"), params, build).count() == 3
    assert len(calls) == 2


def test_cache_follows_its_input(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "features")
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    def cached():
        return datasets.cached_features(spark, cache, {"size": 1}, build, [spark.read.parquet(source)])

    spark.range(3).write.parquet(source)
    assert cached().count() == 3 and cached().count() == 3 and len(calls) == 1
    spark.range(3, 8).write.mode("append").parquet(source)
    assert cached().count() == 8 and len(calls) == 2
    # Unchanged files are the same input.
    assert datasets.input_fingerprint(spark.read.parquet(source)) == datasets.input_fingerprint(spark.read.parquet(source))


def test_two_builders_leave_one_whole_result(spark, tmp_path):
    cache, inside = str(tmp_path / "cache"), []

    def build():
        # While the first one builds, another builder comes and finishes.
        if not inside:
            inside.append(1)
            assert datasets.cached_features(spark, cache, {"a": 1}, build).count() == 2
        return spark.range(2)

    assert datasets.cached_features(spark, cache, {"a": 1}, build).count() == 2
    entries = [p for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")]
    assert len(entries) == 1 and (entries[0] / "_SUCCESS").exists()


def test_failed_build_leaves_nothing(spark, tmp_path):
    cache = str(tmp_path / "cache")

    def broken():
        return spark.range(2).select(F.raise_error(F.lit("broken")).alias("x"))

    with pytest.raises(Exception, match="broken"):
        datasets.cached_features(spark, cache, {}, broken)
    assert datasets.cached_features(spark, cache, {}, lambda: spark.range(2)).count() == 2


def test_models_by_kind_and_version(spark, tmp_path):
    root = str(tmp_path / "models")
    data = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (0.0, 0.5), (1.0, 2.5)], "anomaly double, x double")
    featured = data.select("anomaly", array_to_vector(F.array("x")).alias("features"))
    vocabulary = spark.createDataFrame([("a b", 2)], "template string, template_id int")
    for kind in ("logistic", "trees"):
        model = detect.fit_classifier(featured) if kind == "logistic" else detect.fit_trees(featured, 3)
        assert models.save(model, root, kind, {"size": 3}, vocabulary) == 1
        got = models.load(spark, root, kind)
        assert (got.kind, got.version, got.params) == (kind, 1, {"size": 3}) and got.vocabulary.collect() == vocabulary.collect()
        assert detect.score_classifier(got.model, featured).collect() == detect.score_classifier(model, featured).collect()
    table = spark.createDataFrame([("1 2", [3])], "context string, topk array<int>")
    assert models.save(table, root, "order", {}) == 1
    assert models.save(table.union(table), root, "order", {"k": 1}) == 2
    got = models.load(spark, root, "order")
    assert got.version == 2 and got.params == {"k": 1} and got.vocabulary is None and got.model.count() == 2
    with pytest.raises(FileNotFoundError):
        models.load(spark, root, "nothing")


def test_failed_save_keeps_the_old_version(spark, tmp_path):
    root = str(tmp_path / "models")
    models.save(spark.range(3), root, "table", {})
    with pytest.raises(Exception, match="broken"):
        models.save(spark.range(2).select(F.raise_error(F.lit("broken")).alias("x")), root, "table", {})
    assert models.load(spark, root, "table").model.count() == 3


def test_models_load_in_a_new_session(spark, tmp_path):
    """Another process finds the model by its folder alone."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(tmp_path / "models")
    models.save(spark.createDataFrame([("1", [2])], "context string, topk array<int>"), root, "order", {"order": 1})
    code = (
        "from pyspark.sql import SparkSession\n"
        "from logweave.sources import models\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"got = models.load(spark, {root!r}, 'order')\n"
        "print('found', got.params['order'], got.model.collect()[0].topk[0])\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert "found 1 2" in done.stdout


def test_local_warehouse_is_refused_on_a_cluster():
    from logweave.runtime import fallback_dir

    assert fallback_dir("local[8]", "file:/x/warehouse") == "file:/x/warehouse/_checkpoints"
    assert fallback_dir("yarn", "hdfs://n/warehouse") == "hdfs://n/warehouse/_checkpoints"
    for warehouse in ("file:/x/warehouse", "/x/warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            fallback_dir("spark://host:7077", warehouse)
