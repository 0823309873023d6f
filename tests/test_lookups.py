"""Long dictionaries: what is used often is broadcast, and only the rest moves rows."""

import os

import pytest
from pyspark.sql import functions as F

from logweave import runtime
from logweave.operators import features, vocab

TEXTS = ["the cat and the dog", "the Bird", "cat dog cat", "a zebra", "12 34"]


@pytest.fixture
def short_broadcasts(monkeypatch):
    """Dictionaries of more than three rows are long ones."""
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(runtime.is_small, "__defaults__", (3, runtime.BROADCAST_BYTES))
    monkeypatch.setattr(runtime.broadcast_if_small, "__defaults__", (3, runtime.BROADCAST_BYTES))


def _lines(spark, texts=TEXTS):
    return spark.createDataFrame([(t,) for t in texts], "template string")


def test_only_words_outside_the_frequent_ones_are_moved(spark, short_broadcasts):
    lines = _lines(spark)
    vocabulary = vocab.stored(vocab.token_vocabulary(lines))
    ids = {r["token"]: r["token_id"] for r in vocabulary.collect()}
    words = vocab.template_tokens(_lines(spark, [*TEXTS, "an unknown cat"]), name=F.md5("template"))
    made = vocab.encode_tokens(words, vocabulary)
    assert "LeftAnti" in made._jdf.queryExecution().optimizedPlan().toString()
    found = [(r["template"], r["token_pos"], r["token"], r["token_id"]) for r in made.collect()]
    assert sorted(found) == sorted((r["template"], r["token_pos"], r["token"], ids.get(r["token"], 1)) for r in words.collect())
    assert len(found) == 15


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_a_plain_join(spark, short_broadcasts, how):
    entries = runtime.materialize(spark.createDataFrame(
        [("a", 1, 50), ("b", 2, 40), ("b", 3, 1), ("c", 4, 2), ("d", 5, None), (None, 6, 60)], "token string, token_id int, n long"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "c", "d", "e", None, "a"])], "i int, token string")
    made = runtime.looked_up(rows, entries, "token", ["i"], how)
    plain = rows.join(entries.drop("n"), "token", how)
    assert made.columns == plain.columns
    assert sorted(map(repr, made.collect())) == sorted(map(repr, plain.collect()))


def test_a_stored_step_leaves_no_shuffle_files(spark):
    def files():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {folders.apply(i).getName() for i in range(folders.size()) if folders.apply(i).getName().startswith("shuffle")}

    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("x")).distinct()
    df.write.format("noop").mode("overwrite").save()
    before = files()
    stored = runtime.materialize(df)
    assert not {f for f in files() - before if f.endswith(".data")}
    assert stored.count() == 20_000
    assert spark.conf.get(runtime.CLEANUP) == "false"


def test_named_template_tokens(spark):
    made = vocab.template_tokens(_lines(spark), name=F.length("template"))
    assert sorted((r["template"], r["token_pos"], r["token"]) for r in made.where("template = 8").collect()) == [(8, 1, "the"), (8, 2, "bird")]


def _weights(spark, lines, vocabulary):
    return features.tfidf(lines, lines, vocabulary, name=F.md5("template"))


def test_tfidf_of_a_long_vocabulary_moves_rare_words_only(spark, monkeypatch):
    lines = _lines(spark, [*TEXTS, "the cat", "the cat"])
    vocabulary = vocab.stored(vocab.token_vocabulary(lines))
    rows = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    plain = rows(_weights(spark, lines, vocabulary))
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    made = _weights(spark, lines, vocabulary)
    assert "LeftAnti" in made._jdf.queryExecution().optimizedPlan().toString()
    assert rows(made) == plain and len(plain) == 12


@pytest.mark.parametrize("gap", [False, True])
def test_weighted_sums_of_long_tables(spark, monkeypatch, gap):
    weights = [("a", 2, 0.5), ("a", 3, 2.0), ("a", 2, 1.0), ("b", 5, 1.0), ("c", 9, 4.0), ("d", 4, 3.0), ("d", None, 1.0), ("e", None, 1.0), ("a", 4, None)]
    vectors = [(i, [float(i), 1.0] if i in (2, 4) else [0.0, 0.0]) for i in range(7) if not (gap and i == 3)] + [(4, [0.5, None])]
    given = spark.createDataFrame(weights, "template string, token_id int, weight double")
    table = vocab.stored(spark.createDataFrame(vectors, "token_id int, vec array<double>"))
    expected = {"a": [3.0, 1.5], "b": [0.0, 0.0], "d": [13.5, 3.0]}
    for size in (features.BROADCAST_BYTES, 0):
        monkeypatch.setattr(features, "BROADCAST_BYTES", size)
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3 if size else 1)
        assert {r["template"]: list(r["vec"]) for r in features.weighted_embedding(given, table).collect()} == expected


@pytest.mark.parametrize("case", ["all", "unknown", "gap"])
def test_summed_vectors_look_up_telling_tokens_only(spark, case):
    lines = _lines(spark, [*TEXTS, "an unknown cat"])
    vocabulary = vocab.stored(vocab.token_vocabulary(_lines(spark)))
    ids = {r["token"]: r["token_id"] for r in vocabulary.collect()}
    vectors = {i: [float(i), 1.0] if i == ids["cat"] else [0.0, 0.0] for i in range(len(ids) + 2) if case != "gap" or i != ids["zebra"]}
    if case == "unknown":
        vectors[1] = [0.25, 0.0]
    table = vocab.stored(spark.createDataFrame(list(vectors.items()), "token_id int, vec array<double>"))
    numbered = vocab.numbered_templates(lines)
    assert vocab.numbered_templates(numbered) is numbered
    telling = features._telling_tokens(vocabulary, table).count()
    assert telling == (1 if case == "all" else len(ids))
    made = {r["template"]: list(r["vec"]) for r in features.summed_embedding(numbered, vocabulary, table, F.upper("template")).collect()}
    expected = {}
    for text in [*TEXTS, "an unknown cat"]:
        found = [ids.get(w, 1) for w in text.lower().split() if w.isalpha()] or [0]
        known = [vectors[i] for i in found if i in vectors]
        if known:
            expected[text.upper()] = [sum(x) for x in zip(*known)]
    assert made == expected


def test_window_token_ids_keep_one_copy_and_move_rare_words(spark, short_broadcasts):
    lines = _lines(spark).selectExpr("template", "monotonically_increasing_id() as line_id")
    kept = lambda: len(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    runtime.ensure_checkpoint_dir(spark)
    before = kept()
    vocabulary = vocab.stored(vocab.template_vocabulary(lines))
    assert kept() - before == 1 and {r["template_id"] for r in vocabulary.collect()} == set(range(2, 7))
    words = vocab.stored(vocab.token_vocabulary(vocabulary, 2))
    made = features.template_token_ids(vocabulary, words, key="template_id")
    assert "LeftAnti" not in made._jdf.queryExecution().optimizedPlan().toString()  # three tokens are a short vocabulary
    every = vocab.stored(vocab.token_vocabulary(vocabulary))
    made = features.template_token_ids(vocabulary, every, key="template_id")
    assert "LeftAnti" in made._jdf.queryExecution().optimizedPlan().toString()
    ids, names = {r["token"]: r["token_id"] for r in every.collect()}, {r["template_id"]: r["template"] for r in vocabulary.collect()}
    assert {names[r["template_id"]]: r["token_ids"] for r in made.collect()} == {
        t: [ids[w] for w in t.lower().split() if w.isalpha()] for t in TEXTS}


def test_window_tfidf_of_whole_templates_is_that_of_token_rows(spark, monkeypatch):
    train = _lines(spark, [*TEXTS, "the cat"])
    vocabulary, fitted = vocab.stored(vocab.token_vocabulary(train)), features.idf(train)
    numbered = vocab.numbered_templates(_lines(spark, [*TEXTS, "an unknown cat"]))
    ids = {r["template"]: r[vocab.NUMBER] for r in numbered.collect()}
    windows = vocab.stored(spark.createDataFrame(
        [("s", 0, [ids[TEXTS[0]], ids[TEXTS[1]], ids[TEXTS[0]]]), ("s", 1, [ids["an unknown cat"], ids[TEXTS[4]], -1]), ("t", 0, [-1, -1, -1])],
        "session_id string, window_idx long, feature_ids array<long>"))
    rows = lambda made: {(r.session_id, r.window_idx, r.token_id): round(r.weight, 12) for r in made.collect()}
    packed = features.tfidf_dictionary(numbered, fitted, vocabulary)
    assert packed.count() == 5 and packed.columns == ["feature_id", "total", "norm", "codes", "times"]
    plain = features.numbered_tfidf(numbered, fitted, vocabulary).withColumnRenamed(vocab.NUMBER, "feature_id")
    expected = rows(features.window_tfidf(windows, plain, 3))
    assert rows(features.window_tfidf(windows, packed, 3)) == expected and len(expected) == 6
    monkeypatch.setattr(features, "PACKED_LINES", 1)
    assert rows(features.window_tfidf(windows, features.tfidf_dictionary(numbered, fitted, vocabulary), 3)) == expected
