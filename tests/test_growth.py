"""What grows with the input, held down: rounds, repeated work and wide rows."""

import random

import loops
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from logweave.operators import detect, features, ordering, sessions, vocab
from logweave.runtime import materialize


def _counted(monkeypatch, module):
    calls = []

    def counting(df, *args):
        calls.append(df.columns)
        return materialize(df, *args)

    monkeypatch.setattr(module, "materialize", counting)
    return calls


def test_a_long_stretch_takes_rounds_by_its_blocks(spark, monkeypatch):
    rng = random.Random(2)
    secs = [0]
    for _ in range(3000):
        secs.append(secs[-1] + rng.choice((1, 2, 3)))
    calls = _counted(monkeypatch, sessions)
    df = spark.createDataFrame(list(enumerate(secs)), "line_id long, sec long")
    got = {r.line_id: r.session_id for r in sessions.anchored_sessions(df, 3, fold_seconds=2000).collect()}
    assert [got[i] for i in range(len(secs))] == loops.anchored(secs, 3)
    # Over a thousand sessions in a stretch: doubling them one by one takes eleven rounds of two tables.
    assert len(calls) < 25, calls


def test_a_stored_table_is_not_stored_again(spark, monkeypatch):
    table = materialize(spark.range(200).select(F.col("id").alias("at")))
    calls = _counted(monkeypatch, ordering)
    made = ordering.running(table, [], ["at"], {"rn": ("row_number", None)}, part_rows=50)
    assert made.where("rn <> at + 1").count() == 0
    assert not any("at" in columns for columns in calls)


def test_tokens_of_a_line_are_cut_once(spark):
    docs = spark.createDataFrame([("fooBar A1b",), ("fooBar A1b",), ("12",), (None,)], "template string")
    lines = materialize(docs)
    seen = []
    stored = vocab.materialize

    def keep(df, *args):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, *args)

    vocab.materialize = keep
    try:
        made = {r.token: (r.token_id, r.n) for r in vocab.token_vocabulary(lines).collect()}
    finally:
        vocab.materialize = stored
    assert made == {"a": (2, 1), "b": (3, 1), "bar": (4, 1), "foo": (5, 1)}
    assert seen[0].count("regexp_") == 1


def test_fitted_patterns_come_with_their_ids(spark):
    rows = [("s", i, [i % 3 + 2, 2, 3], 3, i % 2) for i in range(6)]
    made = spark.createDataFrame(rows, "session_id string, window_idx long, ids array<int>, length int, anomaly int")
    fitted = materialize(detect.fit_patterns(made))
    size = fitted.count()
    featured = detect.pattern_features(made, fitted, size, found="found")
    places = F.filter(F.transform(vector_to_array("features"), lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    assert featured.where(places == F.col("found")).count() == 6


def test_pooled_tokens_are_the_mean_of_summed_embeddings(spark):
    lines = spark.createDataFrame([("foo bar bar",), ("12",), ("odd foo",)], "template string")
    vocabulary = materialize(vocab.template_vocabulary(lines.selectExpr("template", "monotonically_increasing_id() as line_id")))
    words = materialize(vocab.token_vocabulary(vocabulary))
    given = spark.createDataFrame([("foo", [1.0, 2.0]), ("bar", [0.5, None])], "token string, vec array<double>")
    vectors = materialize(vocab.vocabulary_vectors(words, given, 2))
    ids = {r.template: r.template_id for r in vocabulary.collect()}
    rows = [("a", 0, [ids["foo bar bar"], ids["odd foo"], ids["foo bar bar"]], 3), ("a", 1, [ids["12"], 1, 1], 1), (None, 0, [9, 1, 1], 2)]
    made = materialize(spark.createDataFrame(rows, "session_id string, window_idx long, ids array<int>, length int"))
    counts = features.token_counts(vocabulary, words, "template_id")
    got = {(r.session_id, r.window_idx): r.features for r in features.pooled_tokens(made, counts, vectors, 3, 2).collect()}
    assert got == {("a", 0): [5 / 3, 2.0], ("a", 1): [0.0, 0.0], (None, 0): [0.0, 0.0]}


def test_token_ids_under_a_given_number(spark):
    table = materialize(spark.createDataFrame([("foo bar", 7), ("12", 8), ("bar zzz", 9)], "template string, template_id int"))
    words = spark.createDataFrame([("bar", 2), ("foo", 3)], "token string, token_id int")
    made = features.template_token_ids(table, words, key="template_id")
    assert {r.template_id: r.token_ids for r in made.collect()} == {7: [3, 2], 8: [], 9: [2, 1]}
