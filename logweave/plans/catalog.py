"""One named query per operator, over the log views of the test tables.

Arrays are returned as comma-joined text and times as epoch microseconds.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import columns as C
from logweave.ml.transformers import FirstSeenIndexer, FrameWindower, GapChunkSessionizer, LogFeatureExtractor
from logweave.operators import cooccurrence, detect, evaluate, features, normalize, patterns, sessions, splits, suffix_tree, vocab, windows
from logweave.plans import flows
from logweave.plans.views import (
    VECTOR_DIM,
    block_labels,
    conv_sessions,
    entity_labels,
    log_docs,
    log_events,
    log_lineitem,
    table,
    word_vectors,
)
from logweave.runtime import discard, materialize
from logweave.runtime import scratch_path as scratch
from logweave.sources import datasets, logs, models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIZE, STRIDE, ORDER, K = 10, 1, 3, 5
# Of the whole uncertainty, what a node of the suffix tree explains at least; of the windows, where a pattern stands at least; patterns.
TREE_SHARE, PATTERN_SHARE, PATTERNS = 0.0005, 0.002, 50


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def nested(column: str) -> Column:
    """Arrays inside an array: members joined by blanks."""
    return F.array_join(F.transform(column, lambda x: F.array_join(x.cast("array<string>"), " ")), ",").alias(column)


def digest(column: str) -> Column:
    """Whole lines as templates are long; results with many rows per template carry their digest."""
    return F.md5(F.col(column)).alias(f"{column}_md5")


def micros(column: str) -> Column:
    return F.unix_micros(column).alias(column)


def rounded(column: str) -> Column:
    return F.round(column, 6).alias(column)


# ---- inputs shared by several queries -------------------------------------------------------


def raw_log(spark: SparkSession, folder: str) -> DataFrame:
    """``log_events`` with the text columns of the three log families."""
    lines = log_events(spark, folder)
    day = lambda pattern: F.date_format("ts", pattern)
    return lines.select(
        F.col("line_id").alias("LineId"), F.col("content").alias("Content"), F.col("template").alias("EventTemplate"),
        F.when(F.col("label") == 1, "FATAL").otherwise("-").alias("Label"),
        # Numbers, so that leading zeros are lost as in the files this form comes from.
        day("ddMMyy").cast("int").alias("Date6"), day("HHmmss").cast("int").alias("Time6"),
        day("yyyy-MM-dd-HH.mm.ss.SSSSSS").alias("TimeMicro"),
        day("yyyy.MM.dd").alias("DateDotted"), day("HH:mm:ss").alias("TimeColon"),
    )


def entity_log(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by entity session, with the label of the line."""
    lines = log_events(spark, folder).select("line_id", "content", "template", "label")
    return sessions.entity_lines(lines).drop("content")


def user_log(spark: SparkSession, folder: str) -> DataFrame:
    lines = log_events(spark, folder)
    return lines.select(
        F.concat(F.lit("blk_"), F.col("user_id").cast("string")).alias("session_id"), "line_id", "template", "label"
    )


def dataset(spark: SparkSession, folder: str) -> flows.Dataset:
    return flows.prepare(user_log(spark, folder), test_ratio=0.2)


def all_windows(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Windows of all entity sessions, encoded with the vocabulary of the whole log."""
    lines = sessions.with_positions(entity_log(spark, folder))
    vocabulary = vocab.stored(vocab.template_vocabulary(log_events(spark, folder)))
    options = {"size": SIZE, "stride": STRIDE, **options}
    return windows.sliding_windows(vocab.encode_templates(lines, vocabulary), **options)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return flows.scored_next_event(dataset(spark, folder), SIZE, STRIDE, ORDER, K)


def doc_vocab(spark: SparkSession, folder: str, min_count: int = 1, docs: DataFrame | None = None) -> DataFrame:
    return vocab.stored(vocab.token_vocabulary(log_docs(spark, folder) if docs is None else docs, min_count))


def doc_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and templates of the texts, stored: the texts are cut into lines once."""
    return materialize(log_docs(spark, folder).select("doc_id", "line_id", "template"), "zstd")


def value_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a scored window of its user."""
    lines = log_events(spark, folder)
    return lines.select(F.col("user_id").alias("session_id"), F.col("line_id").alias("window_idx"),
                        F.col("value").alias("score"), F.col("label").alias("anomaly"))


# ---- sources and sinks ----------------------------------------------------------------------


@query
def s1_structured_csv(spark, folder):
    path = scratch(spark, "csv")
    raw = raw_log(spark, folder).select(
        "LineId", "Content", F.when(F.col("LineId") % 5 == 0, "").otherwise(F.col("EventTemplate")).alias("EventTemplate"), "Label"
    )
    raw.write.option("header", True).option("escape", '"').csv(path)
    return logs.read_structured_log(spark, path, "LineId long, Content string, EventTemplate string, Label string")


@query
def s2_entity_labels(spark, folder):
    path = scratch(spark, "labels")
    block_labels(spark, folder).toDF("BlockId", "Label").write.option("header", True).csv(path)
    return logs.read_entity_labels(spark, path)


@query
def s3_id_sequences(spark, folder):
    path = scratch(spark, "ids")
    conv = conv_sessions(spark, folder)
    sequences = conv.groupBy(F.col("session_id").cast("long").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "template"))), lambda r: r["template"]), " ").alias("value")
    )
    parts = materialize(sequences)
    for part, (name, _) in enumerate(logs.ID_FILES.values()):
        parts.where(F.col("id") % 3 == part).orderBy("id").select("value").write.text(posixpath.join(path, name))
    read = logs.read_id_sequences(spark, path)
    return read.select("split", "session_id", joined("templates"), "label")


def _stored_split(spark, folder) -> str:
    path = scratch(spark, "sessions")
    data = dataset(spark, folder)
    datasets.write_sessions(data.lines, {"test_ratio": 0.2, "random_sessions": True, "train_anomaly_ratio": 1.0}, path)
    return path


@query
def s4_session_dataset(spark, folder):
    path = _stored_split(spark, folder)
    lines = datasets.read_sessions(spark, path)
    params = datasets.read_params(spark, path).select("test_ratio").scalar()
    return lines.select("session_id", "line_id", "pos", "template", "label", F.col("split").cast("string").alias("split"),
                        params.alias("test_ratio"))


@query
def s5_session_summary(spark, folder):
    lines = datasets.read_sessions(spark, _stored_split(spark, folder))
    return datasets.session_summary(lines).select("split", "sessions", rounded("anomalous_share"))


@query
def s6_word_vectors(spark, folder):
    path = scratch(spark, "vectors")
    source = table(spark, folder, "embeddings")
    rows = source.orderBy("vec_id").select(
        F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value")
    )
    header = source.agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(f" {VECTOR_DIM}")).alias("value"))
    # Part files are read in name order: the header file sorts before the part files.
    header.coalesce(1).write.text(posixpath.join(path, "a"))
    rows.write.text(posixpath.join(path, "b"))
    read = logs.read_word_vectors(spark, posixpath.join(path, "*"))
    return read.select("token", F.posexplode("vec").alias("dim", "value"))


def _threshold_metrics(spark, folder, cut: float) -> DataFrame:
    scores = value_scores(spark, folder)
    cases = scores.select((F.col("score") > cut).cast("int").alias("pred"), F.col("anomaly").alias("truth"))
    return evaluate.binary_metrics(cases).select(rounded("f1"), rounded("rc"), rounded("pc"))


@query
def s7_run_results(spark, folder):
    path = scratch(spark, "results")
    for cut in (20, 60):
        datasets.append_results(_threshold_metrics(spark, folder, cut), {"cut": cut, "dataset": "events"}, "threshold", path, 0.0, 0.0)
    read = spark.read.parquet(path)
    f1 = F.from_json("metrics", "f1 double, rc double, pc double")
    return read.select("run_id", "model", "params", f1["f1"].alias("f1"), f1["rc"].alias("rc"), f1["pc"].alias("pc"))


@query
def s8_feature_cache(spark, folder):
    cache = scratch(spark, "cache")
    params = {"input": folder, "window_size": SIZE, "stride": STRIDE}
    build = lambda: all_windows(spark, folder)
    events = [table(spark, folder, "events")]
    datasets.cached_features(spark, cache, params, build, events)
    again = datasets.cached_features(spark, cache, params, build, events)
    return again.select("session_id", "window_idx", joined("ids"), "next_id", "anomaly")


# ---- projections, label predicates ----------------------------------------------------------


@query
def p1_compact_timestamp(spark, folder):
    raw = raw_log(spark, folder)
    return raw.select("LineId", C.compact_timestamp(F.col("Date6"), F.col("Time6")).alias("ts")).select("LineId", micros("ts"))


@query
def p2_microsecond_timestamp(spark, folder):
    raw = raw_log(spark, folder)
    return raw.select("LineId", C.microsecond_timestamp(F.col("TimeMicro")).alias("ts")).select("LineId", micros("ts"))


@query
def p3_dotted_timestamp(spark, folder):
    raw = raw_log(spark, folder)
    return raw.select("LineId", C.dotted_timestamp(F.col("DateDotted"), F.col("TimeColon")).alias("ts")).select("LineId", micros("ts"))


@query
def p4_seconds_since_first(spark, folder):
    return normalize.seconds_since_first(log_events(spark, folder)).select("line_id", "sec")


@query
def p5_alert_label(spark, folder):
    return raw_log(spark, folder).select("LineId", C.alert_label(F.col("Label")).alias("label"))


@query
def p6_entity_ids(spark, folder):
    return log_events(spark, folder).select("line_id", C.entity_ids(F.col("content")).alias("entities")).select("line_id", joined("entities"))


@query
def p7_normalize(spark, folder):
    raw = raw_log(spark, folder)
    common = ["LineId", "Content", "EventTemplate", "Label"]
    forms = {
        "hdfs": raw.select(*common, F.col("Date6").alias("Date"), F.col("Time6").alias("Time")),
        "bgl": raw.select(*common, F.col("TimeMicro").alias("Time")),
        "thunderbird": raw.select(*common, F.col("DateDotted").alias("Date"), F.col("TimeColon").alias("Time")),
    }
    labels = entity_labels(spark, folder)
    parts = [
        normalize.normalize(form, family, labels).select(F.lit(family).alias("family"), "line_id", micros("ts"), "content", "template", "label")
        for family, form in forms.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- joins and lookups ----------------------------------------------------------------------


@query
def l1_session_labels(spark, folder):
    rolled = sessions.session_rollup(entity_log(spark, folder)).drop("label")
    return normalize.label_sessions(rolled, entity_labels(spark, folder)).select("session_id", "length", "label")


@query
def l2_line_labels(spark, folder):
    lines = log_events(spark, folder).select("line_id", "content")
    return normalize.line_labels_from_entities(lines, entity_labels(spark, folder), on_missing="error").select("line_id", "label")


@query
def l3_template_ids(spark, folder):
    data = dataset(spark, folder)
    return data.test.select("session_id", "line_id", "template_id")


@query
def l4_token_ids(spark, folder):
    words = vocab.template_tokens(log_docs(spark, folder), name=F.md5("template"))
    return vocab.encode_tokens(words, doc_vocab(spark, folder, 3)).select(F.col("template").alias("template_md5"), "token_pos", "token_id")


@query
def l5_new_templates(spark, folder):
    docs = log_docs(spark, folder)
    parts = splits.split_sessions(_doc_sessions(docs), 0.3, random=False)
    lines = docs.join(parts.select("doc_id", "split"), "doc_id")
    return vocab.new_templates(lines.where("split = 'test'"), lines.where("split = 'train'"))


def _doc_sessions(docs: DataFrame) -> DataFrame:
    rolled = docs.groupBy("doc_id").agg(F.min("line_id").alias("first_line"))
    return rolled.withColumn("session_id", F.col("doc_id").cast("string"))


@query
def l6_filter_unseen_normal(spark, folder):
    docs = log_docs(spark, folder).withColumn("label", (F.length("content") % 11 == 0).cast("int"))
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    return splits.filter_unseen_normal(test, train).select("line_id", "template", "label")


@query
def l7_vocabulary_vectors(spark, folder):
    vocabulary = doc_vocab(spark, folder)
    made = vocab.vocabulary_vectors(vocabulary, word_vectors(spark, folder, vocabulary), VECTOR_DIM)
    # Entries without a vector, all zeros, take one row.
    given = F.when(F.col("has_vec") == 1, F.col("vec"))
    return made.select("token", "token_id", "has_vec", F.posexplode_outer(given).alias("dim", "value")).select(
        "token", "token_id", "has_vec", "dim", rounded("value"))


@query
def l7_vector_coverage(spark, folder):
    vocabulary = doc_vocab(spark, folder)
    made = vocab.vocabulary_vectors(vocabulary, word_vectors(spark, folder, vocabulary), VECTOR_DIM)
    return vocab.vector_coverage(made).select("entries", "with_vector", rounded("coverage"))


# ---- sessions -------------------------------------------------------------------------------


@query
def g1_entity_sessions(spark, folder):
    lines = log_events(spark, folder).select("line_id", "content", "template")
    return sessions.entity_sessions(lines).select("session_id", "pos", "line_id", "template")


@query
def g2_anchored_sessions(spark, folder):
    lines = normalize.seconds_since_first(log_events(spark, folder)).select("line_id", "sec")
    return sessions.anchored_sessions(lines, sessions.RANGE_SECONDS["thunderbird"])


@query
def g2_anchored_sessions_by_user(spark, folder):
    lines = normalize.seconds_since_first(log_events(spark, folder)).select("user_id", "line_id", "sec")
    return sessions.anchored_sessions(lines, sessions.RANGE_SECONDS["bgl"], partition_cols=["user_id"])


@query
def g3_gap_chunk_sessions(spark, folder):
    lines = log_events(spark, folder).select("line_id", "ts")
    return sessions.gap_chunk_sessions(lines, 600).select("line_id", "session_id")


@query
def g3_gap_chunk_sessions_by_user(spark, folder):
    lines = log_events(spark, folder).select("user_id", "line_id", "ts")
    return sessions.gap_chunk_sessions(lines, 36_000, partition_cols=["user_id"]).select("user_id", "line_id", "session_id")


@query
def g4_whole_log_session(spark, folder):
    lines = log_events(spark, folder).select("line_id", "template", "label")
    return sessions.whole_log_session(lines).select("session_id", "pos", "line_id", "template", "label")


@query
def g5_session_rollup(spark, folder):
    return sessions.session_rollup(entity_log(spark, folder))


# ---- splits ---------------------------------------------------------------------------------


@query
def t1_session_split_random(spark, folder):
    return splits.split_sessions(sessions.session_rollup(entity_log(spark, folder)), 0.2).select("session_id", "split")


@query
def t1_session_split_ordered(spark, folder):
    rolled = sessions.session_rollup(entity_log(spark, folder))
    return splits.split_sessions(rolled, 0.3, train_ratio=0.5, random=False).select("session_id", "split")


@query
def t2_anomaly_sampling(spark, folder):
    rolled = normalize.label_sessions(
        sessions.session_rollup(entity_log(spark, folder)).drop("label"), entity_labels(spark, folder)
    )
    return splits.sample_train_anomalies(splits.split_sessions(rolled, 0.2), 0.5).select("session_id", "split", "label")


@query
def t3_line_split(spark, folder):
    lines = log_events(spark, folder).select("line_id", "template", "label")
    return splits.split_lines(lines, test_ratio=0.6, train_anomaly_ratio=0.25)


@query
def t3_line_split_random(spark, folder):
    lines = log_events(spark, folder).select("line_id", "template", "label")
    return splits.split_lines(lines, test_ratio=0.6, train_ratio=0.3, train_anomaly_ratio=0.25, random=True)


@query
def t4_split_report(spark, folder):
    rolled = sessions.session_rollup(user_log(spark, folder))
    return splits.split_report(splits.split_sessions(rolled, 0.2)).select("split", "n", rounded("anomaly_pct"))


@query
def t4_line_split_report(spark, folder):
    return splits.split_report(t3_line_split(spark, folder)).select("split", "n", rounded("anomaly_pct"))


# ---- vocabularies ---------------------------------------------------------------------------


@query
def v1_template_vocabulary(spark, folder):
    return vocab.template_vocabulary(log_docs(spark, folder))


@query
def v2_first_seen_ids(spark, folder):
    return vocab.first_seen_ids(log_events(spark, folder), "template", "ID")


@query
def v2_first_seen_ids_continued(spark, folder):
    docs = log_docs(spark, folder)
    prior = vocab.stored(vocab.first_seen_ids(docs.where("doc_id % 2 = 0"), "template", "ID"))
    return vocab.first_seen_ids(docs, "template", "ID", mapping=prior)


@query
def v3_tokens(spark, folder):
    return log_docs(spark, folder).select("line_id", C.tokens(F.col("content")).alias("tokens")).select("line_id", joined("tokens"))


@query
def v4_token_vocabulary(spark, folder):
    return vocab.token_vocabulary(log_docs(spark, folder), 2)


@query
def v5_metadata(spark, folder):
    docs = log_docs(spark, folder)
    # Stored, since every row of the result counts them; their text is not needed for that.
    templates = vocab.stored(vocab.template_vocabulary(docs).select("template_id"))
    tokens = vocab.stored(vocab.token_vocabulary(docs).select("token_id"))
    rows = [
        vocab.metadata(label, feature, templates, tokens).select(F.lit(label).alias("label_type"), F.lit(feature).alias("feature_type"), "*")
        for label, feature in (("next_log", "sequentials"), ("next_log", "semantics"), ("anomaly", "sequentials"))
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ---- windows --------------------------------------------------------------------------------


@query
def w1_sliding_windows(spark, folder):
    made = all_windows(spark, folder, text=True)
    return made.select("session_id", "window_idx", joined("window"), "next_id")


@query
def w1_short_sessions(spark, folder):
    lines = conv_sessions(spark, folder)
    vocabulary = vocab.stored(vocab.template_vocabulary(lines))
    made = windows.sliding_windows(vocab.encode_templates(lines, vocabulary), 3, 5, text=True)
    return made.select("session_id", "window_idx", joined("window"), "next_id", "anomaly", joined("an_classes"))


def _supplier_lines(spark, folder) -> DataFrame:
    lines = materialize(log_lineitem(spark, folder))
    vocabulary = vocab.stored(vocab.template_vocabulary(lines))
    return vocab.encode_templates(lines, vocabulary)


@query
def w1_supplier_windows(spark, folder):
    made = windows.sliding_windows(sessions.with_positions(_supplier_lines(spark, folder)), SIZE, 5)
    return made.select("session_id", "window_idx", joined("ids"), "next_id", "anomaly")


@query
def w2_window_anomaly(spark, folder):
    return all_windows(spark, folder, stride=3).select("session_id", "window_idx", "anomaly")


@query
def w3_window_classes(spark, folder):
    return all_windows(spark, folder).select("session_id", "window_idx", joined("an_classes"))


@query
def w3_window_classes_compat(spark, folder):
    return all_windows(spark, folder, stride=4, compat=True).select("session_id", "window_idx", joined("an_classes"))


@query
def w4_session_windows(spark, folder):
    lines = sessions.with_positions(user_log(spark, folder))
    vocabulary = vocab.stored(vocab.template_vocabulary(lines))
    made = windows.session_windows(vocab.encode_templates(lines, vocabulary))
    return made.select("session_id", "window_idx", "pos", "template", "template_id", "an_class", "length", "window_label", "anomaly")


def _frames(spark, folder, **options) -> DataFrame:
    lines = log_events(spark, folder)
    ids = vocab.stored(vocab.first_seen_ids(lines, "template", "ID"))
    coded = lines.join(vocab.broadcast_if_small(ids), "template").withColumnRenamed("user_id", "group")
    return windows.frame_windows(coded, "ID", order="line_id", **options).select(
        "group", "frame_idx", joined("window"), joined("labels"))


@query
def w5_frame_windows(spark, folder):
    return _frames(spark, folder, size=10, stride=3)


@query
def w5_frame_windows_compat(spark, folder):
    return _frames(spark, folder, size=10, stride=3, compat=True)


@query
def w6_samples(spark, folder):
    index = windows.session_index(sessions.session_rollup(entity_log(spark, folder)))
    return windows.samples(all_windows(spark, folder), index).select(
        "session_idx", "window_idx", joined("ids"), "next_id", "anomaly", joined("an_classes"))


@query
def w7_long_window_report(spark, folder):
    """One session holds the complete table."""
    lines = sessions.whole_log_session(_supplier_lines(spark, folder))
    return windows.window_report(windows.sliding_windows(lines, SIZE, STRIDE)).select("windows", rounded("anomalous_share"))


@query
def w7_window_report(spark, folder):
    lines = sessions.whole_log_session(log_events(spark, folder).select("line_id", "template", "label"))
    vocabulary = vocab.stored(vocab.template_vocabulary(lines))
    made = windows.sliding_windows(vocab.encode_templates(lines, vocabulary), SIZE, STRIDE)
    return windows.window_report(made).select("windows", rounded("anomalous_share"))


# ---- features -------------------------------------------------------------------------------


@query
def f1_sequential(spark, folder):
    data = dataset(spark, folder)
    made = features.sequential(windows.sliding_windows(data.test, SIZE, STRIDE))
    return made.select("session_id", "window_idx", joined("features"))


@query
def f2_quantitative(spark, folder):
    data = dataset(spark, folder)
    made = features.quantitative(windows.sliding_windows(data.test, SIZE, STRIDE), data.vocab_size())
    return made.select("session_id", "window_idx", joined("features"))


def _doc_lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("session_id"), "line_id", "template", F.lit(0).alias("label"))


@query
def f3_template_token_ids(spark, folder):
    numbered = vocab.numbered_templates(log_docs(spark, folder))
    made = features.template_token_ids(numbered, doc_vocab(spark, folder, 2, numbered))
    return made.select("template", joined("token_ids"))


@query
def f3_window_token_ids(spark, folder):
    docs = doc_templates(spark, folder)
    vocabulary = vocab.stored(vocab.template_vocabulary(docs))
    # The text meets the vocabulary once; from there on its number stands for it.
    numbered = materialize(vocab.encode_templates(_doc_lines(docs), vocabulary).drop("template"))
    discard(docs)
    words = doc_vocab(spark, folder, 2, vocabulary)
    table_ = vocab.stored(features.template_token_ids(vocabulary, words, key="template_id"))
    discard(vocabulary)
    coded = features.attach_template_features(sessions.with_positions(numbered), table_, "template_id")
    made = windows.sliding_windows(coded, 3, 2, carry={"token_ids": F.array().cast("array<int>")})
    return made.select("session_id", "window_idx", nested("token_ids"), "next_id")


@query
def f4_tfidf(spark, folder):
    docs = doc_templates(spark, folder)
    made = features.tfidf(docs, docs, doc_vocab(spark, folder, docs=docs), name=F.md5("template"))
    return made.select(F.col("template").alias("template_md5"), "token_id", rounded("weight"))


@query
def f4_tfidf_lower_first(spark, folder):
    docs = doc_templates(spark, folder)
    made = features.tfidf(docs, docs.where("doc_id % 2 = 0"), doc_vocab(spark, folder, docs=docs), lower_first=True, name=F.md5("template"))
    return made.select(F.col("template").alias("template_md5"), "token_id", rounded("weight"))


@query
def f5_word_vectors(spark, folder):
    vocabulary = doc_vocab(spark, folder)
    made = vocab.vocabulary_vectors(vocabulary, word_vectors(spark, folder, vocabulary), VECTOR_DIM)
    # Entries without a vector are zeros: nothing to add up.
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return made.select("token_id", "token", F.round(F.when(F.col("has_vec") == 1, square).otherwise(0.0), 6).alias("squared_length"))


def _vectors(spark, folder, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    vocabulary = doc_vocab(spark, folder, docs=docs)
    return vocabulary, vocab.stored(vocab.vocabulary_vectors(vocabulary, word_vectors(spark, folder, vocabulary), VECTOR_DIM))


def _template_vectors(spark, folder, docs: DataFrame, name: str | Column = "template") -> DataFrame:
    vocabulary, table_ = _vectors(spark, folder, docs)
    return features.summed_embedding(docs, vocabulary, table_, name)


@query
def f5_mutual_information(spark, folder):
    """Token pairs of the texts that occur at least five times within two places and are likelier than by chance."""
    pairs = materialize(cooccurrence.token_pairs(log_docs(spark, folder)).where("n >= 5"))
    return cooccurrence.mutual_information(pairs).select("token", "near", "n", rounded("ppmi"))


@query
def f6_learned_vectors(spark, folder):
    """Lengths of the token vectors in all directions of that table, which are the lengths of its rows, and the share of the first eight."""
    lines = doc_templates(spark, folder)
    information = materialize(cooccurrence.mutual_information(materialize(cooccurrence.token_pairs(lines).where("n >= 200"))))
    vocabulary = doc_vocab(spark, folder, docs=lines)
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    count = information.select("token").distinct().count()
    every = cooccurrence.learned_vectors(information, vocabulary, count).select("token", F.round(square, 4).alias("squared_length"))
    first = cooccurrence.learned_vectors(information, vocabulary, min(8, count)).select("token", square.alias("first"))
    return every.join(first, "token").select(
        "token", "squared_length", (F.col("first") <= F.col("squared_length") + 1e-3).cast("int").alias("within"))


@query
def f6_summed_embedding(spark, folder):
    # Only the distinct templates are read more than once.
    made = _template_vectors(spark, folder, vocab.numbered_templates(log_docs(spark, folder)), F.md5("template"))
    return made.select(F.col("template").alias("template_md5"), F.posexplode("vec").alias("dim", "value")).select("template_md5", "dim", rounded("value"))


@query
def f7_weighted_embedding(spark, folder):
    docs = doc_templates(spark, folder)
    vocabulary, table_ = _vectors(spark, folder, docs)
    weights = features.tfidf(docs, docs, vocabulary, name=F.md5("template"))
    discard(docs)
    made = features.weighted_embedding(weights, table_)
    return made.select(F.col("template").alias("template_md5"), F.posexplode("vec").alias("dim", "value")).select("template_md5", "dim", rounded("value"))


@query
def f8_mean_pooled(spark, folder):
    docs = doc_templates(spark, folder)
    vocabulary = vocab.stored(vocab.template_vocabulary(docs))
    words, table_ = _vectors(spark, folder, vocabulary)
    lines = vocab.encode_templates(_doc_lines(docs), vocabulary).drop("template")
    made = materialize(windows.sliding_windows(sessions.with_positions(lines), 4, 4).select("session_id", "window_idx", "ids", "length"))
    pooled = features.pooled_tokens(made, features.token_counts(vocabulary, words, "template_id"), table_, 4, VECTOR_DIM)
    return pooled.select("session_id", "window_idx", F.posexplode("features").alias("dim", "value")).select(
        "session_id", "window_idx", "dim", rounded("value"))


# ---- detectors ------------------------------------------------------------------------------


def _train_model(data: flows.Dataset) -> DataFrame:
    return detect.fit_next_event(windows.sliding_windows(data.train, SIZE, STRIDE), ORDER, K)


@query
def d1_next_event_model(spark, folder):
    return _train_model(dataset(spark, folder)).select("context", joined("topk"))


@query
def d1_supplier_model(spark, folder):
    lines = sessions.with_positions(_supplier_lines(spark, folder))
    return detect.fit_next_event(windows.sliding_windows(lines, SIZE, STRIDE), ORDER, K).select("context", joined("topk"))


@query
def d1_suffix_tree(spark, folder):
    """Contexts of any length up to the window's, as far as they explain a thousandth of the log's uncertainty."""
    train = windows.sliding_windows(dataset(spark, folder).train, SIZE, STRIDE)
    return suffix_tree.fit_suffix_tree(train, SIZE, K, TREE_SHARE).select("context", joined("topk"))


@query
def d1_suffix_tree_hits(spark, folder):
    """Test windows whose next event is among the first k, by the suffix tree and by contexts of three events."""
    data = dataset(spark, folder)
    train = materialize(windows.sliding_windows(data.train, SIZE, STRIDE))
    test = materialize(windows.sliding_windows(data.test, SIZE, STRIDE))
    models = {
        "tree": (suffix_tree.fit_suffix_tree(train, SIZE, K, TREE_SHARE), SIZE),
        "order": (materialize(detect.fit_next_event(train, ORDER, K)), ORDER),
    }
    hits = [
        detect.score_next_event(test, model, order).select(F.lit(name).alias("model"), evaluate.hit_rank().alias("hit"))
        for name, (model, order) in models.items()
    ]
    at = hits[0].union(hits[1]).select("model", "hit", F.explode(F.sequence(F.lit(1), F.lit(K))).alias("k"))
    return at.groupBy("model", "k").agg(
        F.count_if(F.col("hit").between(F.lit(1), F.col("k"))).alias("hits"), F.count(F.lit(1)).alias("windows"))


@query
def d2_window_classifier(spark, folder):
    """The classifier's sparse input, and what its optimum implies: the mean probability on the training windows is
    their share of anomalies."""
    data = dataset(spark, folder)
    size = data.vocab_size()
    train = materialize(features.count_features(windows.sliding_windows(data.train, SIZE, STRIDE), size).select("features", "anomaly"))
    model = detect.fit_classifier(train)
    mean = detect.score_classifier(model, train).agg(F.round(F.avg("score"), 3)).scalar()
    test = detect.score_classifier(model, features.count_features(windows.sliding_windows(data.test, SIZE, STRIDE), size))
    vector = vector_to_array("features")
    counts = F.filter(
        F.transform(vector, lambda n, i: F.struct((i + 1).alias("template_id"), n.cast("int").alias("n"))), lambda c: c["n"] > 0
    )
    # Only windows whose probability lies between 0 and 1, which are all of them.
    return test.where("score between 0 and 1").select("session_id", "window_idx", "anomaly", F.inline(counts)).withColumn(
        "mean_train_score", mean)


@query
def d2_tree_classifier(spark, folder):
    """F1 of the test windows by boosted trees with a threshold chosen on held-out training sessions, and by the logistic fit."""
    data = dataset(spark, folder)
    trees, threshold = flows.tree_classification(data, SIZE, STRIDE)
    size = data.vocab_size()
    train = materialize(features.count_features(windows.sliding_windows(data.train, SIZE, STRIDE), size).select("features", "anomaly"))
    plain = detect.score_classifier(
        detect.fit_classifier(train), features.count_features(windows.sliding_windows(data.test, SIZE, STRIDE), size))
    made = trees.select(F.lit("trees").alias("model"), F.col("flag").alias("pred"), F.col("anomaly").alias("truth")).union(
        plain.select(F.lit("logistic"), "flag", "anomaly"))
    cut = F.when(F.col("model") == "trees", threshold.select("threshold").scalar())
    return evaluate.binary_metrics(made, by=["model"]).select("model", rounded("f1"), rounded("rc"), rounded("pc"), F.round(cut, 6).alias("threshold"))


@query
def d2_best_threshold(spark, folder):
    """The value from which on events are best called anomalous, exactly."""
    return detect.best_threshold(value_scores(spark, folder)).select("threshold", rounded("f1"))


@query
def d3_pattern_classifier(spark, folder):
    """The fitted patterns that occur in each scored window."""
    data = dataset(spark, folder)
    train = materialize(windows.sliding_windows(data.train, SIZE, STRIDE))
    patterns = materialize(detect.fit_patterns(train))
    size = patterns.count()
    model = detect.fit_classifier(materialize(detect.pattern_features(train, patterns, size).select("features", "anomaly")))
    test = detect.pattern_features(windows.sliding_windows(data.test, SIZE, STRIDE), patterns, size, found="found")
    made = detect.score_classifier(model, test)
    # The places of the sparse vector, which as an array would be as long as the fitted patterns.
    return made.where("score between 0 and 1").select("session_id", "window_idx", "anomaly", F.explode("found").alias("pattern_id"))


@query
def d3_frequent_patterns(spark, folder):
    """Runs of two to four events in at least one of five hundred training windows."""
    train = windows.sliding_windows(dataset(spark, folder).train, SIZE, STRIDE)
    return patterns.frequent_patterns(train, PATTERN_SHARE)


@query
def d3_telling_patterns(spark, folder):
    """The fifty of them that tell most about the label, and the test windows in which each occurs."""
    data = dataset(spark, folder)
    train = materialize(windows.sliding_windows(data.train, SIZE, STRIDE))
    best = patterns.telling_patterns(train, PATTERNS, PATTERN_SHARE)
    test = patterns.telling_features(windows.sliding_windows(data.test, SIZE, STRIDE), best, PATTERNS)
    places = F.transform(vector_to_array("features"), lambda x, i: F.when(x > 0, i))
    hits = test.select("anomaly", F.explode(F.filter(places, lambda i: i.isNotNull())).alias("pattern_id")).groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("test_windows"), F.sum("anomaly").alias("test_anomalous"))
    zero = F.lit(0).cast("long")
    return best.join(F.broadcast(hits), "pattern_id", "left").select(
        "pattern", "pattern_id", "width", "support", "anomalous", rounded("chi2"),
        F.coalesce("test_windows", zero).alias("test_windows"), F.coalesce("test_anomalous", zero).alias("test_anomalous"))


@query
def d4_reconstruction_error(spark, folder):
    """Mean squared centred counts of the scored windows (the error without directions), and the error with all
    directions, which is 0; with three directions it lies between them."""
    data = dataset(spark, folder)
    size = data.vocab_size()
    train = materialize(windows.sliding_windows(data.train, SIZE, STRIDE))
    test = materialize(windows.sliding_windows(data.test, SIZE, STRIDE))
    key = ["session_id", "window_idx"]
    made = detect.score_reconstruction(detect.fit_reconstruction(train, size), test, size)
    full = detect.score_reconstruction(detect.fit_reconstruction(train, size, size - 1), test, size)
    both = made.join(full.select(*key, F.col("score").alias("full")), key)
    return both.select(
        *key, "anomaly", rounded("total"), F.abs(F.round("full", 6)).alias("rest"),
        F.col("score").between(F.col("full") - 1e-9, F.col("total") + 1e-9).cast("int").alias("between"),
    )


@query
def d4_main_directions(spark, folder):
    """Error of the scored windows outside the three main directions of the training windows."""
    data = dataset(spark, folder)
    model = detect.fit_sparse_reconstruction(windows.sliding_windows(data.train, SIZE, STRIDE), 3)
    made = detect.score_sparse_reconstruction(model, windows.sliding_windows(data.test, SIZE, STRIDE), data.vocab_size())
    return made.select("session_id", "window_idx", rounded("score"), rounded("total"))


@query
def d5_batch_scoring(spark, folder):
    return scored(spark, folder).select("session_id", "window_idx", "next_id", joined("topk"))


@query
def d6_saved_model(spark, folder):
    data = dataset(spark, folder)
    path = scratch(spark, "model")
    detect.save_table(_train_model(data), path)
    made = detect.score_next_event(windows.sliding_windows(data.test, SIZE, STRIDE), detect.load_table(spark, path), ORDER)
    return made.select("session_id", "window_idx", "next_id", joined("topk"))


@query
def d7_best_candidate(spark, folder):
    metrics = evaluate.topk_metrics(scored(spark, folder), K)
    return detect.select_best(metrics.withColumnRenamed("k", "candidate"), patience=2).select("candidate", rounded("f1"), "stopped_at")


@query
def d7_order_search(spark, folder):
    """Next-event models of growing order, until two in a row are no better."""
    data = dataset(spark, folder)
    train, test = (materialize(windows.sliding_windows(part, SIZE, STRIDE)) for part in (data.train, data.test))

    def metrics(order: int) -> DataFrame:
        model = materialize(detect.fit_next_event(train, order, K))
        return evaluate.topk_metrics(detect.score_next_event(test, model, order), 1)

    found = detect.search(range(1, 5), metrics, 2, spark)
    return found.select("candidate", rounded("f1"), "stopped_at")


@query
def d7_shared_search(spark, folder):
    """The same choice from one pass over the windows for all orders."""
    data = dataset(spark, folder)
    train, test = (windows.sliding_windows(part, SIZE, STRIDE) for part in (data.train, data.test))
    return detect.search_orders(train, test, range(1, 5), 1, 2).select("candidate", rounded("f1"), "stopped_at")


@query
def d6_model_registry(spark, folder):
    """Models of three kinds, saved, loaded and held against the ones in memory on the test windows."""
    data = dataset(spark, folder)
    size, root = data.vocab_size(), scratch(spark, "models")
    train, test = (materialize(windows.sliding_windows(part, SIZE, STRIDE)) for part in (data.train, data.test))
    key, params = ["session_id", "window_idx"], {"size": SIZE, "stride": STRIDE}
    counts = materialize(features.count_features(test, size))
    fitted = {
        # Stored: saving and scoring read it many times, and would fit it anew each time.
        "next_event": materialize(detect.fit_next_event(train, ORDER, K)),
        "classifier": detect.fit_classifier(materialize(features.count_features(train, size).select("features", "anomaly"))),
        "directions": detect.fit_sparse_reconstruction(train, 3),
    }
    score = {
        "next_event": lambda m: detect.score_next_event(test, m, ORDER).select(*key, F.array_join("topk", ",").alias("v")),
        "classifier": lambda m: detect.score_classifier(m, counts).select(*key, F.round("score", 9).cast("string").alias("v")),
        "directions": lambda m: detect.score_sparse_reconstruction(m, test, size).select(*key, F.round("score", 9).cast("string").alias("v")),
    }
    parts = []
    for kind, model in fitted.items():
        models.save(model, root, kind, params, data.vocabulary)
        # A later version replaces the first one.
        models.save(model, root, kind, {**params, "again": True}, data.vocabulary)
        loaded = models.load(spark, root, kind)
        both = score[kind](model).join(score[kind](loaded.model).withColumnRenamed("v", "again"), key)
        parts.append(both.agg(F.lit(kind).alias("kind"), F.lit(loaded.version).alias("version"), F.count_if(F.col("v") == F.col("again")).alias("equal_scores")))
    return parts[0].union(parts[1]).union(parts[2])


# ---- evaluation -----------------------------------------------------------------------------


@query
def e1_hit_flags(spark, folder):
    return evaluate.flags_per_k(scored(spark, folder), K).select("session_id", "window_idx", "k", "hit_rank", "flag")


@query
def e2_sum_rollup(spark, folder):
    return evaluate.sum_rollup(evaluate.flags_per_k(scored(spark, folder), K), ["session_id", "k"])


@query
def e3_max_rollup(spark, folder):
    return evaluate.max_rollup(value_scores(spark, folder))


@query
def e4_percentile_flags(spark, folder):
    scores = value_scores(spark, folder)
    cut = evaluate.percentile(evaluate.max_rollup(scores), 1 - 0.03)
    return evaluate.flag_above_threshold(scores, cut).select("session_id", "window_idx", "score", "pred")


@query
def e4_percentile(spark, folder):
    scores = value_scores(spark, folder)
    parts = [
        evaluate.percentile(scores, p).select(F.lit(p).alias("p"), rounded("threshold")) for p in (0.03, 0.2, 0.5, 0.97)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def e5_binary_metrics(spark, folder):
    made = evaluate.topk_metrics(scored(spark, folder), K)
    return made.select("k", "tp", "fp", "fn", "tn", *[rounded(c) for c in ("f1", "rc", "pc", "acc")])


@query
def e5_window_metrics(spark, folder):
    made = evaluate.topk_metrics(scored(spark, folder), K, eval_type="window")
    return made.select("k", "tp", "fp", "fn", "tn", *[rounded(c) for c in ("f1", "rc", "pc", "acc")])


@query
def e6_best_k(spark, folder):
    return evaluate.best_k(evaluate.topk_metrics(scored(spark, folder), K)).select("k", rounded("f1"), rounded("rc"), rounded("pc"))


@query
def e7_normal_window_share(spark, folder):
    return evaluate.normal_window_share(scored(spark, folder)).select(rounded("normal_window_share"))


def _flagged(spark, folder, k: int) -> DataFrame:
    rank = evaluate.hit_rank()
    return scored(spark, folder).withColumn("flag", ((rank == 0) | (rank > k)).cast("int"))


@query
def e8_class_report(spark, folder):
    made = evaluate.class_report(_flagged(spark, folder, 1))
    return made.select("class", "support", "predicted", *[rounded(c) for c in ("f1", "rc", "pc")])


@query
def e8_macro_average(spark, folder):
    parts = [
        evaluate.macro_average(evaluate.class_report(_flagged(spark, folder, k))).select(F.lit(k).alias("k"), *[rounded(c) for c in ("f1", "rc", "pc")], "support")
        for k in (1, K)
    ]
    return parts[0].unionByName(parts[1])


@query
def e9_class_counts(spark, folder):
    return evaluate.class_counts(_flagged(spark, folder, 1))


@query
def e9_line_counts(spark, folder):
    return evaluate.anomaly_line_counts(_flagged(spark, folder, 1))


# ---- ml surface and flows -------------------------------------------------------------------


@query
def a1_feature_extractor(spark, folder):
    data = dataset(spark, folder)
    extractor = LogFeatureExtractor(featureType="quantitatives", windowSize=SIZE, stride=STRIDE)
    model = extractor.fit(data.train.drop("template_id"))
    return model.transform(data.test.drop("template_id")).select("session_id", "window_idx", joined("features"), "next_id", "anomaly")


@query
def a2_transformer_chain(spark, folder):
    lines = log_events(spark, folder).select("line_id", "ts", "template", "label")
    timed = GapChunkSessionizer(inputCol="ts", outputCol="group", interval=3600).transform(lines)
    coded = FirstSeenIndexer(inputCol="template", outputCol="ID").transform(timed)
    made = FrameWindower(inputCol="ID", outputCol="window", windowSize=5, stride=1).transform(coded)
    return made.select("group", "frame_idx", joined("window"), joined("labels"))


@query
def a4_time_session_samples(spark, folder):
    lines = flows.time_sessions(log_events(spark, folder), sessions.RANGE_SECONDS["thunderbird"])
    data = flows.prepare(lines, test_ratio=0.2)
    made = features.sequential(windows.sliding_windows(data.test, SIZE, 5))
    return made.select("session_id", "window_idx", joined("features"), "next_id", "anomaly")


@query
def a4_next_event_detection(spark, folder):
    made = flows.next_event_detection(user_log(spark, folder), SIZE, STRIDE, ORDER, K, train_anomaly_ratio=1.0)
    return made.select("k", *[rounded(c) for c in ("f1", "rc", "pc", "acc")])


def _session_counts(metrics: DataFrame, *more: str) -> DataFrame:
    """What metrics must agree with whatever the scores are: sessions (windows) and anomalous ones."""
    return metrics.select(
        *more,
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("units"), (F.col("tp") + F.col("fn")).alias("anomalous"),
        F.col("f1").between(0, 1).cast("int").alias("valid"),
    )


@query
def a4_window_classification(spark, folder):
    parts = [
        _session_counts(flows.window_classification(user_log(spark, folder), SIZE, STRIDE, features=kind)).select(F.lit(kind).alias("features"), "*")
        for kind in ("counts", "patterns")
    ]
    return parts[0].unionByName(parts[1])


@query
def a4_semantic_classification(spark, folder):
    lines = user_log(spark, folder)
    vectors = word_vectors(spark, folder, doc_vocab(spark, folder, docs=lines.select("template")))
    cut = flows.cut_windows(lines, SIZE, STRIDE)
    parts = [
        _session_counts(flows.window_classification(lines, SIZE, STRIDE, features=kind, vectors=vectors, cut=cut)).select(F.lit(kind).alias("features"), "*")
        for kind in ("embedding", "tfidf")
    ]
    return parts[0].unionByName(parts[1])


@query
def a4_window_results(spark, folder):
    """Window metrics and class report of the supervised flow."""
    made = flows.window_results(flows.scored_classification(user_log(spark, folder), SIZE, STRIDE))
    return _session_counts(made, "macro_support").withColumnRenamed("macro_support", "lines")


@query
def a4_reconstruction_detection(spark, folder):
    """Sessions above the percentile of their own scores: their number follows from the ratio where scores are distinct."""
    made = flows.reconstruction_detection(user_log(spark, folder), 0.03, SIZE, STRIDE, train_anomaly_ratio=1.0)
    return _session_counts(made)


@query
def a4_hdfs_time_sessions(spark, folder):
    """Labels by entity, sessions of 60 seconds, split, vocabulary, windows of 50 lines every 5."""
    lines = log_events(spark, folder).select("line_id", "ts", "content", "template")
    labelled = normalize.line_labels_from_entities(lines, entity_labels(spark, folder))
    made = flows.time_sessions(labelled.select("line_id", "ts", "template", "label"), sessions.RANGE_SECONDS["hdfs"])
    data = flows.prepare(made, test_ratio=0.2)
    windowed = features.sequential(windows.sliding_windows(data.test, 50, 5))
    return windowed.select("session_id", "window_idx", joined("features"), "next_id", "anomaly")


@query
def g2_incomplete_lines(spark, folder):
    """Lines with missing users and seconds keep their place: sessions by user, anchored."""
    lines = normalize.seconds_since_first(log_events(spark, folder)).select(
        F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"), "line_id",
        F.when(F.col("line_id") % 7 != 0, F.col("sec")).alias("sec"),
    )
    return sessions.anchored_sessions(lines, sessions.RANGE_SECONDS["bgl"], partition_cols=["user_id"])


@query
def g3_incomplete_lines(spark, folder):
    """The same for sessions by gap and chunk."""
    lines = log_events(spark, folder).select(
        F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"), "line_id",
        F.when(F.col("line_id") % 7 != 0, F.col("ts")).alias("ts"),
    )
    return sessions.gap_chunk_sessions(lines, 36_000, partition_cols=["user_id"]).select("user_id", "line_id", "session_id")


@query
def a1_semantic_extractor(spark, folder):
    """Token ids of windows by a fitted model, with the anomaly as the label."""
    data = dataset(spark, folder)
    extractor = LogFeatureExtractor(featureType="semantics", labelType="anomaly", windowSize=SIZE, stride=STRIDE)
    model = extractor.fit(data.train.drop("template_id"))
    meta = model.metadata().first()
    made = model.transform(data.test.drop("template_id"))
    return made.select("session_id", "window_idx", nested("features"), "anomaly",
                       F.lit(meta["num_labels"]).alias("num_labels"), F.lit(meta["vocab_size"]).alias("vocab_size"))


@query
def a1_tfidf_windows(spark, folder):
    """Mean tf-idf rows of windows of three document lines: how many tokens each has, and the squared length."""
    docs = doc_templates(spark, folder)
    lines = docs.select(F.col("doc_id").cast("string").alias("session_id"), "line_id", "template", F.lit(0).alias("label"))
    placed = materialize(sessions.with_positions(lines), "zstd")
    discard(docs)
    extractor = LogFeatureExtractor(featureType="semantics", windowSize=3, stride=2, useTfidf=True)
    model = extractor.fit(placed)
    made, dictionary = model.transform_late(placed)
    discard(placed)
    rows = features.window_tfidf(made, dictionary, 3)
    discard(model.templates)
    return rows.groupBy("session_id", "window_idx").agg(
        F.count(F.lit(1)).alias("tokens"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squared_length"))
