"""End-to-end flows: session lines in, detection metrics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.columns import hash_unit
from logweave.operators import detect, evaluate
from logweave.operators.features import count_features, mean_pooled, summed_embedding, tfidf, weighted_embedding
from logweave.operators.normalize import seconds_since_first
from logweave.operators.sessions import anchored_sessions, session_rollup, with_positions
from logweave.operators.splits import sample_train_anomalies, split_sessions
from logweave.operators.vocab import (
    OOV_ID,
    encode_templates,
    stored,
    template_vocabulary,
    token_vocabulary,
    vocabulary_vectors,
)
from logweave.operators.windows import sliding_windows
from logweave.runtime import broadcast_if_small, materialize


@dataclass
class Dataset:
    """Encoded session lines by split, and the vocabulary of the training part."""

    lines: DataFrame
    vocabulary: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.lines.where("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.lines.where("split = 'test'")

    def vocab_size(self) -> int:
        return self.vocabulary.count() + 2


def time_sessions(lines: DataFrame, range_seconds: int) -> DataFrame:
    """Normalized lines as anchored time sessions, in the form the flows take."""
    timed = seconds_since_first(lines).select("line_id", "sec", "template", "label")
    made = anchored_sessions(timed, range_seconds)
    return made.withColumn("session_id", F.col("session_id").cast("string")).drop("sec")


def prepare(
    lines: DataFrame, test_ratio: float = 0.2, train_anomaly_ratio: float = 1.0, random: bool = True, seed: int = 42
) -> Dataset:
    """Split the sessions, number their lines and encode the templates.

    ``lines`` needs ``session_id, line_id, template, label``. The result is stored once: the vocabulary,
    the training windows and the test windows all read it.
    """
    slim = lines.select("session_id", "line_id", "template", "label")
    split = split_sessions(session_rollup(slim), test_ratio, random=random, seed=seed)
    chosen = materialize(sample_train_anomalies(split, train_anomaly_ratio).select("session_id", "split"))
    kept = slim.join(broadcast_if_small(chosen), "session_id")
    placed = materialize(with_positions(kept))
    vocabulary = stored(template_vocabulary(placed.where("split = 'train'")))
    return Dataset(encode_templates(placed, vocabulary), vocabulary)


def scored_next_event(
    data: Dataset, size: int = 10, stride: int = 1, order: int = 3, k: int = 5
) -> DataFrame:
    """Test windows with the predictions of a model of the training windows."""
    model = materialize(detect.fit_next_event(sliding_windows(data.train, size, stride), order, k))
    return detect.score_next_event(sliding_windows(data.test, size, stride), model, order)


def next_event_detection(
    lines: DataFrame, size: int = 10, stride: int = 1, order: int = 3, k: int = 5,
    test_ratio: float = 0.2, train_anomaly_ratio: float = 0.0, random: bool = True, eval_type: str = "session",
) -> DataFrame:
    """Metrics for every cut-off 1..k of the next-event detector."""
    data = prepare(lines, test_ratio, train_anomaly_ratio, random)
    return evaluate.topk_metrics(scored_next_event(data, size, stride, order, k), k, eval_type)


def template_vectors(lines: DataFrame, data: Dataset, vectors: DataFrame | None, weighting: str) -> DataFrame:
    """``template_id, vec`` of the training vocabulary: summed word vectors, or weighted by tf-idf of the training lines.

    ``vectors`` is ``token, vec``.
    """
    dim = vectors.select(F.max(F.size("vec"))).first()[0]
    tokens = stored(token_vocabulary(data.vocabulary))
    table = stored(vocabulary_vectors(tokens, vectors, dim))
    if weighting == "embedding":
        made = summed_embedding(data.vocabulary, tokens, table)
    else:
        made = weighted_embedding(tfidf(data.vocabulary, data.train, tokens), table)
    return materialize(made.join(data.vocabulary, "template").select("template_id", "vec"))


def _pooled(data: Dataset, windows: DataFrame, table: DataFrame, size: int) -> DataFrame:
    dim = table.select(F.max(F.size("vec"))).first()[0] or 0
    pooled = mean_pooled(windows, table, size, dim, OOV_ID)
    return pooled.withColumn("features", array_to_vector("features"))


@dataclass
class Cut:
    """A data set with its training and test windows, stored."""

    data: Dataset
    train: DataFrame
    test: DataFrame


def cut_windows(lines: DataFrame, size: int = 10, stride: int = 1, *args, **options) -> Cut:
    """Split, encode and cut the lines once for several classifiers; further arguments are those of ``prepare``."""
    data = prepare(lines, *args, **options)
    return Cut(data, *[materialize(sliding_windows(part, size, stride)) for part in (data.train, data.test)])


def scored_classification(
    lines: DataFrame, size: int = 10, stride: int = 1, features: str = "counts",
    test_ratio: float = 0.2, train_anomaly_ratio: float = 1.0, random: bool = True, vectors: DataFrame | None = None,
    cut: Cut | None = None,
) -> DataFrame:
    """Test windows with ``score`` and ``flag`` of the supervised classifier.

    ``features``: ``counts``, ``patterns``, or means over the window's lines of their summed word vectors
    (``embedding``) or tf-idf weighted ones (``tfidf``); the last two need ``vectors`` (``token, vec``). ``cut`` is what ``cut_windows``
    made of the same lines, for several classifiers of the same windows.
    """
    if cut is None:
        data = prepare(lines, test_ratio, train_anomaly_ratio, random)
        train, test = (sliding_windows(part, size, stride) for part in (data.train, data.test))
    else:
        data, train, test = cut.data, cut.train, cut.test
    if features == "counts":
        vocab_size = data.vocab_size()
        featured = lambda windows: count_features(windows, vocab_size)
    elif features == "patterns":
        patterns = materialize(detect.fit_patterns(train))
        count = patterns.count()
        featured = lambda windows: detect.pattern_features(windows, patterns, count)
    elif features in ("embedding", "tfidf"):
        table = template_vectors(lines, data, vectors, features)
        if cut is None:
            train, test = materialize(train), materialize(test)
        # Only these columns take part in the fit.
        train = train.select("session_id", "window_idx", "length", "ids", "anomaly")
        featured = lambda windows: _pooled(data, windows, table, size)
    else:
        raise ValueError(f"unknown features {features!r}")
    model = detect.fit_classifier(materialize(featured(train).select("features", "anomaly")))
    return detect.score_classifier(model, featured(test))


def tree_classification(
    data: Dataset, size: int = 10, stride: int = 1, validation: float = 0.25, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Test windows with ``score`` and ``flag`` of boosted trees on the windows' event counts, and the threshold (``threshold, f1``).

    A share of the training sessions, by hash, is kept out of the fit; on their windows the threshold is chosen.
    """
    vocab_size = data.vocab_size()
    held = hash_unit(seed, F.col("session_id")) < validation
    train = materialize(count_features(sliding_windows(data.train, size, stride), vocab_size).withColumn("_held", held))
    model = detect.fit_trees(train.where("not _held"))
    threshold = materialize(detect.best_threshold(detect.score_classifier(model, train.where("_held"))))
    test = detect.score_classifier(model, count_features(sliding_windows(data.test, size, stride), vocab_size))
    return detect.flag_from_threshold(test, threshold), threshold


def window_classification(lines: DataFrame, *args, **options) -> DataFrame:
    """Session metrics of the supervised window classifier; see ``scored_classification``."""
    return evaluate.binary_metrics(evaluate.sum_rollup(scored_classification(lines, *args, **options)))


def scored_reconstruction(
    lines: DataFrame, anomaly_ratio: float, size: int = 10, stride: int = 1, components: int = 3,
    test_ratio: float = 0.2, train_anomaly_ratio: float = 0.0, random: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Test windows with ``score`` and ``flag``, and their sessions with ``score, truth, pred``.

    The cut is the ``1 - anomaly_ratio`` percentile of the session scores, for windows and sessions alike.
    """
    data = prepare(lines, test_ratio, train_anomaly_ratio, random)
    vocab_size = data.vocab_size()
    model = detect.fit_sparse_reconstruction(sliding_windows(data.train, size, stride), components)
    windows = materialize(detect.score_sparse_reconstruction(model, sliding_windows(data.test, size, stride), vocab_size))
    sessions = materialize(evaluate.max_rollup(windows))
    threshold = materialize(evaluate.percentile(sessions, 1 - anomaly_ratio))
    return (
        evaluate.flag_above_threshold(windows, threshold, output="flag"),
        evaluate.flag_above_threshold(sessions, threshold),
    )


def reconstruction_detection(lines: DataFrame, anomaly_ratio: float, *args, **options) -> DataFrame:
    """Session metrics of the reconstruction score; see ``scored_reconstruction``."""
    return evaluate.binary_metrics(scored_reconstruction(lines, anomaly_ratio, *args, **options)[1])


def window_results(flagged: DataFrame) -> DataFrame:
    """One row for any flow's windows (``flag, anomaly, an_classes``): window metrics, and the macro average of the
    class report of their lines (``macro_...``)."""
    cases = flagged.select(F.col("flag").alias("pred"), F.col("anomaly").alias("truth"))
    metrics = evaluate.binary_metrics(cases)
    macro = evaluate.macro_average(evaluate.class_report(flagged))
    row = macro.select(F.struct(*macro.columns).alias("m")).scalar()
    return metrics.select("*", *[row[c].alias(f"macro_{c}") for c in macro.columns])
