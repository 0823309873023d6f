"""Detectors: which event comes next, is a window anomalous, how badly does it reconstruct."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.columns import hash_order, hash_prefix
from logweave.operators.contexts import context, next_event_counts, suffixes
from logweave.operators.directions import fit_directions, id_pattern, score_directions, weighted_rows
from logweave.operators.evaluate import binary_metrics
from logweave.operators.features import count_features, sparse_vector
from logweave.operators.ordering import running
from logweave.runtime import BROADCAST_ROWS, broadcast_if_small, discard, is_small, materialize

# Fixed value: widths of the local patterns used for supervised classification.
PATTERN_WIDTHS = (2, 3, 4)

# ---- next event -----------------------------------------------------------------------------


def fit_next_event(windows: DataFrame, order: int, k: int) -> DataFrame:
    """``context, topk``: the k most frequent next events per context, smaller id first on ties."""
    counts = next_event_counts(windows, order)
    ranking = Window.partitionBy("context").orderBy(F.desc("n"), "next_id")
    best = counts.withColumn("_rank", F.row_number().over(ranking)).where(F.col("_rank") <= k)
    return best.groupBy("context").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "next_id")))["next_id"].alias("topk")
    )


def _fallback(model: DataFrame) -> list[Column]:
    """What is predicted where no context is known."""
    return [model.where("context = ''").select("topk").scalar(), F.array().cast("array<int>")]


def _looked_up(windows: DataFrame, known: DataFrame, order: int) -> tuple[DataFrame, list[str]]:
    """``windows`` with ``_topk1 ..``: what the last 1 .. ``order`` events predict, null where they are no context of ``known``."""
    # Contexts of all lengths share one table, so one broadcast serves every lookup.
    for m in range(1, order + 1):
        found = F.broadcast(known.select(F.col("context").alias(f"_context{m}"), F.col("topk").alias(f"_topk{m}")))
        # A window shorter than m events repeats the lookup of its whole length.
        windows = windows.withColumn(f"_context{m}", context(m)).join(found, f"_context{m}", "left")
    return windows, [f"_topk{m}" for m in range(1, order + 1)]


def score_orders(windows: DataFrame, model: DataFrame, orders: Iterable[int], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every window once per order, with ``order`` and ``topk`` as the model of that order predicts them.

    ``model`` is fitted with the largest order: its contexts of up to m events are the model of order m. The windows are read
    and looked up once for all orders; what leaves the lookup repeats only the few columns an evaluation needs
    (``session_id, window_idx, next_id, anomaly``).
    """
    orders, known = sorted(orders), model.where("context != ''")
    default = _fallback(model)
    slim = windows.select("session_id", "window_idx", "ids", "length", "next_id", "anomaly")
    if is_small(known, broadcast_rows):
        looked, tries = _looked_up(slim, known, orders[-1])
    else:
        keyed = slim.withColumn("_context", context(orders[-1]))
        distinct = materialize(keyed.select("_context").distinct())
        each = distinct.select("_context", F.posexplode(suffixes("_context")).alias("_dropped", "context")).join(known, "context")
        size = F.size(F.split("_context", " ")) - F.col("_dropped")
        by_size = each.groupBy("_context").agg(*[F.max(F.when(size == m, F.col("topk"))).alias(f"_topk{m}") for m in range(1, orders[-1] + 1)])
        looked = keyed.join(broadcast_if_small(materialize(by_size), broadcast_rows), "_context", "left")
        tries = [f"_topk{m}" for m in range(1, orders[-1] + 1)]
    chosen = [
        F.struct(F.lit(m).alias("order"), F.coalesce(*[F.col(t) for t in reversed(tries[:m])], *default).alias("topk")) for m in orders
    ]
    return looked.select("session_id", "window_idx", "next_id", "anomaly", F.inline(F.array(*chosen)))


def search_orders(train: DataFrame, test: DataFrame, orders: Iterable[int], k: int, patience: int) -> DataFrame:
    """The order of the next-event model with the best session F1, as a search that stops after ``patience`` orders without a
    better one finds it; ``candidate, f1, stopped_at``, with the orders numbered from 1.

    One fit, one pass over the test windows and one over the sessions serve all orders; patience applies to the table of
    their metrics.
    """
    orders = sorted(orders)
    model = materialize(fit_next_event(train, orders[-1], k))
    hits = score_orders(test, model, orders).withColumn("_hit", F.array_position("topk", F.col("next_id")))
    missed = ((F.col("_hit") == 0) | (F.col("_hit") > k)).cast("int")
    sessions = hits.groupBy("order", "session_id").agg(F.max(missed).alias("pred"), (F.max("anomaly") > 0).cast("int").alias("truth"))
    cases = sessions.groupBy("order", "pred", "truth").agg(F.count(F.lit(1)).alias("_n"))
    metrics = binary_metrics(cases, ["order"], "_n")
    number = F.array_position(F.array(*map(F.lit, orders)), F.col("order")).cast("int")
    return select_best(materialize(metrics.select(number.alias("candidate"), "f1")), patience)


def score_next_event(
    windows: DataFrame, model: DataFrame, order: int, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``topk``: predictions of the longest context seen in training.

    A small model is looked up once per context length, without moving the windows. Beyond the
    broadcast bounds the back-off is resolved once per distinct context instead.
    Pass a stored model (see ``save_table``): it is read several times.
    """
    known = model.where("context != ''")
    default = _fallback(model)
    if is_small(known, broadcast_rows):
        looked, tries = _looked_up(windows, known, order)
        added = [f"_context{m}" for m in range(1, order + 1)] + tries
        return looked.withColumn("topk", F.coalesce(*reversed(tries), *default)).drop(*added)
    keyed = windows.withColumn("_context", context(order))
    distinct = materialize(keyed.select("_context").distinct())
    tries = distinct.select("_context", F.posexplode(suffixes("_context")).alias("_dropped", "context"))
    best = tries.join(known, "context").groupBy("_context").agg(F.min_by("topk", "_dropped").alias("topk"))
    resolved = broadcast_if_small(materialize(best), broadcast_rows)
    return (
        keyed.join(resolved, "_context", "left")
        .withColumn("topk", F.coalesce("topk", *default))
        .drop("_context")
    )


# ---- supervised classification --------------------------------------------------------------


def window_patterns(windows: DataFrame) -> DataFrame:
    """``session_id, window_idx, pattern``: the distinct runs of ``PATTERN_WIDTHS`` ids in each window, as text."""
    words = F.transform("ids", lambda x: x.cast("string"))
    runs = [
        F.when(F.size("ids") >= n, F.transform(
            F.sequence(F.lit(1), F.size("ids") - (n - 1)), _run(words, n)
        )).otherwise(F.array().cast("array<string>"))
        for n in PATTERN_WIDTHS
    ]
    return windows.select("session_id", "window_idx", F.explode(F.array_distinct(F.concat(*runs))).alias("pattern"))


def _run(words: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def fit_patterns(windows: DataFrame, seed: int = 42) -> DataFrame:
    """``pattern, pattern_id``: every pattern of the training windows, numbered from 0 in a hashed order."""
    found = window_patterns(windows).select("pattern").distinct().withColumn("_h", hash_order(seed, F.col("pattern")))
    ranked = running(materialize(found), [], ["_h", "pattern"], {"_rn": ("row_number", None)}, split_on=hash_prefix(F.col("_h")))
    return ranked.select("pattern", (F.col("_rn") - 1).cast("int").alias("pattern_id"))


def pattern_features(
    windows: DataFrame, patterns: DataFrame, size: int, output: str = "features", found: str | None = None
) -> DataFrame:
    """Which of the ``size`` fitted ``patterns`` occur in a window, as a sparse binary vector; others are left out.

    ``found`` names a column for their ids, ascending.
    """
    known = window_patterns(windows).join(broadcast_if_small(patterns), "pattern")
    by_window = known.groupBy("session_id", "window_idx").agg(F.sort_array(F.collect_list("pattern_id")).alias("_found"))
    joined = windows.join(by_window, ["session_id", "window_idx"], "left")
    ids = F.coalesce("_found", F.array().cast("array<int>"))
    made = joined.withColumn(output, sparse_vector(ids, F.transform(ids, lambda _: F.lit(1.0)), size))
    return (made if found is None else made.withColumn(found, ids)).drop("_found")


def fit_classifier(
    featured: DataFrame, kind: str = "logistic", max_iter: int = 50, layers: Iterable[int] | None = None, seed: int = 42
) -> Model:
    """Window classifier on ``features`` and ``anomaly``; ``kind`` is ``logistic`` or ``perceptron``.

    A logistic fit is solved to its optimum, so it does not depend on row order.
    """
    data = featured.select("features", F.col("anomaly").cast("double").alias("anomaly"))
    columns = {"featuresCol": "features", "labelCol": "anomaly", "predictionCol": "pred_class"}
    if kind == "logistic":
        return LogisticRegression(maxIter=max_iter, regParam=0.01, **columns).fit(data)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(
            maxIter=max_iter, layers=list(layers or ()), seed=seed, **columns
        ).fit(data)
    raise ValueError(f"unknown classifier {kind!r}")


def fit_trees(featured: DataFrame, rounds: int = 30, depth: int = 4, step: float = 0.2, seed: int = 42) -> Model:
    """Boosted trees on ``features`` and ``anomaly``, both classes with the same weight in all: unlike a logistic fit, they see
    which events stand together in a window. Every round uses all windows."""
    data = featured.select("features", F.col("anomaly").cast("double").alias("anomaly"))
    total, bad = data.agg(F.count(F.lit(1)), F.sum("anomaly")).first()
    share = (bad or 0) / total if total else 0.0
    # With one class only there is nothing to balance.
    weight = F.lit(1.0) if share in (0.0, 1.0) else F.when(F.col("anomaly") > 0, 0.5 / share).otherwise(0.5 / (1 - share))
    trees = GBTClassifier(
        featuresCol="features", labelCol="anomaly", predictionCol="pred_class", weightCol="weight", maxIter=rounds, maxDepth=depth,
        stepSize=step, subsamplingRate=1.0, featureSubsetStrategy="all", seed=seed,
    )
    return trees.fit(materialize(data.withColumn("weight", weight)))


def best_threshold(scored: DataFrame) -> DataFrame:
    """One row ``threshold, f1``: the score from which on windows (``score, anomaly``) are flagged for the best F1, exactly.

    Only scores that occur are thresholds; the largest of the best ones is taken. Windows are added up by score first,
    and the running sums are made in parallel. Without an anomalous window, F1 is 0 and the threshold the largest score; no
    windows give a row of nulls.
    """
    by_score = materialize(scored.groupBy((-F.col("score")).alias("_down")).agg(
        F.sum(F.col("anomaly").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")))
    positives = by_score.agg(F.sum("bad")).scalar()
    ranked = running(by_score, [], ["_down"], {"_tp": ("sum", "bad"), "_flagged": ("sum", "n")})
    f1 = F.when(F.col("_tp") > 0, 2 * F.col("_tp") / (F.col("_flagged") + positives)).otherwise(0.0)
    best = ranked.select(F.struct(f1.alias("f1"), (-F.col("_down")).alias("threshold")).alias("b")).agg(F.max("b").alias("b"))
    return best.select("b.threshold", "b.f1")


def flag_from_threshold(scored: DataFrame, threshold: DataFrame) -> DataFrame:
    """Windows with ``flag``: whether the score reaches the one-row ``threshold``."""
    cut = threshold.select("threshold").scalar()
    return scored.withColumn("flag", F.coalesce((F.col("score") >= cut).cast("int"), F.lit(0)))


def score_classifier(model: Model, featured: DataFrame) -> DataFrame:
    """Add ``score`` (probability of an anomaly) and ``flag``."""
    scored = model.transform(featured)
    return scored.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "flag", F.col("pred_class").cast("int")
    ).drop("rawPrediction", "probability", "pred_class")


# ---- reconstruction error -------------------------------------------------------------------


def fit_reconstruction(windows: DataFrame, vocab_size: int, components: int = 3) -> PipelineModel:
    """Centre the window counts and keep their main directions."""
    counted = count_features(windows, vocab_size, "_counts")
    stages = [
        StandardScaler(withMean=True, withStd=False, inputCol="_counts", outputCol="_centred"),
        PCA(k=min(components, vocab_size - 1), inputCol="_centred", outputCol="_projected"),
    ]
    # Stored, because the fit reads it several times.
    return Pipeline(stages=stages).fit(materialize(counted.select("_counts")))


def score_reconstruction(model: PipelineModel, windows: DataFrame, vocab_size: int) -> DataFrame:
    """Add ``score``: mean squared part of the counts outside the main directions, and ``total``: that of all centred counts."""
    made = model.transform(count_features(windows, vocab_size, "_counts"))
    def square_sum(column: str) -> Column:
        return F.aggregate(vector_to_array(column), F.lit(0.0), lambda acc, x: acc + x * x)
    # The directions are orthonormal, so the residual is the difference of the squared lengths.
    residual = F.greatest(square_sum("_centred") - square_sum("_projected"), F.lit(0.0))
    return made.withColumn("score", residual / (vocab_size - 1)).withColumn(
        "total", square_sum("_centred") / (vocab_size - 1)).drop("_counts", "_centred", "_projected")


def fit_sparse_reconstruction(windows: DataFrame, components: int = 3) -> DataFrame:
    """The mean counts and main directions of the windows, found without a matrix of the vocabulary; see ``directions``."""
    return fit_directions(weighted_rows(windows.select(id_pattern(F.col("ids")).alias("pattern"))), components)


def score_sparse_reconstruction(model: DataFrame, windows: DataFrame, vocab_size: int) -> DataFrame:
    """Add ``score`` and ``total`` as ``score_reconstruction`` does. Windows with equal counts are scored once."""
    keyed = windows.withColumn("_pattern", id_pattern(F.col("ids")))
    rows = weighted_rows(keyed.select("_pattern"), "_pattern")
    scored = materialize(score_directions(model, rows, float(vocab_size - 1)).select(F.col("pattern").alias("_pattern"), "score", "total"))
    discard(rows)
    return keyed.join(broadcast_if_small(scored), "_pattern", "left").drop("_pattern")


# ---- models on disk, choice of a model ------------------------------------------------------


def save_table(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def select_best(metrics: DataFrame, patience: int) -> DataFrame:
    """Candidate chosen by a run that stops after ``patience`` candidates without a better F1.

    ``metrics`` has one row per candidate: ``candidate`` (its order, from 1) and ``f1``. Returns
    ``candidate, f1, stopped_at``; the earliest candidate wins ties. The table is as long
    as the list of candidates.
    """
    order = Window.orderBy("candidate")
    # The best-so-far rises from below every score, so the first candidate always counts.
    seen = metrics.withColumn("_before", F.max("f1").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    better = seen.withColumn("_better", F.col("_before").isNull() | (F.col("f1") > F.col("_before")))
    since = better.withColumn("_row", F.row_number().over(order)).withColumn(
        "_last", F.max(F.when(F.col("_better"), F.col("_row"))).over(order)
    )
    waits = since.withColumn("_stop", F.min(F.when(F.col("_row") - F.col("_last") >= patience, F.col("_row"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    run = waits.where(F.col("_stop").isNull() | (F.col("_row") <= F.col("_stop")))
    return run.agg(
        F.max(F.struct(F.col("f1"), (-F.col("_row")).alias("r"), "candidate")).alias("_best"),
        F.max("candidate").alias("stopped_at"),
    ).select(F.col("_best.candidate").alias("candidate"), F.col("_best.f1").alias("f1"), "stopped_at")


def search(candidates: Iterable, evaluate: Callable[[object], DataFrame], patience: int, spark: SparkSession) -> DataFrame:
    """Evaluate candidates one after another and stop after ``patience`` misses.

    ``evaluate`` returns a one-row metrics table with ``f1``; every evaluation is a
    Spark job, only its single F1 comes back to the driver.
    """
    done: list[tuple[int, float]] = []
    best, misses = float("-inf"), 0
    for number, candidate in enumerate(candidates, 1):
        f1 = float(evaluate(candidate).select("f1").first()[0])
        done.append((number, f1))
        misses = 0 if f1 > best else misses + 1
        best = max(best, f1)
        if misses >= patience:
            break
    return select_best(spark.createDataFrame(done, "candidate int, f1 double"), patience)
