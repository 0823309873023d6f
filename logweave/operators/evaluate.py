"""From window predictions to session and line metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.ordering import PART_ROWS, running
from logweave.runtime import materialize

# Half-width, as a share of all rows, of the bracket in which a percentile is looked up exactly,
# and the accuracy of the approximate percentiles that set it.
BRACKET = 1e-4
BRACKET_ACCURACY = 100_000


def hit_rank(topk: str = "topk", next_id: str = "next_id") -> Column:
    """1-based place of the true next event among the predictions, 0 when it is missing."""
    return F.array_position(topk, F.col(next_id)).cast("int")


def flags_per_k(windows: DataFrame, k: int) -> DataFrame:
    """One row per window and cut-off 1..k: flagged when the true event is not among the first."""
    ranked = windows.withColumn("hit_rank", hit_rank())
    return ranked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn(
        "flag", ((F.col("hit_rank") == 0) | (F.col("hit_rank") > F.col("k"))).cast("int")
    )


def sum_rollup(windows: DataFrame, by: Sequence[str] = ("session_id",), flag: str = "flag") -> DataFrame:
    """Session is predicted (is) anomalous when any of its windows is."""
    return windows.groupBy(*by).agg(
        (F.sum(flag) > 0).cast("int").alias("pred"), (F.sum("anomaly") > 0).cast("int").alias("truth")
    )


def max_rollup(windows: DataFrame, score: str = "score") -> DataFrame:
    """Highest window score and any-anomaly label per session."""
    return windows.groupBy("session_id").agg(
        F.max(score).alias("score"), (F.max("anomaly") > 0).cast("int").alias("truth")
    )


def percentile(scores: DataFrame, p: float, score: str = "score", part_rows: int = PART_ROWS) -> DataFrame:
    """One row ``threshold``: exact percentile with linear interpolation, ``p`` in [0, 1].

    Approximate percentiles bracket the two neighbouring order statistics; only the distinct
    scores inside the bracket are ordered, so no task sees all scores.
    """
    lo, hi = max(p - BRACKET, 0.0), min(p + BRACKET, 1.0)
    around = F.percentile_approx(score, [lo, hi], BRACKET_ACCURACY)
    # The bracket spans at least a few ranks on both sides once the table is this long.
    long_enough = F.count(score) * F.lit(BRACKET) > 10
    bounds = scores.agg(
        F.count(score).alias("n"),
        F.when(long_enough, around[0]).otherwise(F.min(score)).alias("lo"),
        F.when(long_enough, around[1]).otherwise(F.max(score)).alias("hi"),
    ).select(F.struct("n", "lo", "hi").alias("b")).scalar()
    below = scores.where(F.col(score) < bounds["lo"]).agg(F.count(F.lit(1))).scalar()
    inside = (
        scores.where(F.col(score).between(bounds["lo"], bounds["hi"]))
        .groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    )
    # Ranked in ranges where the bracket is long, so no task orders more than a fixed number of scores.
    ranked = running(materialize(inside), [], ["_s"], {"_upto": ("sum", "_c")}, part_rows=part_rows).withColumn(
        "_upto", F.col("_upto") + below)
    at = (bounds["n"] - 1) * F.lit(float(p))
    # The order statistic at 0-based rank r is the smallest score with more than r scores up to it.
    picked = ranked.agg(
        F.min(F.when(F.col("_upto") > F.floor(at), F.col("_s"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_s"))).alias("_b"),
    )
    return picked.select(
        (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias("threshold")
    )


def flag_above_threshold(scored: DataFrame, threshold: DataFrame, score: str = "score", output: str = "pred") -> DataFrame:
    """Flag rows whose score is strictly above the one-row threshold."""
    cut = threshold.select("threshold").scalar()
    return scored.withColumn(output, (F.col(score) > cut).cast("int"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(0.0)


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fn).alias("rc"),
        _ratio(tp, tp + fp).alias("pc"),
    ]


def binary_metrics(predictions: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """F1, recall, precision and accuracy of ``pred`` against ``truth``; 0 where undefined."""
    w = F.lit(1) if weight is None else F.col(weight)
    hit, real = F.col("pred") == 1, F.col("truth") == 1
    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, w).otherwise(0)), F.lit(0))
    counts = predictions.groupBy(*by).agg(
        count(hit & real).alias("tp"), count(hit & ~real).alias("fp"),
        count(~hit & real).alias("fn"), count(~hit & ~real).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", *_scores(tp, fp, fn), _ratio(tp + tn, tp + tn + fp + fn).alias("acc"))


def topk_metrics(windows: DataFrame, k: int, eval_type: str = "session") -> DataFrame:
    """Binary metrics for every cut-off 1..k.

    A session is flagged at a cut-off when its worst hit rank lies beyond it, so one
    pass keeps a single number per session and a histogram of k+1 values
    serves all cut-offs.
    """
    rank = hit_rank()
    worst = F.when((rank == 0) | (rank > k), k + 1).otherwise(rank)
    units = windows.select("session_id", worst.alias("worst"), "anomaly")
    if eval_type == "session":
        units = units.groupBy("session_id").agg(F.max("worst").alias("worst"), F.max("anomaly").alias("anomaly"))
    histogram = units.groupBy("worst", (F.col("anomaly") > 0).cast("int").alias("truth")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = histogram.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return binary_metrics(cuts.withColumn("pred", (F.col("worst") > F.col("k")).cast("int")), ["k"], "_n")


def best_k(metrics: DataFrame) -> DataFrame:
    """The cut-off with the highest F1; the larger one on ties."""
    return metrics.orderBy(F.desc("f1"), F.desc("k")).limit(1)


def normal_window_share(windows: DataFrame) -> DataFrame:
    """Share of windows that are not anomalous (the same for every cut-off)."""
    return windows.agg((1 - F.avg(F.col("anomaly").cast("double"))).alias("normal_window_share"))


def _class_counts(windows: DataFrame, flag: str) -> DataFrame:
    """Lines per true class and window flag: the only thing the class reports need."""
    lines = windows.select(F.explode("an_classes").alias("class"), F.col(flag).alias("flag"))
    return lines.groupBy("class", "flag").agg(F.count(F.lit(1)).alias("n"))


def class_report(windows: DataFrame, flag: str = "flag") -> DataFrame:
    """Per-class precision, recall, F1 and support of the line predictions.

    A line of a flagged window is predicted as its true class and any other line as
    class 0, so the report measures how well windows locate anomalous lines.
    """
    counts = _class_counts(windows, flag)
    hit = F.col("flag") > 0
    real = counts.select("class", F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(hit | (F.col("class") == 0), F.col("n")).otherwise(0).alias("tp"))
    guessed = counts.select(F.when(hit, F.col("class")).otherwise(0).alias("class"), F.lit(0).cast("long").alias("support"),
                            F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))
    sums = real.unionByName(guessed).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    tp, pred, sup = F.col("tp"), F.col("predicted"), F.col("support")
    return sums.select("class", "support", "predicted", *_scores(tp, pred - tp, sup - tp))


def macro_average(report: DataFrame) -> DataFrame:
    return report.agg(
        F.avg("f1").alias("f1"), F.avg("rc").alias("rc"), F.avg("pc").alias("pc"), F.sum("support").alias("support")
    )


def class_counts(windows: DataFrame, flag: str = "flag") -> DataFrame:
    """Predicted and true lines per class."""
    return class_report(windows, flag).select("class", "predicted", F.col("support").alias("actual"))


def anomaly_line_counts(windows: DataFrame, flag: str = "flag") -> DataFrame:
    """One row: flagged and all windows; predicted, true and all lines."""
    per_window = windows.agg(
        F.sum((F.col(flag) > 0).cast("long")).alias("flagged_windows"), F.count(F.lit(1)).alias("windows"),
        F.sum(F.when(F.col(flag) > 0, F.size(F.filter("an_classes", lambda c: c > 0))).otherwise(0)).alias("predicted_lines"),
        F.sum(F.size(F.filter("an_classes", lambda c: c > 0))).alias("anomalous_lines"),
        F.sum(F.size("an_classes")).alias("lines"),
    )
    return per_window
