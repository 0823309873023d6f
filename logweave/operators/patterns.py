"""Local patterns that tell anomalous windows from others: frequent runs of events, mined by growing width.

A run of events can only be frequent where the run without its first and that without its last event are, so each width counts just
the runs that the one before leaves. Windows with equal events are counted once. Of the frequent runs a fixed number stays:
those whose occurrence depends most on the label, by the chi-square statistic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.detect import PATTERN_WIDTHS, pattern_features
from logweave.runtime import broadcast_if_small, discard, materialize


def real_ids() -> Column:
    """The events of a window, without its filler."""
    return F.slice("ids", F.lit(1), F.col("length"))


def _runs(width: int) -> Column:
    """The distinct runs of a window, each with the runs that lack its last and its first event, as text."""
    words = F.transform("ids", lambda x: x.cast("string"))
    part = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    runs = F.transform(F.sequence(F.lit(1), F.size("ids") - (width - 1)), lambda i: F.struct(
        part(i, F.lit(width)).alias("pattern"), part(i, F.lit(width - 1)).alias("head"), part(i + 1, F.lit(width - 1)).alias("tail")
    ))
    return F.array_distinct(F.when(F.size("ids") >= width, runs))


def frequent_patterns(windows: DataFrame, share: float = 0.001, widths: tuple[int, ...] = PATTERN_WIDTHS) -> DataFrame:
    """``pattern, width, support, anomalous``: runs of events in at least ``share`` of the windows, and in how many of them and
    how many anomalous ones they stand; stored. A window of L events has fewer than L runs of a width, so at most
    ``L / share`` runs of a width are frequent. The widths follow each other; filler is no event.
    """
    rows = materialize(
        windows.select(real_ids().alias("ids"), "anomaly").groupBy("ids", "anomaly").agg(F.count(F.lit(1)).alias("w"))
    )
    least = share * (rows.agg(F.sum("w")).first()[0] or 0)
    found: list[DataFrame] = []
    for width in widths:
        runs = rows.select("anomaly", "w", F.explode(_runs(width)).alias("r")).select("anomaly", "w", "r.*")
        if found:
            shorter = found[-1].select("pattern")
            for end in ("head", "tail"):
                runs = runs.join(broadcast_if_small(shorter.withColumnRenamed("pattern", end)), end, "left_semi")
        counted = runs.groupBy("pattern").agg(F.sum("w").alias("support"), F.sum(F.col("w") * F.col("anomaly")).alias("anomalous"))
        found.append(materialize(counted.where(F.col("support") >= least).select("pattern", F.lit(width).alias("width"), "support", "anomalous")))
    made = materialize(reduce(DataFrame.union, found))
    discard(rows, *found)
    return made


def telling_patterns(windows: DataFrame, k: int, share: float = 0.001, widths: tuple[int, ...] = PATTERN_WIDTHS) -> DataFrame:
    """``pattern, pattern_id, width, support, anomalous, chi2``: the k frequent patterns with the largest chi-square statistic
    against the windows' label, numbered from 0; stored. Ties: larger support, then the text."""
    frequent = frequent_patterns(windows, share, widths)
    total, bad = windows.agg(F.count(F.lit(1)), F.sum("anomaly")).first()
    n, positive = float(total), float(bad or 0)
    a, s = F.col("anomalous").cast("double"), F.col("support").cast("double")
    b, c = s - a, F.lit(positive) - a
    d = F.lit(n - positive) - b
    cross, base = a * d - b * c, s * (F.lit(n) - s) * F.lit(positive) * F.lit(n - positive)
    chi2 = F.when(base > 0, F.lit(n) * cross * cross / base).otherwise(0.0)
    best = frequent.withColumn("chi2", chi2).orderBy(F.desc("chi2"), F.desc("support"), "pattern").limit(k)
    # As long as the model, which has k rows.
    place = Window.orderBy(F.desc("chi2"), F.desc("support"), "pattern")
    return materialize(best.select("pattern", (F.row_number().over(place) - 1).alias("pattern_id"), "width", "support", "anomalous", "chi2"))


def telling_features(windows: DataFrame, patterns: DataFrame, k: int, output: str = "features") -> DataFrame:
    """Which of the k patterns occur in a window, as a sparse binary vector of k places whatever the log."""
    own = windows.select("session_id", "window_idx", "anomaly", real_ids().alias("ids"))
    return pattern_features(own, patterns.select("pattern", "pattern_id"), k, output).drop("ids")
