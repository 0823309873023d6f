"""Repeatable train/test splits, anomaly down-sampling and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.columns import hash_order, hash_prefix, hash_unit
from logweave.operators.ordering import PART_ROWS, split_ranges
from logweave.operators.sessions import whole_log_session
from logweave.runtime import broadcast_if_small, materialize


def _ratios(test_ratio: float, train_ratio: float | None) -> tuple[float, float]:
    train = 1 - test_ratio if train_ratio is None else train_ratio
    if train + test_ratio > 1 + 1e-9:
        raise ValueError("train_ratio + test_ratio must not exceed 1")
    return train, test_ratio


def _ranked_split(
    units: DataFrame, key: str, first: str, test_ratio: float, train_ratio: float | None,
    random: bool, seed: int, part_rows: int,
) -> DataFrame:
    """Add ``split`` to the leading and trailing share of the units, and drop those in between.

    The shares are counts truncated after double arithmetic: ``int(ratio * n)``.
    """
    train, test = _ratios(test_ratio, train_ratio)
    if random:
        shuffled = units.withColumn("_h", hash_order(seed, F.col(key)))
        ranges = split_ranges(shuffled, [], ["_h", key], hash_prefix(F.col("_h")), part_rows)
    else:
        ranges = split_ranges(units, [], [first, key], part_rows=part_rows)
    n = ranges.total
    ranked = ranges.add({"_r": ("row_number", None)}).rows()
    split = F.when(F.col("_r") <= int(train * n), "train").when(F.col("_r") > n - int(test * n), "test")
    return ranked.withColumn("split", split).where("split is not null").select(*units.columns, "split")


def split_sessions(
    sessions: DataFrame, test_ratio: float, train_ratio: float | None = None,
    random: bool = True, seed: int = 42, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Split one-row-per-session ``session_id, first_line, ..``; in first-seen order unless ``random``."""
    # One short row per session; stored, because ranking reads it more than once.
    return _ranked_split(materialize(sessions), "session_id", "first_line", test_ratio, train_ratio, random, seed, part_rows)


def keep_training_unit(label: Column, key: Column, ratio: float, seed: int) -> Column:
    return (label == 0) | (hash_unit(seed, key) < F.lit(float(ratio)))


def sample_train_anomalies(split: DataFrame, ratio: float, key: str = "session_id", seed: int = 7) -> DataFrame:
    """Keep each anomalous training unit with probability ``ratio``; the test part is untouched."""
    return split.where((F.col("split") == "test") | keep_training_unit(F.col("label"), F.col(key), ratio, seed))


def filter_unseen_normal(test: DataFrame, train: DataFrame) -> DataFrame:
    """Drop normal test lines whose template does not occur in the training lines."""
    seen = materialize(train.select("template").distinct().withColumn("_seen", F.lit(1)))
    joined = test.join(broadcast_if_small(seen), "template", "left")
    return joined.where("label = 1 or _seen = 1").drop("_seen")


def split_lines(
    lines: DataFrame, test_ratio: float = 0.8, train_ratio: float | None = None,
    train_anomaly_ratio: float = 0.0, random: bool = False, filter_normal: bool = True,
    seed: int = 42, sample_seed: int = 7, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Split single lines, and return each part as one whole-log session."""
    parts = _ranked_split(lines, "line_id", "line_id", test_ratio, train_ratio, random, seed, part_rows)
    kept = materialize(sample_train_anomalies(parts, train_anomaly_ratio, "line_id", sample_seed))
    train, test = kept.where("split = 'train'"), kept.where("split = 'test'")
    if filter_normal:
        test = filter_unseen_normal(test, train)
    order = list(lines.columns)
    sides = [whole_log_session(part, part_rows).select("split", "session_id", "pos", *order) for part in (train, test)]
    return sides[0].unionByName(sides[1])


def split_report(split: DataFrame) -> DataFrame:
    """Units and the percentage of anomalous ones of both parts; an empty part has 0 units and a null percentage."""
    counted = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col("label").cast("double"))).alias("anomaly_pct")
    )
    parts = split.sparkSession.range(2).select(F.when(F.col("id") == 0, "train").otherwise("test").alias("split"))
    return parts.join(counted, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"), "anomaly_pct")
