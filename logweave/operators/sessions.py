"""Cutting logs into sessions.

Every function returns long form: one row per line with ``session_id`` and, where
line positions are asked for, ``pos`` (0-based, in line order).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.columns import ENTITY_PATTERN, entity_ids
from logweave.operators.ordering import PART_ROWS, running, split_ranges
from logweave.runtime import broadcast_if_small, materialize

# Session ranges in seconds of the supported log families.
RANGE_SECONDS = {"bgl": 21600, "thunderbird": 3600, "hdfs": 60}

# Distinct seconds of one uninterrupted stretch that a single task may walk through.
FOLD_SECONDS = 2_000_000
# Distinct seconds of short stretches that go through one call.
CALL_SECONDS = 200_000


def with_positions(
    lines: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "line_id", part_rows: int = PART_ROWS
) -> DataFrame:
    """Add ``pos``: 0-based position of the line in its session."""
    numbered = running(lines, list(keys), [order], {"_rn": ("row_number", None)}, part_rows=part_rows)
    return numbered.withColumn("pos", F.col("_rn") - 1).drop("_rn")


def entity_lines(lines: DataFrame, pattern: str = ENTITY_PATTERN) -> DataFrame:
    """One row per line and distinct entity named in it; the entity is the session."""
    return lines.withColumn("session_id", F.explode(entity_ids(F.col("content"), pattern)))


def entity_sessions(lines: DataFrame, pattern: str = ENTITY_PATTERN, part_rows: int = PART_ROWS) -> DataFrame:
    """A line joins the session of every entity it names."""
    return with_positions(entity_lines(lines, pattern), part_rows=part_rows)


def whole_log_session(lines: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The complete log as one session named ``all``."""
    return with_positions(lines, keys=(), part_rows=part_rows).withColumn("session_id", F.lit("all"))


def session_rollup(lines: DataFrame) -> DataFrame:
    """Length, any-anomaly label and first line per session."""
    return lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("length"),
        (F.max("label") > 0).cast("int").alias("label"),
        F.min("line_id").alias("first_line"),
    )


# One column for all keys: a struct is never null itself, so rows with null keys are a group like any other.
KEY = "_key"


def _keyed(lines: DataFrame, partition_cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if not partition_cols:
        return lines, []
    return lines.withColumn(KEY, F.struct(*partition_cols)), [KEY]


# ---- gap + fixed chunk sessions -------------------------------------------------------------


def gap_chunk_sessions(
    lines: DataFrame,
    interval: int,
    ts: str = "ts",
    output: str = "session_id",
    partition_cols: Sequence[str] = (),
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Start a group when the gap to the previous line exceeds ``interval`` seconds,
    and cut each group into chunks of ``interval`` seconds. Ids count from 1.

    The id depends on the second alone, so it is worked out on the distinct
    seconds and joined back to the lines. A line without a time gets no session (null);
    lines whose keys are null form a group of their own.
    """
    if interval <= 0:
        raise ValueError("interval must be positive")
    keyed, keys = _keyed(lines, partition_cols)
    timed = keyed.withColumn("_sec", F.floor(F.unix_micros(ts) / 1_000_000))
    seconds = timed.where("_sec is not null").select(*keys, "_sec").distinct()
    gaps = split_ranges(materialize(seconds), keys, ["_sec"], part_rows=part_rows).add({"_prev": ("prior_max", "_sec")})
    opened = gaps.with_column(
        "_open", F.when(F.col("_prev").isNull() | (F.col("_sec") - F.col("_prev") > interval), F.col("_sec"))
    )
    grouped = opened.add({"_start": ("max", "_open")}).rows()
    chunks = materialize(grouped.select(
        *keys, "_sec", "_start", F.floor((F.col("_sec") - F.col("_start")) / interval).alias("_chunk")
    ))
    # Chunks of one key are ordered by their first second, and never overlap.
    firsts = chunks.groupBy(*keys, "_start", "_chunk").agg(F.min("_sec").alias("_first"))
    ids = running(firsts, keys, ["_first"], {output: ("row_number", None)}, part_rows=part_rows)
    by_second = chunks.join(ids.drop("_first"), [*keys, "_start", "_chunk"]).select(*keys, "_sec", output)
    return timed.join(broadcast_if_small(materialize(by_second)), [*keys, "_sec"], "left").drop("_sec", KEY)


# ---- anchored time sessions -----------------------------------------------------------------


def _jumps(values: np.ndarray, range_seconds: int) -> np.ndarray:
    """For every one of the ascending ``values``, the place of the first one more than the range after it."""
    return np.searchsorted(values, values + range_seconds, side="right")


def _starts(jumps: np.ndarray, at: int, stop: int) -> list[int]:
    """The places of the sessions that start before ``stop``, from the one at ``at`` on, and where the next one starts."""
    steps, starts = jumps.tolist(), [at]
    while starts[-1] < stop:
        starts.append(steps[starts[-1]])
    return starts


def _walk(range_seconds: int):
    """Anchors of many stretches (``_no``): jump to the first second more than the range after the last anchor."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_no", "m"])
        number, values = group["_no"].to_numpy(), group["m"].to_numpy()
        # Laid one after the other with more than the range between them, all stretches are one.
        steps = np.diff(values, prepend=values[:1])
        steps[1:][number[1:] != number[:-1]] = range_seconds + 1
        starts = _starts(_jumps(np.cumsum(steps), range_seconds), 0, len(values))
        return pd.DataFrame({"_no": number, "m": values, "anchor": np.repeat(values[starts[:-1]], np.diff(starts))})

    return walk


def _block_jumps(range_seconds: int, width: int):
    """From every second of a block (``_no, _block``) that may be its first session start, the first start of the next block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("m")
        values, block = group["m"].to_numpy(), int(group["_block"].iloc[0])
        inside = int(np.searchsorted(values, (block + 1) * width))
        to = _jumps(values, range_seconds)
        # Follow all seconds at once until they leave the block.
        while (going := to[:inside] < inside).any():
            to[:inside] = np.where(going, to[np.minimum(to[:inside], len(values) - 1)], to[:inside])
        first = int(np.searchsorted(values, block * width + _ahead(range_seconds)))
        left = to[: min(first, inside)]
        known = left < len(values)
        return pd.DataFrame({
            "_no": group["_no"].iloc[0], "m": values[: len(left)][known], "nxt": values[left[known]],
        })

    return run


def _block_anchors(range_seconds: int, width: int):
    """Anchors of the seconds from a block's first session start (``_entry``) up to that of the next block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("m")
        values, block, entry = group["m"].to_numpy(), int(group["_block"].iloc[0]), int(group["_entry"].iloc[0])
        inside = int(np.searchsorted(values, (block + 1) * width))
        starts = _starts(_jumps(values, range_seconds), int(np.searchsorted(values, entry)), inside)
        return pd.DataFrame({
            "_no": group["_no"].iloc[0], "m": values[starts[0] : starts[-1]], "anchor": np.repeat(values[starts[:-1]], np.diff(starts)),
        })

    return run


def _ahead(range_seconds: int) -> int:
    """Within so many seconds after a block's end the next block's first session starts: at most the range after the last
    anchor's reach, since gaps inside a stretch never exceed the range."""
    return 2 * range_seconds + 1


def _double(stretches: DataFrame, range_seconds: int, fold_seconds: int) -> DataFrame:
    """Anchors (``_no, m, anchor``) of very long stretches (``_no, m``, counted from their first second, 0), in time blocks of
    their own task each.

    A block's sessions depend on its first session start alone, which lies in its first seconds. For each of those the
    block tells the first start of the next block; these few jumps are doubled: after round j the starts of the
    first 2**j blocks are known, so the rounds number about log2 of the blocks and read a small part of the seconds.
    """
    ahead = _ahead(range_seconds)
    width = max(fold_seconds // 8, 8 * ahead)
    own = F.floor(F.col("m") / width)
    # The first seconds of a block go to the one before too.
    blocks = materialize(stretches.select("_no", "m", F.explode(F.when(
        (own > 0) & (F.col("m") - own * width < ahead), F.array(own, own - 1)).otherwise(F.array(own))).alias("_block")))
    jump = materialize(blocks.groupBy("_no", "_block").applyInPandas(_block_jumps(range_seconds, width), "_no long, m long, nxt long"))
    reached = materialize(stretches.select("_no", F.lit(0).cast("long").alias("m")).distinct())
    known = reached.count()
    while True:
        step = reached.join(jump, ["_no", "m"]).select("_no", F.col("nxt").alias("m"))
        reached = materialize(reached.unionByName(step).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        far = jump.select("_no", F.col("m").alias("nxt"), F.col("nxt").alias("_far"))
        jump = materialize(jump.join(far, ["_no", "nxt"]).select("_no", "m", F.col("_far").alias("nxt")))
    entries = reached.select("_no", own.alias("_block"), F.col("m").alias("_entry"))
    walked = blocks.join(broadcast_if_small(materialize(entries)), ["_no", "_block"])
    return walked.groupBy("_no", "_block").applyInPandas(_block_anchors(range_seconds, width), "_no long, m long, anchor long")


def anchored_sessions(
    lines: DataFrame,
    range_seconds: int,
    sec: str = "sec",
    order: str = "line_id",
    partition_cols: Sequence[str] = (),
    part_rows: int = PART_ROWS,
    fold_seconds: int = FOLD_SECONDS,
) -> DataFrame:
    """The first line opens a session at its second; a line more than ``range_seconds``
    after the opening second opens the next one. ``session_id`` is the opening second.

    Opening seconds only rise, so a line's session depends on the running maximum
    of the seconds. Sessions are therefore worked out on the distinct running
    maxima: a step of more than the range always opens a session, which cuts them into
    independent stretches. Stretches are walked many at a time; longer ones
    than ``fold_seconds`` are cut into time blocks, each walked by a task of its own.

    A line without a second belongs to the session that is open; before the first second there is
    none (null). Lines whose keys are null form a group of their own.
    """
    keyed, keys = _keyed(lines, partition_cols)
    topped = materialize(running(keyed, keys, [order], {"m": ("max", sec)}, part_rows=part_rows))
    maxima = materialize(topped.where("m is not null").select(*keys, "m").distinct())
    steps = split_ranges(maxima, keys, ["m"], part_rows=part_rows).add({"_prev": ("prior_max", "m")})
    opened = steps.with_column(
        "_open", F.when(F.col("_prev").isNull() | (F.col("m") - F.col("_prev") > range_seconds), F.col("m"))
    )
    stretches = materialize(opened.add({"_stretch": ("max", "_open")}).rows().select(*keys, "m", "_stretch"))
    stretch = [*keys, "_stretch"]
    # A stretch no longer than the range is a single session; only the others are walked.
    sizes = materialize(stretches.groupBy(*stretch).agg(
        F.count(F.lit(1)).alias("_size"), (F.max("m") - F.col("_stretch")).alias("_length")
    ).withColumn("_no", F.monotonically_increasing_id()))
    single = stretches.join(sizes.where(F.col("_length") <= range_seconds).select(*stretch), stretch, "left_semi")
    wide = sizes.where(F.col("_length") > range_seconds)
    numbered = stretches.join(wide.select(*stretch, "_no", "_size"), stretch).select(
        "_no", "_size", (F.col("m") - F.col("_stretch")).alias("m"))
    # Many short stretches share a call.
    short, longest = wide.agg(
        F.sum(F.when(F.col("_size") <= fold_seconds, F.col("_size"))), F.coalesce(F.max("_size"), F.lit(0))
    ).first()
    calls = F.pmod(F.xxhash64("_no"), F.lit(max(1, -(-(short or 0) // CALL_SECONDS)))).alias("_call")
    anchors = numbered.where(F.col("_size") <= fold_seconds).select("_no", "m", calls).groupBy("_call").applyInPandas(
        _walk(range_seconds), "_no long, m long, anchor long")
    if longest > fold_seconds:
        far = materialize(numbered.where(F.col("_size") > fold_seconds).select("_no", "m"))
        anchors = anchors.unionByName(_double(far, range_seconds, fold_seconds))
    begun = broadcast_if_small(wide.select(*keys, "_no", "_stretch"))
    moved = [(F.col(c) + F.col("_stretch")).alias(c) for c in ("m", "anchor")]
    anchors = single.select(*keys, "m", F.col("_stretch").alias("anchor")).unionByName(
        anchors.join(begun, "_no").select(*keys, *moved))
    by_maximum = materialize(anchors.select(*keys, "m", F.col("anchor").alias("session_id")))
    return topped.join(broadcast_if_small(by_maximum), [*keys, "m"], "left").drop("m", KEY)
