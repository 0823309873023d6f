"""Sliding windows over session lines.

Windows are cut from *chunks* of a session: each line goes to the chunks whose windows
can contain it (nearly always one), and a chunk holds a bounded number of lines.
A short session is one chunk; a session with most of the log is many, handled by
many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.ordering import PART_ROWS, running
from logweave.operators.vocab import OOV_ID, WINDOW_PADDING
from logweave.runtime import broadcast_if_small, materialize

# Starts per chunk before rounding to whole strides.
CHUNK_LINES = 4096


def _chunk_span(size: int, stride: int, chunk: int | None) -> int:
    lines = max(CHUNK_LINES, 8 * size) if chunk is None else chunk
    return max(1, -(-lines // stride)) * stride


def _round_up(value: Column, stride: int) -> Column:
    return F.floor((F.greatest(value, F.lit(0)) + (stride - 1)) / stride) * stride


def sliding_windows(
    lines: DataFrame,
    size: int,
    stride: int = 1,
    tail: bool = True,
    pad_id: int = OOV_ID,
    scalar_label: bool = False,
    compat: bool = False,
    text: bool = False,
    carry: Mapping[str, Column] | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """Windows of ``size`` lines every ``stride`` lines, each with the next event.

    ``lines`` needs ``session_id, pos, template_id, label`` (and ``template`` for ``text``). A window at ``i`` is full
    while ``i + size < n``; afterwards one tail window holds the remaining lines but the last,
    filled up on the right, and the last line is its next event. ``tail=False`` leaves it out.

    Output: ``session_id, window_idx, length`` (lines before filling), ``ids`` (``pad_id`` as
    filler), ``next_id, anomaly`` (any label in the window or on its next event) and
    ``an_classes`` (template id of anomalous lines, else 0); with ``text`` also ``window``, the
    templates themselves.

    ``scalar_label``: the label belongs to the session and is repeated on its lines.
    ``compat``: class vectors of tail windows read from the start of the session and are filled with 1.
    ``carry``: more line columns to window, mapped to their filler.
    """
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    span = _chunk_span(size, stride, chunk)
    carry = dict(carry or {})
    pos = F.col("pos")
    # The chunks whose windows reach this line, or whose tail window takes it as the last line.
    lowest = F.floor(_round_up(pos - size, stride) / span)
    highest = F.floor(F.greatest(pos, _round_up(pos + 1 - size, stride)) / span)
    row = F.struct(
        pos.cast("long").alias("pos"), F.col("template_id").cast("int").alias("id"),
        F.when(F.col("label") > 0, F.col("template_id")).otherwise(0).cast("int").alias("cls"),
        *(["template"] if text else []), *carry,
    )
    chunks = (
        lines.select("session_id", F.explode(F.sequence(lowest, highest)).alias("_chunk"), row.alias("_row"))
        .groupBy("session_id", "_chunk")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    base = F.element_at("_rows", 1)["pos"]
    chunks = chunks.select("*", base.alias("_base"), (base + F.size("_rows") - 1).alias("_last"))
    begin, last = F.col("_chunk") * span, F.col("_last")
    stop = _round_up(last + 1 - size, stride)  # the tail window, if the session ends in this chunk
    if not tail:
        stop = F.when(last >= size, F.floor((last - size) / stride) * stride).otherwise(-1)
    end = F.least(begin + (span - stride), stop)
    starts = F.when(begin <= end, F.sequence(begin.cast("long"), end.cast("long"), F.lit(stride).cast("long")))
    # All windows of a chunk are cut before they become rows, so no row ever carries its chunk.
    lined = F.transform(starts, lambda s: F.struct(
        s.alias("start"), (s + size <= last).alias("full"),
        F.slice("_rows", (s - F.col("_base") + 1).cast("int"), F.lit(size + 1)).alias("span"),
    ))
    first_class = F.element_at("_rows", 1)["cls"]
    final = F.element_at("_rows", -1)["id"]

    def window(w: Column) -> Column:
        length = F.when(w["full"], size).otherwise(F.greatest(last - w["start"], F.lit(0))).cast("int")
        inside = F.slice(w["span"], F.lit(1), length)
        def filled(field: str, pad: Column) -> Column:
            return F.concat(inside[field], F.array_repeat(pad, F.lit(size) - length)).alias(field)
        flag = first_class if scalar_label else F.coalesce(F.array_max(w["span"]["cls"]), F.lit(0))
        return F.struct(
            (w["start"] / stride).cast("long").alias("window_idx"), length.alias("length"),
            *([filled("template", F.lit(WINDOW_PADDING)).alias("window")] if text else []),
            filled("id", F.lit(pad_id)).alias("ids"),
            # Next event: the line after a full window, else the last line of the session.
            F.when(w["full"], F.get(w["span"], F.lit(size))["id"]).otherwise(final).alias("next_id"),
            (flag > 0).cast("int").alias("anomaly"),
            filled("cls", F.lit(0)).alias("an_classes"),
            *[filled(name, pad) for name, pad in carry.items()],
            w["full"].alias("_full"), (last + 1 - w["start"]).alias("_rest"),
        )

    result = chunks.select("session_id", F.inline(F.transform(lined, window)))
    if compat:
        result = _compat_tail(result, lines, size)
    return result.drop("_full", "_rest")


def _compat_tail(windows: DataFrame, lines: DataFrame, size: int) -> DataFrame:
    """Replace tail class vectors by those of the session's first lines, filled with 1."""
    head_row = F.struct("pos", F.when(F.col("label") > 0, F.col("template_id")).otherwise(0).cast("int").alias("c"))
    heads = (
        lines.where(F.col("pos") < size).groupBy("session_id")
        .agg(F.sort_array(F.collect_list(head_row))["c"].alias("_head"))
    )
    tails = windows.where("not _full").join(heads, "session_id")
    rest = F.greatest(F.col("_rest"), F.lit(0)).cast("int")
    changed = F.concat(F.slice("_head", F.lit(1), rest), F.array_repeat(F.lit(1), F.lit(size) - rest))
    return windows.where("_full").unionByName(tails.withColumn("an_classes", changed).drop("_head"))


def session_windows(lines: DataFrame) -> DataFrame:
    """Each session as one window with the session's label, in long form whatever its length.

    One row per line: ``session_id, window_idx`` (0), ``pos, template, template_id, an_class`` (template id of an
    anomalous line, else 0), and the window's ``length, window_label, anomaly``. Labels and lengths are joined as
    one row per session, so no task holds a session.
    """
    labels = lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("length"), (F.max("label") > 0).cast("int").alias("anomaly")
    )
    joined = lines.join(labels.withColumnRenamed("session_id", "_session"), F.col("session_id").eqNullSafe(F.col("_session")))
    return joined.select(
        "session_id", F.lit(0).cast("long").alias("window_idx"), F.col("pos").cast("long").alias("pos"), "template", "template_id",
        F.when(F.col("label") > 0, F.col("template_id")).otherwise(0).cast("int").alias("an_class"),
        "length", F.col("anomaly").alias("window_label"), "anomaly",
    )


def frame_windows(
    lines: DataFrame,
    value: str,
    label: str = "label",
    group: str = "group",
    order: str | None = None,
    size: int = 10,
    stride: int = 1,
    compat: bool = False,
    chunk: int | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Frames of ``size`` rows at every ``stride``-th row of a group, without a next event.

    A group shorter than ``size`` gives one frame filled with 0 on the right. Cut-off frames at the
    end of longer groups are filled as well unless ``size`` is a multiple of ``stride``;
    then they are dropped. ``compat`` keeps only the starts among the first ``size`` rows of
    a group when ``stride`` is above 1.
    ``order`` (default: ``value``) is an integer column without ties inside a group.
    """
    order = order or value
    span = _chunk_span(size, stride, chunk)
    numbered = running(
        lines.select(group, F.col(order).alias("_order"), F.col(value).alias("_value"), F.col(label).alias("_label")),
        [group], ["_order"], {"_rn": ("row_number", None)}, part_rows=part_rows,
    )
    pos = F.col("_rn") - 1
    lowest = F.floor(F.greatest(pos - (size - 1), F.lit(0)) / span)
    chunks = (
        numbered.select(
            group, F.explode(F.sequence(lowest, F.floor(pos / span))).alias("_chunk"),
            F.struct(pos.alias("pos"), "_value", "_label").alias("_row"),
        )
        .groupBy(group, "_chunk")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    begin = F.col("_chunk") * span
    last = F.element_at("_rows", -1)["pos"]
    end = F.least(begin + (span - stride), last)
    starts = F.sequence(begin, end, F.lit(stride).cast("long"))
    base = F.element_at("_rows", 1)["pos"]
    frames = chunks.select(group, F.inline(F.transform(starts, lambda s: F.struct(
        s.alias("_start"), F.slice("_rows", (s - base + 1).cast("int"), F.lit(size)).alias("_taken")
    ))))
    got = F.size("_taken")
    keep = (F.col("_start") == 0) | (got == size)
    if stride > 1 and size % stride != 0:
        keep = F.lit(True)
    if compat and stride > 1:
        keep = keep & (F.col("_start") + 1 < size)
        # A short group keeps its first frame whatever the size.
        keep = keep | ((F.col("_start") == 0) & (got < size))
    if stride > 1 and size % stride != 0:
        # Later starts of a group shorter than the frame do not count.
        short = (F.col("_start") > 0) & (F.col("_start") + got < size)
        keep = keep & ~short
    filler = F.lit(size) - got
    def filled(field: str) -> Column:
        return F.concat(F.col("_taken")[field], F.array_repeat(F.lit(0), filler))
    return frames.where(keep).select(
        group, (F.col("_start") / stride).cast("long").alias("frame_idx"),
        filled("_value").alias("window"), filled("_label").alias("labels"),
    )


def session_index(sessions: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Dense 0-based session number in first-seen order."""
    ranked = running(
        materialize(sessions.select("session_id", "first_line")), [], ["first_line", "session_id"],
        {"_rn": ("row_number", None)}, part_rows=part_rows,
    )
    return ranked.select("session_id", (F.col("_rn") - 1).alias("session_idx"))


def samples(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Window rows keyed by session number."""
    return windows.join(broadcast_if_small(materialize(index)), "session_id").drop("session_id")


def window_report(windows: DataFrame) -> DataFrame:
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.avg(F.col("anomaly").cast("double")).alias("anomalous_share"))
