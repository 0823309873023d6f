"""Running values over an order, computed in parallel even when one group is huge.

A plain window puts each group in one task. Here the groups are counted first. A group with
too many rows is cut into ranges at approximate quantiles of the order, and ranges that are
still too long are cut again, so outliers and uneven densities do not matter. Every range is
processed by its own task, and the totals of the earlier ranges (one short row per range) are added
afterwards. The rows are shuffled once, as for a plain window, and without an
oversized group the plan is a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.runtime import broadcast_if_small, materialize

# Rows of one group a single task may sort.
PART_ROWS = 1_000_000
# Cut points of a group in one round, and the size of the sketch they are taken from. A round makes ranges
# about CUTS times shorter; each is one pass that adds up one sketch per group that is still too long.
CUTS = 255
ACCURACY = 4096
# Rounds of cutting: a range number has to fit into 64 bits.
ROUNDS = 7

PART = "_part"
# The number that cuts are made on, where it is an expression: worked out once and stored.
CUT_ON = "_cut_on"


class Ranges:
    """Rows of ordered groups, with the groups that are too long cut into ranges (``_part``).

    Made by ``split_ranges``. ``add`` appends running values, ``select`` and ``with_column`` change
    columns in between, ``rows`` gives the table back. All ``add`` calls share one shuffle.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cut: bool, total: int):
        self._df, self._keys, self._order, self._cut = df, list(keys), list(order), cut
        # Number of rows of the table.
        self.total = total

    def _with(self, df: DataFrame) -> Ranges:
        return Ranges(df, self._keys, self._order, self._cut, self.total)

    def with_column(self, name: str, value: Column) -> Ranges:
        return self._with(self._df.withColumn(name, value))

    def add(self, values: Mapping[str, tuple[str, str | None]]) -> Ranges:
        """Add running values along the order inside each group.

        ``values`` maps an output name to ``(kind, column)`` with kind one of
        ``row_number`` (from 1), ``sum``, ``max`` (both up to and including the row)
        and ``prior_max`` (rows before this one; the previous value of an ascending column).
        """
        group = [*self._keys, PART]
        ordered = Window.partitionBy(*group).orderBy(*self._order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        local, totals = {}, {}
        for name, (kind, column) in values.items():
            if kind == "row_number":
                local[name], totals[name] = F.row_number().over(ordered).cast("long"), (F.count(F.lit(1)), F.sum)
            elif kind == "sum":
                local[name], totals[name] = F.sum(column).over(upto), (F.sum(column), F.sum)
            elif kind in ("max", "prior_max"):
                frame = upto if kind == "max" else before
                local[name], totals[name] = F.max(column).over(frame), (F.max(column), F.max)
            else:
                raise ValueError(f"unknown running value {kind!r}")
        df = self._df
        if self._cut:
            # One row per range of a cut group.
            earlier = Window.partitionBy(*self._keys, F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
            per_range = df.where(F.col(PART) >= 0).groupBy(*group).agg(
                *[total.alias(f"_t_{name}") for name, (total, _) in totals.items()]
            )
            carry = per_range.select(
                *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[merge(f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (_, merge) in totals.items()]
            )
            match = F.lit(True)
            for i, g in enumerate(group):
                match = match & df[g].eqNullSafe(F.col(f"_g{i}"))
            df = df.join(broadcast_if_small(materialize(carry)), match, "left")
            for name, (kind, _) in values.items():
                if kind in ("row_number", "sum"):
                    local[name] = local[name] + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
                else:
                    local[name] = F.greatest(local[name], F.col(f"_c_{name}"))
        columns = [F.col(c) for c in self._df.columns]
        return self._with(df.select(*columns, *[value.alias(name) for name, value in local.items()]))

    def rows(self) -> DataFrame:
        return self._df.drop(PART, CUT_ON)


def _place(cuts: Column, key: Column) -> Column:
    """The number of cut points below a value plus the number up to it, 0 for a null value or no cut points (ascending, distinct).

    Below, at or above a cut point are ranges of their own, so a value that fills many quantiles stands alone. The cut points
    are halved, so a row is compared with a few of them only.
    """
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(CUTS.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < key, at + step).otherwise(at))
    return 2 * below + F.when(F.get(cuts, below) == key, 1).otherwise(0)


def _cut(df: DataFrame, keys: list[str], key: Column, part_rows: int) -> DataFrame | None:
    """One round: groups of ``keys`` and ``PART`` with too many rows get finer ranges; None if there are none.

    A group of a single order value cannot be cut and stays whole.
    """
    group = [*keys, PART]
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    long_ones = materialize(sizes.where((F.col("_n") > part_rows) & (F.col("_lo") < F.col("_hi"))).select(*group))
    if long_ones.isEmpty():
        return None
    names = [f"_h{i}" for i in range(len(group))]

    def of(other: DataFrame, frame: DataFrame) -> Column:
        match = F.lit(True)
        for name, g in zip(names, group):
            match = match & frame[g].eqNullSafe(other[name])
        return match

    wanted = broadcast_if_small(long_ones.toDF(*names))
    shares = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    cuts = materialize(
        df.join(wanted, of(wanted, df), "left_semi").groupBy(*group)
        .agg(F.array_distinct(F.percentile_approx(key, shares, ACCURACY)).alias("_cuts")).toDF(*names, "_cuts")
    )
    found = broadcast_if_small(cuts)
    place = _place(F.col("_cuts"), key)
    # Ranges of groups that are cut in a later round only keep their order: every number moves on.
    moved = F.when((F.col(PART) < 0) & F.col("_cuts").isNull(), F.col(PART)).otherwise(
        F.greatest(F.col(PART), F.lit(0)) * (2 * CUTS + 1) + place
    )
    return df.join(found, of(found, df), "left").withColumn(PART, moved.cast("long")).drop(*names, "_cuts")


def split_ranges(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    split_on: str | Column | None = None,
    part_rows: int = PART_ROWS,
) -> Ranges:
    """Find the groups of ``keys`` with more rows than a task should sort, and cut them.

    ``split_on`` (default: the first order column) is a number that never decreases
    along the order; rows without it come first. Group sizes are counted first; only the total and the largest
    one come to the driver. Without keys the whole table is one group.
    """
    first = order[0] if split_on is None else split_on
    key = F.col(first) if isinstance(first, str) else first
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    total = total or 0
    plain = F.lit(-1).cast("long")
    if (largest or 0) <= part_rows:
        return Ranges(df.withColumn(PART, plain), keys, order, False, total)
    # Read several times from here on; a table that is stored already is not stored again.
    if not isinstance(first, str) or getattr(df, "stored_path", None) is None:
        df = materialize(df if isinstance(first, str) else df.withColumn(CUT_ON, key))
    df = df.withColumn(PART, plain)
    key = F.col(first if isinstance(first, str) else CUT_ON)
    for _ in range(ROUNDS):
        finer = _cut(df, list(keys), key, part_rows)
        if finer is None:
            break
        df = finer
    return Ranges(df, keys, order, True, total)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: Mapping[str, tuple[str, str | None]],
    split_on: str | Column | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``df`` with running values; see ``Ranges.add``."""
    return split_ranges(df, keys, order, split_on, part_rows).add(values).rows()
