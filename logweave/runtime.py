"""Small session helpers shared by the operators."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after it has been measured and found to lie within both bounds.
# The size is that of the rows as JSON text, which is close to their size in memory.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
# Times that a stored table may grow in memory; between its size and that bound its rows are measured.
EXPANSION = 16


def fallback_dir(master: str, warehouse: str) -> str:
    """A folder below the warehouse. On a cluster, a warehouse on the machine's own disk is refused: executors would each write
    to their own, and later reads would miss those files."""
    scheme = warehouse.split(":", 1)[0] if ":" in warehouse else "file"
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: the warehouse {warehouse} is local to each machine")
    return posixpath.join(warehouse, "_checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; else one below the warehouse, where that is shared too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(shared or fallback_dir(sc.master, spark.conf.get("spark.sql.warehouse.dir")))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return posixpath.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex[:12]}")


# Shuffle files go at the end of the execution that wrote them, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and continue from the stored copy.

    The plan runs once, later steps read only the columns they need, and Spark knows the size
    of the stored table, so it broadcasts it by itself where that fits its threshold.
    """
    path = scratch_path(df.sparkSession, "table")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later step reads."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _stored_bytes(df: DataFrame) -> int | None:
    """Size of the files of a table made by ``materialize``; None for any other."""
    path = getattr(df, "stored_path", None)
    if path is None:
        return None
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    return files.getContentSummary(path).getLength()


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a table against the broadcast bounds: a stored one by its files and row count, else row by row."""
    stored = _stored_bytes(df)
    if stored is not None and (stored > size or stored * EXPANSION <= size):
        return stored <= size and df.count() <= rows
    text = F.octet_length(F.to_json(F.struct(*df.columns))).cast("long")
    found, taken = df.agg(F.count(F.lit(1)), F.sum(text)).first()
    return found <= rows and (taken or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when measuring the table proves it small.

    Otherwise the table is returned as it is: Spark then runs a sort-merge join
    and adaptive execution splits the skewed partitions of the big side.
    Pass stored tables (read from files or materialized) so that measuring stays cheap.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df


def split_by_use(
    table: DataFrame, n: str = "n", rows: int | None = None, size: int | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of a stored table that are used most often (``n`` times each), as many as may be broadcast, hinted so, and the
    others; None stands for no rows. Rows without ``n`` belong to the others."""
    rows, size = rows or BROADCAST_ROWS, size or BROADCAST_BYTES
    if is_small(table, rows, size):
        return F.broadcast(table), None
    # Eight levels for every doubling of the use: the driver sees one short row per level.
    level = F.floor(F.log2(F.col(n).cast("double")) * 8)
    text = F.octet_length(F.to_json(F.struct(*table.columns))).cast("long")
    levels = table.where(F.col(n) > 0).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows"), F.sum(text).alias("size")).collect()
    cut = None
    for found in sorted(levels, key=lambda r: -r["level"]):
        rows, size = rows - found["rows"], size - found["size"]
        if rows < 0 or size < 0:
            break
        cut = found["level"]
    if cut is None:
        return None, table
    often = F.coalesce((F.col(n) > 0) & (level >= cut), F.lit(False))
    return F.broadcast(table.where(often)), table.where(~often)


def looked_up(
    rows: DataFrame, entries: DataFrame, on: str, by: list[str] | None = None, how: str = "left", n: str = "n"
) -> DataFrame:
    """``rows`` joined (``left`` or ``inner``) with the stored ``entries``, a dictionary with ``n``, how often each entry is used;
    ``n`` is not in the result.

    Of a dictionary too long to be broadcast the often used entries still are, so only rows that meet none of those are moved. ``by``
    are columns that ``rows`` are dealt by; the result then is as well.
    """
    few, rest = split_by_use(entries, n)
    if few is None or rest is None:
        found = rows.join((rest if few is None else few).drop(n), on, how)
        return found if few is not None or by is None else found.repartition(*by)
    # An entry that is there twice, used often and rarely, is looked up in one place.
    often = F.broadcast(few.unionByName(rest.join(few.select(on), on, "left_semi")))
    near = rows.join(often.drop(n).withColumn("_near", F.lit(True)), on, "left").where(
        F.col("_near") | F.col(on).isNull() if how == "left" else F.col("_near")).drop("_near")
    far = rows.where(F.col(on).isNotNull()).join(few.select(on), on, "left_anti").join(rest.drop(n), on, how)
    return near.unionByName(far if by is None else far.repartition(*by))
