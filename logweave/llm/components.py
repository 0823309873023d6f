"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Batches, discard, map_batches, rows_of, store

_EDGES = pa.schema([("low", pa.int64()), ("high", pa.int64())])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some links and the smallest id that each reaches through them."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while True:
        pu, pv = parent[u], parent[v]
        if (pu == pv).all():
            return ids, ids[parent]
        low = np.minimum(pu, pv)
        np.minimum.at(parent, pu, low)
        np.minimum.at(parent, pv, low)
        while (parent != parent[parent]).any():
            parent = parent[parent]


def _contracted(links: DataFrame) -> DataFrame:
    """``low, high``: the links of each task as stars around the smallest ids; never more rows than before."""

    def run(batches: Batches) -> Batches:
        parts = [np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())) for b in batches if b.num_rows]
        if parts:
            ids, root = roots(*np.concatenate(parts, axis=1))
            yield rows_of(_EDGES, low=root[root != ids], high=ids[root != ids])

    return map_batches(links, run, "low long, high long")


def _is_done(edges: DataFrame) -> bool:
    """Whether all links are stars: no id hangs on two others, or on one while others hang on it."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("high").alias("id"), F.col("low").alias("on"), F.lit(False).alias("holds")),
        F.struct(F.col("low").alias("id"), F.lit(None).cast("long").alias("on"), F.lit(True).alias("holds")),
    )).alias("e")).groupBy("e.id").agg(F.min("e.on").alias("on"), F.max("e.on").alias("other"), F.max("e.holds").alias("holds"))
    open_ids = ends.agg(F.count_if((F.col("on") < F.col("other")) | (F.col("on").isNotNull() & F.col("holds")))).first()[0]
    return open_ids == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: the smallest id reachable from every id that has a link.

    Every task first contracts its own links. Then two steps alternate until only stars are left. In the first,
    the larger neighbours of each node are linked to the smallest node next to it; in the second, the same is
    done with the smaller neighbours. Links shrink to stars around the smallest id of each component in a few
    rounds, however long the chains are. Nodes with very many links only enter grouped minima (combined
    before the shuffle) and joins of stored tables, whose skewed partitions adaptive execution splits. Every
    round is a stored table. Null ids and links of a node with itself have no effect; no links give an empty table.
    """
    start = links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("low"), F.col(b).cast("long").alias("high"))
    edges = store(_contracted(start))
    while not _is_done(edges):
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select("high", "low"))
        least = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = store(
            edges.join(least, edges.low == least.u).select(F.col("high").alias("v"), "m").where(F.col("v") != F.col("m"))
        )
        down = store(large.groupBy("v").agg(F.min("m").alias("least")))
        after = store(_contracted(
            large.join(down, "v").select(F.explode(F.array(F.col("v"), F.col("m"))).alias("high"), F.col("least").alias("low"))
            .where(F.col("high") != F.col("low")).select("low", "high")
        ))
        discard(edges, least, large, down)
        edges = after
    return edges.select(F.col("high").alias("id"), F.col("low").alias("component")).union(edges.select("low", "low")).distinct()
