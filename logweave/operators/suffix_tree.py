"""Prediction suffix tree: how far back to look before the next event depends on what was seen.

A node is a context, the last events before the next one. It stays where its next events differ enough from those of its parent,
the context without the oldest event; the nodes on the way to it stay too. Differences are measured by what they explain: the
occurrences times the divergence of the two distributions. All of a log's differences add up to no more than its whole
uncertainty (occurrences times entropy of the next event), so a node that must explain a ``share`` of that is one of at most
``1 / share``, however long the log is. Probabilities are interpolated: a context's own counts, and its parent's distribution
with the weight of the context's number of different next events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.contexts import next_event_counts, suffixes
from logweave.runtime import broadcast_if_small, discard, materialize


def _parent(context: str) -> Column:
    """The context without its oldest event."""
    return F.when(F.instr(context, " ") > 0, F.expr(f"substring({context}, instr({context}, ' ') + 1)")).otherwise(F.lit(""))


def _level(context: str) -> Column:
    return F.when(F.col(context) == "", 0).otherwise(F.size(F.split(context, " ")))


def tree_nodes(counts: DataFrame, share: float) -> DataFrame:
    """``context, parent, level, n, kinds, gain``: the nodes that stay, from stored counts (``context, next_id, n``).

    ``gain`` is what the node explains beyond its parent; the root (empty context) has none and always stays.
    """
    every = materialize(counts.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))
    known = counts.join(every.select("context", "total"), "context")
    above = known.select(F.col("context").alias("parent"), "next_id", F.col("n").alias("n_above"), F.col("total").alias("total_above"))
    own = known.where("context != ''").withColumn("parent", _parent("context"))
    part = F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("n_above") / F.col("total_above")))
    gains = materialize(own.join(above, ["parent", "next_id"]).groupBy("context").agg(F.sum(part).alias("gain")))
    uncertainty = known.where("context = ''").agg(F.sum(F.col("n") * F.log(F.col("total") / F.col("n")))).first()[0] or 0.0
    telling = gains.where(F.col("gain") >= share * uncertainty).where("gain > 0")
    kept = telling.select(F.explode(suffixes("context")).alias("context")).distinct()
    root = every.where("context = ''").select("context")
    nodes = every.join(broadcast_if_small(materialize(kept.union(root))), "context").join(gains, "context", "left")
    made = materialize(nodes.select(
        "context", F.when(F.col("context") != "", _parent("context")).alias("parent"), _level("context").alias("level"),
        F.col("total").alias("n"), "kinds", "gain",
    ))
    discard(every, gains)
    return made


def _wanted(nodes: DataFrame, k: int, depth: int) -> DataFrame:
    """``nodes`` with ``wanted``: how many of its best next events a node has to know, so that all its descendants find
    their ``k`` best: those of a child, and as many more as the child has next events of its own."""
    levels = [nodes.where(F.col("level") == m) for m in range(depth + 1)]
    made = [materialize(levels[depth].withColumn("wanted", F.lit(k).cast("long")))]
    for m in range(depth - 1, -1, -1):
        need = made[-1].groupBy(F.col("parent").alias("context")).agg(F.max(F.col("wanted") + F.col("kinds")).alias("need"))
        made.append(materialize(levels[m].join(need, "context", "left").withColumn("wanted", F.greatest(F.lit(k), F.coalesce("need", F.lit(k)))).drop("need")))
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    whole = materialize(every)
    discard(*made)
    return whole


def _probability(n: Column) -> Column:
    """Of a next event seen ``n`` times here, and with probability ``p`` by the parent."""
    return (n + F.col("kinds") * F.col("p")) / (F.col("n") + F.col("kinds"))


def fit_suffix_tree(windows: DataFrame, size: int, k: int, share: float = 1e-4) -> DataFrame:
    """``context, topk``: the k likeliest next events of every node, likeliest first, smaller id first on ties; stored.

    ``windows`` (``ids, length, next_id``) may be of any kind; contexts are up to their last ``size`` events. The model is scored
    by ``detect.score_next_event`` with the order ``size``: the longest context that is a node decides. No windows give an
    empty model.
    """
    counts = materialize(next_event_counts(windows, size))
    nodes = tree_nodes(counts, share)
    depth = nodes.agg(F.max("level")).first()[0] or 0
    wanted = _wanted(nodes, k, depth)
    held = materialize(counts.withColumnRenamed("n", "seen").join(broadcast_if_small(wanted), "context"))
    lists, probabilities = [], None
    for m in range(depth + 1):
        own = held.where(F.col("level") == m)
        if m == 0:
            known = own.select("context", "next_id", "wanted", (F.col("seen") / F.col("n")).alias("p"))
            candidates = known
        else:
            above = probabilities.select(F.col("context").alias("parent"), "next_id", "p")
            known = own.join(above, ["parent", "next_id"]).select("context", "next_id", "wanted", _probability(F.col("seen")).alias("p"))
            # The parent's best events that were not seen here; as many of them as can count.
            best = lists[-1].select(F.col("context").alias("parent"), "next_id", "rank", "p")
            children = wanted.where(F.col("level") == m).join(best, "parent").where(F.col("rank") <= F.col("wanted") + F.col("kinds"))
            unseen = children.join(own.select("context", "next_id"), ["context", "next_id"], "left_anti")
            candidates = known.union(unseen.select("context", "next_id", "wanted", _probability(F.lit(0)).alias("p")))
        probabilities = materialize(known)
        order = Window.partitionBy("context").orderBy(F.desc("p"), "next_id")
        ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("wanted"))
        lists.append(materialize(ranked.select("context", "next_id", "p", "rank")))
    every = lists[0]
    for more in lists[1:]:
        every = every.union(more)
    return materialize(every.where(F.col("rank") <= k).groupBy("context").agg(
        F.sort_array(F.collect_list(F.struct("rank", "next_id")))["next_id"].alias("topk")
    ))
