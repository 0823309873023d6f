"""Candidate pairs from sorted keys, their exact confirmation, and the classes that the confirmed links form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import shingles
from logweave.llm.common import Batches, discard, map_batches, rows_of, store
from logweave.llm.components import components, roots

# Rows before a row, in sorted order, that it is compared with.
NEIGHBOURS = 3
# Candidates of each id that are confirmed first; all others follow where classes still differ.
FIRST_PAIRS = 3

# Nodes and shingles of a block of a crowded bucket: two blocks are compared in one piece.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 20
# Bytes of the pieces of one task.
PIECE_BYTES = 16 << 20
# Shingles that this many nodes of two blocks share are compared by matrix products, rarer ones pair by pair.
DENSE_FROM, DENSE_COLUMNS = 16, 2048

_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("key", pa.binary()), ("sketch", pa.binary())])


def _fixed(column: pa.Array, rows: int) -> np.ndarray:
    """A binary column of equally long values as a byte matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)


def sorted_neighbours(keys: DataFrame, shared: int, least: float, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``a, b, score``: rows that are near to each other when ``keys`` (``key, id, sketch``) is sorted.

    Each row is paired with the ``neighbours`` rows before it that share the first ``shared`` bytes of its key.
    Close in the order means a long common prefix: in crowded regions only deep prefixes meet, in thin ones
    shallow ones do. ``score`` is the share of equal bits of the sketches; pairs below ``least`` are left out.

    Rows are dealt into ranges of (key, id), so equal keys, however many, spread over many tasks. Each task
    also hands on its first and last rows, with which the pairs across the borders of ranges are found. A pair
    may come more than once.
    """

    def near(batches: Batches) -> Batches:
        held: tuple | None = None
        first = True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, ids, sketch = _fixed(batch.column(0), n), batch.column(1).to_numpy(), _fixed(batch.column(2), n)
            if first:
                edge = slice(0, neighbours)
                yield _border(key[edge], ids[edge], sketch[edge])
                first = False
            if held is not None:
                key, ids, sketch = (np.concatenate(x) for x in zip(held, (key, ids, sketch)))
            old = 0 if held is None else len(held[1])
            for step in range(1, neighbours + 1):
                at = np.arange(max(step, old), len(ids))
                at = at[(key[at, :shared] == key[at - step, :shared]).all(axis=1)]
                equal = 1 - np.bitwise_count(sketch[at] ^ sketch[at - step]).sum(axis=1) / (8 * sketch.shape[1])
                ok = (equal >= least) & (ids[at] != ids[at - step])
                a, b = ids[at][ok], ids[at - step][ok]
                nothing = [None] * len(a)
                yield rows_of(_FOUND, a=np.minimum(a, b), b=np.maximum(a, b), score=equal[ok], key=nothing, sketch=nothing)
            held = key[-neighbours:], ids[-neighbours:], sketch[-neighbours:]
        if held is not None:
            yield _border(*held)

    dealt = keys.select("key", "id", "sketch").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    found = store(map_batches(dealt, near, "a long, b long, score double, key binary, sketch binary"))
    borders = found.where("key is not null").select("key", F.col("a").alias("id")).distinct()
    order = Window.partitionBy(F.substring("key", 1, shared)).orderBy("key", "id")
    across = [
        borders.select(F.col("id").alias("x"), F.lag("id", step).over(order).alias("y")).where("y is not null and x != y")
        for step in range(1, neighbours + 1)
    ]
    pairs = found.where("key is null").select("a", "b", "score")
    for more in across:
        # A score is not known here; they are few and all of them are confirmed.
        pairs = pairs.union(more.select(F.least("x", "y"), F.greatest("x", "y"), F.lit(1.0)))
    return pairs


def _border(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    return rows_of(_FOUND, a=ids, b=ids, score=np.ones(n), key=[k.tobytes() for k in key], sketch=[s.tobytes() for s in sketch])


def _confirmed(pairs: DataFrame, texts: DataFrame, similar: Callable[[list, list], np.ndarray]) -> DataFrame:
    """The pairs whose whole texts are similar. Texts are joined to the stored pairs, whose skew is split."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Batches) -> Batches:
        for batch in batches:
            ok = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield rows_of(schema, a=batch.column(0).to_numpy()[ok], b=batch.column(1).to_numpy()[ok])

    return map_batches(both, check, "a long, b long")


def confirmed_classes(
    pairs: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    similar: Callable[[list, list], np.ndarray],
) -> tuple[DataFrame, DataFrame]:
    """Classes that the confirmed pairs form: ``id, component`` (ids with a link only), and the links behind them.

    ``fetch`` gives ``id, text`` for a table of ids. First ``FIRST_PAIRS`` good pairs of every id are confirmed;
    among equals a hash decides, so that a large group of copies is joined up from few pairs. Then all other pairs
    whose ends are not in one class yet are confirmed too. Every pair is therefore either confirmed, refuted or
    between two ids that are in one class already.
    """
    pairs = store(pairs.groupBy("a", "b").agg(F.max("score").alias("score")))
    ends = pairs.select("a", "b", "score", F.explode(F.array("a", "b")).alias("id"))
    texts = store(fetch(ends.select("id").distinct()))
    # The pairs of an id are dealt into lots by a hash, and the best of each lot is taken.
    rank = F.struct(F.col("score"), F.xxhash64("a", "b").alias("tie"), F.col("a"), F.col("b"))
    best = ends.groupBy("id", (F.abs(F.xxhash64("b", "a")) % FIRST_PAIRS).alias("lot")).agg(F.max(rank).alias("best"))
    chosen = store(best.select("best.a", "best.b").distinct())
    links = store(_confirmed(chosen, texts, similar))
    classes = store(components(links))
    x = classes.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    y = classes.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    rest = store(
        pairs.select("a", "b").join(chosen, ["a", "b"], "left_anti").join(x, "a", "left").join(y, "b", "left")
        .where("ca is null or cb is null or ca != cb").select("a", "b")
    )
    if rest.isEmpty():
        discard(pairs, texts, chosen, rest)
        return classes, links
    more = store(_confirmed(rest, texts, similar))
    links = links.union(more)
    result = store(components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))
    discard(pairs, texts, chosen, rest, classes)
    return result, links


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The number of common values of each set of ``one`` and each of ``two``."""
    sets = one + two
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, column, first = row[order], column[order], np.concatenate(([0], np.cumsum(count)))
    n, common = len(one), np.zeros((len(one), len(two)), np.float32)
    dense = np.flatnonzero(count >= DENSE_FROM)
    for at in range(0, len(dense), DENSE_COLUMNS):
        some = dense[at : at + DENSE_COLUMNS]
        mark = np.zeros((len(sets), len(some)), np.float32)
        mark[np.concatenate([row[first[c] : first[c + 1]] for c in some]), np.repeat(np.arange(len(some)), count[some])] = 1
        common += mark[:n] @ mark[n:].T
    # Rows ascend within a column, so every pair of a column is a value and one some places behind it.
    left = np.flatnonzero((count[column] > 1) & (count[column] < DENSE_FROM))
    row, column = row[left], column[left]
    for step in range(1, DENSE_FROM):
        a, b = row[:-step], row[step:]
        hit = (column[:-step] == column[step:]) & (a < n) & (b >= n)
        if len(a):
            np.add.at(common, (a[hit], b[hit] - n), 1)
    return common


def _linked(ids: list[np.ndarray], sets: list[list[np.ndarray]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an id of the first and one of the last block whose sets are similar."""
    sizes = [np.array([len(x) for x in part]) for part in (sets[0], sets[-1])]
    common = _overlaps(sets[0], sets[-1]).astype(np.int64)
    i, j = np.nonzero(100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common))
    a, b = ids[0][i], ids[-1][j]
    return a[a != b], b[a != b]


def crowded_links(
    bands: DataFrame, classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, percent: int, least: int = 2
) -> DataFrame:
    """The links of ``crowded_set_links`` for nodes with an array of keys (``id, bands``); ``fetch`` gives ``id, text``."""

    def sets(batches: Batches) -> Batches:
        schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("shingles", pa.binary())])
        for batch in batches:
            made = shingles.text_shingles(batch.column(1).to_pylist(), width)
            yield rows_of(schema, id=batch.column(0), size=[len(x) for x in made], shingles=[x.tobytes() for x in made])

    fetch_sets = lambda ids: map_batches(fetch(ids), sets, "id long, size long, shingles binary")
    return crowded_set_links(bands.select("id", F.explode("bands").alias("band")), classes, fetch_sets, percent, least)


def _united(members: DataFrame) -> DataFrame:
    """``members`` (stored; ``id, band, component``) with buckets that share nodes made one, where that takes fewer rows.

    Similar nodes meet in many buckets; apart, each of these would get all their sets. Buckets that hang together only through a
    few nodes stay apart.
    """
    blocks = lambda n: F.col(n) * F.ceil(F.col(n) / BLOCK_NODES)
    buckets = store(members.groupBy("band").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")))
    groups = store(components(members.join(buckets, "band").select(F.col("head").alias("a"), F.col("id").alias("b"))))
    apart = buckets.join(groups, F.col("head") == F.col("id")).groupBy(F.col("component").alias("whole")).agg(F.sum(blocks("n")).alias("apart"))
    sizes = groups.groupBy(F.col("component").alias("whole")).agg(F.count(F.lit(1)).alias("n"))
    cheap = store(sizes.join(apart, "whole").where(blocks("n") <= F.col("apart")).select("whole"))
    of = store(groups.select("id", F.col("component").alias("whole")).join(cheap, "whole"))
    made = members.join(of, "id", "left").select("id", F.when(F.col("whole").isNull(), F.col("band")).otherwise(F.xxhash64("whole")).alias("band"), "component")
    result = store(made.distinct())
    discard(buckets, groups, cheap, of, members)
    return result


def crowded_set_links(
    keys: DataFrame, classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, least: int = 2
) -> DataFrame:
    """``a, b``: links between classes, from all pairs of the nodes that share a key, however many they are.

    ``keys`` (``id, band``) are the nodes and their keys, ``classes`` (``id, component``) the nodes with a link so far. ``fetch``
    gives ``id, size, shingles`` (their bytes) for a table of ids. A bucket, the nodes with one key, takes part while its
    nodes are in more than one class and it has at least ``least`` of them. It is cut by a hash of the id into blocks of bounded size, and every two blocks are compared
    in one piece, on their full shingle sets; pieces are spread over as many tasks as their size asks for. Of the links of a piece
    a forest is returned, which joins the same nodes.
    """
    rows = keys.join(classes, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "band")
    # Stored, so that a few buckets are broadcast and many are not.
    open_ = store(
        rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low != high").where(F.col("n") >= least).select("band")
    )
    if open_.isEmpty():
        discard(open_)
        return classes.select(F.col("id").alias("a"), F.col("component").alias("b")).limit(0)
    members = _united(store(rows.join(open_.select("band"), "band").select("id", "band", "component")))
    held = store(fetch(members.select("id").distinct()))
    sized = store(members.join(held.select("id", "size"), "id").select("id", "band", "component", "size"))
    each = sized.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    # The largest class of a bucket is not compared with itself.
    largest = F.max(F.struct("n", "size", "component"))
    total = store(each.groupBy("band").agg(largest.alias("main"), F.sum("n").alias("n"), F.sum("size").alias("total")))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    dealt = sized.join(total.select(
        "band", F.col("main.component").alias("main"), parts(F.col("main.n"), F.col("main.size")).alias("main_parts"),
        parts(F.col("n") - F.col("main.n"), F.col("total") - F.col("main.size")).alias("rest_parts"),
    ), "band").withColumn("is_main", F.col("component") == F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("id", "band"), F.col(n)).cast("int")
    block = F.when(F.col("is_main"), F.col("rest_parts") + place("main_parts")).otherwise(place("rest_parts"))
    # The pieces of a block: those with every block of the rest, and for one of the rest with those of the largest class too.
    last = F.col("rest_parts") - 1 + F.when(F.col("is_main"), 0).otherwise(F.col("main_parts"))
    paired = dealt.select("id", "band", "size", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    pieces = store(paired.select("id", "band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "size"))
    joined = pieces.drop("size").join(held.select("id", "shingles"), "id").select("band", "one", "two", "block", "id", "shingles")
    # Enough tasks for the bytes that are dealt, so that adaptive execution has no say and needs none.
    dealt_bytes = 8 * (pieces.agg(F.sum("size")).first()[0] or 0)
    n_tasks = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt_bytes // PIECE_BYTES))
    joined = joined.repartition(n_tasks, "band", "one", "two").sortWithinPartitions("band", "one", "two", "block")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Batches) -> Batches:
        piece, ids, made = None, {}, {}

        def done() -> pa.RecordBatch | None:
            blocks = sorted(ids)
            if piece is None or piece[1] != piece[2] and len(blocks) < 2:
                return None
            a, b = _linked([np.array(ids[k]) for k in blocks], [made[k] for k in blocks], percent)
            if not len(a):
                return None
            nodes, root = roots(a, b)
            return rows_of(schema, a=root[root != nodes], b=nodes[root != nodes])

        for batch in batches:
            for band, one, two, k, node, part in zip(*(c.to_pylist() for c in batch.columns)):
                if piece != (band, one, two):
                    if (out := done()) is not None:
                        yield out
                    piece, ids, made = (band, one, two), {}, {}
                ids.setdefault(k, []).append(node)
                made.setdefault(k, []).append(np.frombuffer(part, np.uint64))
        if (out := done()) is not None:
            yield out

    links = store(map_batches(joined, compare, "a long, b long"))
    discard(open_, members, held, sized, total, pieces)
    return links


def completed_classes(
    classes: DataFrame, bands: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, percent: int, least: int = 2
) -> DataFrame:
    """``classes`` joined up by ``crowded_links``: no two nodes that share a band and are similar are in different classes.

    Bands with fewer than ``least`` nodes are left out: all their pairs were compared before.
    """
    links = crowded_links(bands, classes, fetch, width, percent, least)
    if links.isEmpty():
        return classes
    return components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
