"""Exact Jaccard join of shingle sets, light and heavy sets apart.

Small (light) sets write out all their subsets of the sizes that a partner must share; two linked ones meet in an equal subset.
Large (heavy) sets would have too many subsets. They are looked up in inverted lists: of the shingles that occur twice or more,
the rarest ones of each set, as many as no partner can all miss, name the lists to be scanned. Light sets that are large enough
for a heavy partner stand in the lists too. The size that parts light from heavy is the one that makes the fewest rows.

Both kinds of keys are a complete filter: linked sets always share one. Sets that share a key are compared exactly.

Before that, a sample of every set's shingles, the smallest by hash, is counted: where fewer of them occur in another set than
a partner must have, the set has none and goes no further. So the shingles of most sets are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import shingles
from logweave.llm.common import Batches, discard, map_batches, rows_of, store
from logweave.llm.components import components
from logweave.llm.linking import NEIGHBOURS, confirmed_classes, crowded_set_links, sorted_neighbours
from logweave.runtime import broadcast_if_small

# Sizes that are ever considered light.
LIGHT_MOST = 40


@cache
def _removals(size: int, removed: int) -> np.ndarray:
    """The places of every ``removed`` of ``size`` elements."""
    return np.array(list(combinations(range(size), removed)), np.int64).reshape(comb(size, removed), removed)


@cache
def _due(width: int, percent: int, size: int) -> int:
    """Shingles of the sample of a set of this size that stand in the sample of a partner, at least; see ``Join.due``."""
    join = Join(width, percent)
    others = range(join.least(size), 100 * size // percent + 1)
    return min(min(join.sample(n) - (n - join.shared(size, other)) for n in (size, other)) for other in others)


class Join:
    """Parameters: sets of ``width``-word shingles; links from ``percent`` % Jaccard similarity."""

    def __init__(self, width: int = 3, percent: int = 90):
        self.width, self.percent = width, percent

    def shared(self, a: int, b: int) -> int:
        """Common shingles that linked sets of these sizes have at least."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least(self, size: int) -> int:
        """The smallest size of a partner, which is also the number of shingles shared with any."""
        return -(-self.percent * size // 100)

    def subset_sizes(self, size: int, light: int) -> list[int]:
        """Sizes of the subsets that a light set shares with light partners."""
        most = min(light, 100 * size // self.percent)
        return sorted({self.shared(size, other) for other in range(self.least(size), most + 1)})

    def light_up_to(self, counts: dict[int, int], heavy_shingles: int) -> int:
        """The size up to which sets are light: the one with the least rows to move.

        ``counts``: sets by size, up to ``LIGHT_MOST``. A light set costs its subsets; one in the lists costs two rows a
        shingle, to count it and to bring the count back, and one a list. ``heavy_shingles`` of still larger sets always cost that.
        """

        def cost(light: int) -> int:
            subsets = sum(n * sum(comb(s, c) for c in self.subset_sizes(s, light)) for s, n in counts.items() if s <= light)
            listed = sum(n * (3 * s - self.least(s) + 1) for s, n in counts.items() if s >= self.least(light + 1))
            return subsets + listed + 2 * heavy_shingles

        return min(range(LIGHT_MOST + 1), key=cost)

    def sample(self, size: int) -> int:
        """Shingles of the sample: so many that more than half of them are a partner's too."""
        return min(size, 2 * (size - self.least(size)) + 1)

    def due(self, size: int) -> int:
        """Shingles that the samples of a set and of any partner share at least. A sample lacks the shingles that only one of
        the two has; those of both come in the same order, so the shorter of the two beginnings is shared. A smaller partner has a smaller sample."""
        return _due(self.width, self.percent, size) if size else 0

    def _made(self, docs: DataFrame, cut: Callable[[int], int]) -> DataFrame:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.list_(pa.int64())),
            ("due", pa.int64()),
        ])
        width = self.width

        def run(batches: Batches) -> Batches:
            for batch in batches:
                made = shingles.text_shingles(batch.column(1).to_pylist(), width)
                keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in made]
                yield rows_of(schema, doc_id=batch.column(0), n_shingles=[len(x) for x in made], set_key=keys,
                              shingles=[x[: cut(len(x))].view(np.int64) if len(x) else None for x in made],
                              due=[self.due(len(x)) for x in made])

        made = "doc_id long, n_shingles long, set_key binary, shingles array<bigint>, due long"
        return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, made)

    def signed(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n_shingles, set_key, sample, due`` of every row; without words, key and sample are null."""
        return self._made(docs, self.sample).withColumnRenamed("shingles", "sample")

    def whole_sets(self, docs: DataFrame) -> DataFrame:
        """``doc_id, set_key, shingles``: all shingles of every row."""
        return self._made(docs, lambda size: size).drop("n_shingles", "due")

    def hopeful(self, sampled: DataFrame) -> DataFrame:
        """``id`` of the distinct sets (``id, sample, due``) of whose sample enough shingles occur in other samples, too."""
        rows = sampled.select("id", F.explode("sample").alias("shingle"))
        # Counted within tasks first, so a very common shingle is a few rows.
        often = store(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle"))
        hits = rows.join(broadcast_if_small(often), "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("found"))
        return sampled.select("id", "due").join(hits, "id", "left").where(F.coalesce("found", F.lit(0)) >= F.col("due")).select("id")

    def subset_keys(self, sets: DataFrame, light: int) -> DataFrame:
        """``id, keys``: a hash of every subset that counts, of the light sets (``id, shingles``)."""
        schema = pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int64()))])

        def run(batches: Batches) -> Batches:
            for batch in batches:
                keys = []
                for values in batch.column(1):
                    # A subset's hash is the sum of its elements' hashes: the whole without the removed ones.
                    x = shingles.mixed(values.values.to_numpy().view(np.uint64))
                    whole, parts = x.sum(dtype=np.uint64), []
                    for kept in self.subset_sizes(len(x), light):
                        rest = whole - x[_removals(len(x), len(x) - kept)].sum(axis=1, dtype=np.uint64)
                        parts.append(shingles.mixed(rest ^ np.uint64(kept << 48)))
                    keys.append(np.concatenate(parts).view(np.int64))
                yield rows_of(schema, id=batch.column(0), keys=keys)

        return map_batches(sets.where(F.size("shingles") <= light).select("id", "shingles"), run, "id long, keys array<bigint>")

    def list_keys(self, sets: DataFrame, light: int) -> DataFrame:
        """``id, keys``: the inverted lists that a set is looked up in, and stands in: its rarest shingles.

        Shingles of one set only come first in the order and need no list. A set with too many of them has no partner.
        """
        known = sets.where(F.size("shingles") >= self.least(light + 1))
        rows = known.select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
        # Counted within tasks first, so a very common shingle is a few rows.
        counts = store(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        found = rows.join(broadcast_if_small(counts), "shingle").groupBy("id").agg(
            F.first("size").alias("size"), F.sort_array(F.collect_set(F.struct("n", "shingle")))["shingle"].alias("common")
        )
        least = F.ceil(F.lit(self.percent) * F.col("size") / 100)
        lists = (F.size("common") - least + 1).cast("int")
        return found.where(lists > 0).select("id", F.slice("common", F.lit(1), lists).alias("keys"))

    def similar(self, left: list[bytes], right: list[bytes]) -> np.ndarray:
        sizes = np.array([shingles.jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(left, right)], np.int64)
        sizes = sizes.reshape(-1, 2)
        return 100 * sizes[:, 0] >= self.percent * sizes[:, 1]


def _sort_keys(members: DataFrame) -> DataFrame:
    """``key, id, sketch`` for ``sorted_neighbours``: the shared key, and a hash behind it, so that each list has an order of its own."""
    schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, ids = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            both = np.column_stack((keys, shingles.mixed(keys ^ shingles.mixed(ids)))).astype(">u8")
            yield rows_of(schema, key=[k.tobytes()[:10] for k in both], id=batch.column(1), sketch=[b"\0"] * len(both))

    return map_batches(members.select("band", "id"), run, "key binary, id long, sketch binary")


def _bytes(sets: DataFrame) -> DataFrame:
    """``id, size, text``: the shingles of each set as bytes."""
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("text", pa.binary())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            made = [x.values.to_numpy() for x in batch.column(1)]
            yield rows_of(schema, id=batch.column(0), size=[len(x) for x in made], text=[x.tobytes() for x in made])

    return map_batches(sets.select("id", "shingles"), run, "id long, size long, text binary")


def joined_classes(sets: DataFrame, join: Join) -> DataFrame:
    """``id, component``: the classes that the links of the stored distinct ``sets`` (``id, shingles``) form."""
    small = F.size("shingles") <= LIGHT_MOST
    counted = sets.groupBy(F.when(small, F.size("shingles")).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("all"))
    counts = {r["size"]: r for r in counted.collect()}
    heavy = counts.pop(None, None)
    light = join.light_up_to({s: r["n"] for s, r in counts.items()}, heavy["all"] if heavy else 0)
    keyed = store(join.subset_keys(sets, light).union(join.list_keys(sets, light)))
    exploded = keyed.select("id", F.explode("keys").alias("band"))
    often = store(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"))
    members = store(exploded.join(broadcast_if_small(often), "band"))
    discard(keyed)

    def fetch(ids: DataFrame) -> DataFrame:
        return _bytes(sets.join(ids.hint("shuffle_hash"), "id", "left_semi"))

    classes, _ = confirmed_classes(sorted_neighbours(_sort_keys(members), 8, 0.0), fetch, join.similar)
    # A shorter list had all its pairs compared among neighbours.
    more = crowded_set_links(members, classes, lambda ids: fetch(ids).withColumnRenamed("text", "shingles"), join.percent, NEIGHBOURS + 2)
    return components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the size of every document's set and the smallest ``doc_id`` its links reach.

    Two documents are linked when ``100 * intersection >= percent * union`` holds for their sets of ``width``-word shingles
    (words: runs without blanks, A-Z lower-cased). All links between different sets are found, whatever their number.

    Nulls and odd rows: a text that is null or without words has an empty set and is linked with nothing; one
    with fewer words than ``width`` is one shingle. A row with a null ``doc_id`` is returned with a null ``component_id``;
    it links nobody. Rows that repeat a ``doc_id`` are one document: it has the links of all of them, and each row is
    returned. An empty table gives an empty result. Columns besides ``doc_id`` and ``text`` are not read.
    """
    join = Join(width, percent)
    # Numbered once and stored, so that the numbers stay.
    signed = store(join.signed(docs).withColumn("row", F.monotonically_increasing_id()))
    rows = signed.select("row", "doc_id", "n_shingles", "set_key")
    # Equal sets are one node, whatever documents they belong to.
    nodes = store(
        rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"))
    )
    owned = store(rows.join(nodes.select("set_key", "id"), "set_key").where("doc_id is not null").select("row", "doc_id", "id"))
    copies = store(owned.where("row != id").select("row"))
    known = signed.where("set_key is not null and doc_id is not null").join(broadcast_if_small(copies), "row", "left_anti")
    hopeful = store(join.hopeful(known.select(F.col("row").alias("id"), "sample", "due")))
    kept = store(nodes.join(hopeful, "id").select("set_key", "doc_id", "id"))
    some = docs.select(F.col("doc_id").cast("long"), "text").join(kept.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    sets = store(join.whole_sets(some).join(broadcast_if_small(kept), ["set_key", "doc_id"]).select("id", "shingles"))
    classes = joined_classes(sets, join)
    # Rows of one document are one, whatever their sets.
    parted = owned.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z")
    if not parted.isEmpty():
        own = owned.join(parted.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b"))
        classes = components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(own))
    placed = store(nodes.join(classes, "id", "left").select("set_key", "doc_id", F.coalesce("component", "id").alias("component")))
    heads = placed.groupBy("component").agg(F.min("doc_id").alias("head"))
    named = store(placed.join(heads, "component").select("set_key", "head"))
    return rows.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")).alias("component_id")
    )
