"""MinHash near-duplicate search in an LSH forest.

Every distinct shingle set gets one signature. A tree of the forest is the table of signatures sorted by one
selection of their components; documents that stand next to each other have the longest common prefixes. How
deep a prefix must be to bring two documents together is not fixed: it follows from how crowded that region of the order
is. Candidates of all trees are confirmed on the full sets, and the links make classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import shingles
from logweave.llm.common import Batches, discard, map_batches, rows_of, store
from logweave.llm.components import components
from logweave.llm.linking import completed_classes, confirmed_classes, sorted_neighbours

# Components of a tree's sort key. Eight 16-bit components tell any two sets apart that are worth it.
DEPTH = 8
# Prefix below which neighbours are not compared at all.
LEAST_DEPTH = 2
# MinHash values of a band. All sets with an equal band are compared, where the neighbours have not linked them.
BAND_ROWS = 5


class Forest:
    """Parameters: ``trees`` sorted orders, shingles of ``width`` words, links from ``percent`` % Jaccard similarity.

    A pair at 80 % shares a prefix of four components in one tree with probability 0.41, so 20 trees miss
    it with probability 3e-5; a deeper region of a larger corpus needs more trees.
    """

    def __init__(self, width: int = 5, percent: int = 80, trees: int = 20):
        self.width, self.percent, self.trees = width, percent, trees

    def similar(self, left: list, right: list) -> np.ndarray:
        """Which pairs of texts are linked, on their full shingle sets."""
        a, b = shingles.text_shingles(left, self.width), shingles.text_shingles(right, self.width)
        sizes = np.array([shingles.jaccard(x, y) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
        return 100 * sizes[:, 0] >= self.percent * sizes[:, 1]

    def least_bits(self) -> float:
        """Share of equal sketch bits below which a pair is not worth a look: five standard deviations under its mean."""
        j = self.percent / 100
        mean = (1 + j) / 2
        return mean - 5 * (mean * (1 - mean) / self._functions()) ** 0.5

    def _functions(self) -> int:
        return self.trees * DEPTH

    def signatures(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n_shingles, set_key, signature, bands``: the set's size, a 128-bit key of the set, its MinHash values, and
        a hash of each band of them.

        The set key, signature and bands of an empty set are null.
        """
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary()),
            ("bands", pa.list_(pa.int64())),
        ])
        width, hashes = self.width, shingles.MinHash(self._functions())

        def run(batches: Batches) -> Batches:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                for first, last, _, _, words in shingles.chunks(texts):
                    n = last - first
                    values, start, owner = shingles.grouped(*shingles.all_shingles(words, n, width))
                    size = np.zeros(n, np.int64)
                    size[owner] = np.diff(np.append(start, len(values)))
                    rows = hashes.signatures(values, start)
                    hashed = shingles.band_hashes(rows, BAND_ROWS)
                    key, signature, bands = [None] * n, [None] * n, [None] * n
                    for k, g in enumerate(owner):
                        part = values[start[k] : start[k] + size[g]]
                        key[g] = hashlib.blake2b(part.tobytes(), digest_size=16).digest()
                        signature[g] = (rows[k] >> 16).astype(">u2").tobytes() + np.packbits(rows[k] & 1).tobytes()
                        bands[g] = hashed[k]
                    yield rows_of(schema, doc_id=ids.slice(first, n), n_shingles=size, set_key=key, signature=signature, bands=bands)

        made = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<bigint>"
        return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, made)

    def keyed_texts(self, docs: DataFrame) -> DataFrame:
        """``doc_id, text, set_key`` of texts (``doc_id, text``) with words."""
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("set_key", pa.binary())])

        def run(batches: Batches) -> Batches:
            for batch in batches:
                made = shingles.text_shingles(batch.column(1).to_pylist(), self.width)
                key = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in made]
                yield rows_of(schema, doc_id=batch.column(0), text=batch.column(1), set_key=key)

        return map_batches(docs.select("doc_id", "text"), run, "doc_id long, text string, set_key binary")

    def tree_keys(self, sets: DataFrame) -> DataFrame:
        """``key, id, sketch``: one row per set (``id, signature``) and tree. A key is the tree's number and its components."""
        schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("sketch", pa.binary())])
        trees, n_bytes = self.trees, 2 * self._functions()
        # Every tree takes the components in an order of its own.
        picks = np.random.RandomState(5).permutation(self._functions()).reshape(trees, DEPTH)

        def run(batches: Batches) -> Batches:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
                values, sketch = data[:, :n_bytes].reshape(len(ids), -1, 2), [s.tobytes() for s in data[:, n_bytes:]]
                for t in range(trees):
                    key = np.concatenate((np.full((len(ids), 1), t, np.uint8), values[:, picks[t]].reshape(len(ids), -1)), axis=1)
                    yield rows_of(schema, key=[k.tobytes() for k in key], id=ids, sketch=sketch)

        return map_batches(sets.select("id", "signature"), run, "key binary, id long, sketch binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 20) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the class of every document and the one that stays of each class.

    Documents are linked when ``100 * intersection >= percent * union`` holds for their sets of ``width``-word shingles
    (words: runs without blanks, A-Z lower-cased). ``component_id`` is the smallest ``doc_id`` reachable; that
    document is kept.

    Nulls and odd rows: a text that is null or without words has an empty set and is linked with nothing; one
    with fewer words than ``width`` is one shingle. A row with a null ``doc_id`` is returned with null
    ``component_id`` and kept. Rows that repeat a ``doc_id`` are one document with the links of all its texts, and
    each row is returned. An empty table gives an empty result. Columns besides ``doc_id`` and ``text`` are not read.
    """
    forest = Forest(width, percent, trees)
    signed = store(forest.signatures(docs))
    # Equal sets are one node from here on, however many documents have them.
    sets = store(
        signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"), F.min("bands").alias("bands"))
    )
    rows = store(signed.drop("signature", "bands"))
    discard(signed)
    # Where rows repeat a doc_id, one document may have several sets; then nodes have numbers of their own.
    numbered = rows.where("doc_id is not null")
    repeated = numbered.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    nodes = store(sets.select(F.monotonically_increasing_id().alias("id"), "set_key", F.col("id").alias("doc_id"), "signature", "bands")) if repeated else sets
    pairs = sorted_neighbours(forest.tree_keys(nodes), 1 + 2 * LEAST_DEPTH, forest.least_bits())

    def fetch(ids: DataFrame) -> DataFrame:
        # The same plan at every size: the ids of all candidates are never broadcast.
        known = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        if not repeated:
            return known.join(ids.hint("shuffle_hash"), "id", "left_semi")
        wanted = nodes.select("id", "set_key", "doc_id").join(ids, "id", "left_semi")
        some = known.join(wanted.select(F.col("doc_id").alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi")
        texts = forest.keyed_texts(some.select(F.col("id").alias("doc_id"), "text"))
        return texts.join(wanted, ["doc_id", "set_key"]).groupBy("id").agg(F.min("text").alias("text"))

    classes, _ = confirmed_classes(pairs, fetch, forest.similar)
    classes = completed_classes(classes, nodes.select("id", "bands"), fetch, width, percent)
    member = nodes.select("set_key", "id", (F.col("doc_id") if repeated else F.col("id")).alias("head"))
    if repeated:
        # The sets of one document are one in the end, and the smallest doc_id names the class.
        owned = store(numbered.where("set_key is not null").join(member, "set_key").select("doc_id", "id").distinct())
        first = owned.groupBy("doc_id").agg(F.min("id").alias("a"))
        own = owned.join(first, "doc_id").select("a", F.col("id").alias("b"))
        classes = components(own.union(classes.select("id", "component")))
        heads = member.join(classes, "id").groupBy("component").agg(F.min("head").alias("doc_id"))
        classes = store(classes.join(heads, "component").select("id", F.col("doc_id").alias("component")))
    member = store(member.join(classes, "id", "left").select("set_key", F.coalesce("component", "head").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(member, "set_key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )
