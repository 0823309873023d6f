"""Search for benchmark items inside documents by MinHash containment.

Items are short and documents long, so whole-document signatures would hardly ever agree. Items are therefore
partitioned by size, and for each partition the documents are read through half-overlapping windows of twice the
partition's upper size: a passage of an item lies wholly in one of them, whose Jaccard similarity with the item
has a lower bound. A window that shares a MinHash value with an item makes the pair a candidate; candidates
are confirmed by the exact share of the item's shingles in the whole document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import shingles
from logweave.llm.common import Batches, map_batches, rows_of, store

# Smallest partition: items of up to so many shingles; each further one is for twice as many.
SMALLEST = 16
# MinHash values of a window. A window of 2 * s shingles that holds 80 % of an item of q, s / 2 < q <= s, has a
# similarity of at least 0.8 * q / (2 * s + 0.2 * q) >= 0.19: 64 values miss it with probability 1.4e-6.
FUNCTIONS = 64
# Shingles of benchmark items handed to all tasks at once (8 bytes each, and FUNCTIONS values an item).
# Larger benchmarks are searched block by block.
BLOCK_SHINGLES = 2_000_000


class _Partition:
    """Items of one size range: their MinHash values, sorted, with the item of each."""

    def __init__(self, size: int, items: list[int], sets: list[np.ndarray], hashes: shingles.MinHash):
        self.size = size
        start = np.cumsum([0, *map(len, sets)])[:-1]
        rows = hashes.signatures(np.concatenate(sets), start)
        self.values = []
        for k in range(hashes.size):
            order = np.argsort(rows[:, k], kind="stable")
            self.values.append((rows[order, k], np.array(items)[order]))


def _blocks_of(group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut each text's run in ``group`` into blocks of ``size``: where the blocks start, and their texts."""
    first = np.searchsorted(group, group, side="left")
    start = np.flatnonzero((np.arange(len(group)) - first) % size == 0)
    return start, group[start]


class Benchmark:
    """A block of benchmark items, ready to search texts for them."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = np.array(ids, np.int64), sets, percent
        self.all = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        self.hashes = shingles.MinHash(FUNCTIONS, seed=23)
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            size = SMALLEST
            while size < len(s):
                size *= 2
            by_size.setdefault(size, []).append(k)
        self.partitions = [_Partition(size, ks, [sets[k] for k in ks], self.hashes) for size, ks in sorted(by_size.items())]

    def candidates(self, values: np.ndarray, group: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of which a window and the item share a MinHash value. ``values`` keep the order of the texts."""
        found: set[tuple[int, int]] = set()
        if not len(values):
            return found
        size = SMALLEST
        start, owner = _blocks_of(group, size)
        minima = self.hashes.signatures(values, start)
        for part in self.partitions:
            while size < part.size:
                start, merged = _blocks_of(owner, 2)
                minima, owner, size = np.minimum.reduceat(minima, start, axis=0), merged, 2 * size
            # A window is two blocks that follow each other in a text; the last block is also a window of its own.
            pairs = np.flatnonzero(owner[1:] == owner[:-1])
            windows = np.concatenate((np.minimum(minima[pairs], minima[pairs + 1]), minima))
            text = np.concatenate((owner[pairs], owner))
            for k, (known, item) in enumerate(part.values):
                at = np.searchsorted(known, windows[:, k])
                hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == windows[:, k])
                for w in hit:
                    j = at[w]
                    while j < len(known) and known[j] == windows[w, k]:
                        found.add((int(text[w]), int(item[j])))
                        j += 1
        return found

    def confirmed(self, texts: list[str | None], width: int) -> list[tuple[int, int, int, int]]:
        """(text, item, common shingles, shingles of the item) for every item that is contained in a text."""
        out = []
        for first, last, _, _, words in shingles.chunks(texts, shingles.NOT_ALPHANUMERIC):
            values, group = shingles.shingle_hashes(words.hash, words.text, width)
            wanted: dict[int, list[int]] = {}
            for t, k in self.candidates(values, group):
                wanted.setdefault(t, []).append(k)
            for t, items in wanted.items():
                lo, hi = np.searchsorted(group, [t, t + 1])
                own = np.unique(values[lo:hi])
                for k in items:
                    common = len(np.intersect1d(own, self.sets[k], assume_unique=True))
                    if 100 * common >= self.percent * len(self.sets[k]):
                        out.append((first + t, int(self.ids[k]), common, len(self.sets[k])))
        return out


def _blocks(benchmark: DataFrame, width: int, percent: int):
    """The benchmark in blocks of bounded size: rows come to the driver one after the other, never all at once."""
    ids, sets, total = [], [], 0
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    for row in items.orderBy("item_id").toLocalIterator():
        own = shingles.text_shingles([row[1]], width, shingles.NOT_ALPHANUMERIC, short=False)[0]
        if not len(own):
            continue
        if total + len(own) > BLOCK_SHINGLES and ids:
            yield Benchmark(ids, sets, percent)
            ids, sets, total = [], [], 0
        ids.append(row[0])
        sets.append(own)
        total += len(own)
    if ids:
        yield Benchmark(ids, sets, percent)


FOUND = "doc_id long, item_id long, common long, item_shingles long"


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, common, item_shingles``: every benchmark item of which a document holds enough.

    An item (``item_id, text``) is held when ``100 * common >= percent * item_shingles`` for distinct shingles of ``width``
    words. Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased, so punctuation does not matter.

    Nulls and odd rows: null texts and texts, items too, with fewer than ``width`` words have no shingles and match nothing;
    rows with a null ``doc_id`` or ``item_id`` are skipped. Repeated rows give repeated results. Empty tables give an
    empty result. Other columns are not read.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "common", "item_shingles")])
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    found = None
    for block in _blocks(benchmark, width, percent):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Batches, shared=shared) -> Batches:
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                hits = np.array(shared.value.confirmed(texts, width), np.int64).reshape(-1, 4)
                yield rows_of(schema, doc_id=ids[hits[:, 0]], item_id=hits[:, 1], common=hits[:, 2], item_shingles=hits[:, 3])

        part = map_batches(known, run, FOUND)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], FOUND) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; see ``contained_items``.

    Rows with a null ``doc_id`` stay. All columns stay as they are.
    """
    hit = store(contained_items(docs, benchmark, width, percent).select(F.col("doc_id").alias("_hit_doc")).distinct())
    return docs.join(hit, F.col("doc_id") == F.col("_hit_doc"), "left_anti")
