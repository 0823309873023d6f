"""Groups of spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

The filters are cut by word length and, where a length has very many words, by hash, so that each has a bounded size. Every word's
edits (one code point deleted, or replaced by a later one: each pair of neighbours is met from one side) are hashed without being
written out, and only the edits that a filter does not rule out become rows. They meet the vocabulary in an exact join,
which removes the false positives. Filters are broadcast in groups of at most ``GROUP_BYTES``; a larger vocabulary takes more passes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import shingles
from logweave.llm.common import Batches, discard, map_batches, rows_of, store

# Words of a filter (before it is cut by hash), bits a word, and bytes of the filters that are broadcast together.
SHARD_WORDS, BITS, GROUP_BYTES = 1 << 20, 16, 64 << 20
# Words from this length on share one class of filters.
LONG = 64
# Edits hashed at a time; counts held before they are handed on.
EDITS, HELD = 1 << 21, 1 << 18

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
# Odd multipliers that pick the bit of each of the eight words of a block.
_SALTS = shingles.mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def lowered(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.encode().translate(_LOWER).decode()


class Filter:
    """A blocked Bloom filter: each key sets one bit in each of the eight words of one block."""

    def __init__(self, words: np.ndarray):
        self.words = words.reshape(-1, 8)

    @classmethod
    def of(cls, keys: np.ndarray) -> Filter:
        made = cls(np.zeros(8 * max(1, -(-len(keys) * BITS // 512)), np.uint64))
        block = made._block(keys)
        for j in range(8):
            np.bitwise_or.at(made.words[:, j], block, made._bit(keys, j))
        return made

    def _block(self, keys: np.ndarray) -> np.ndarray:
        return ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(len(self.words))) >> np.uint64(32)

    def _bit(self, keys: np.ndarray, j: int) -> np.ndarray:
        return np.uint64(1) << ((keys * _SALTS[j]) >> np.uint64(58))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in the set; most others drop out at the first word."""
        at = np.arange(len(keys))
        block = self._block(keys)
        for j in range(8):
            hit = (self.words[block, j] & self._bit(keys, j)) != 0
            at, keys, block = at[hit], keys[hit], block[hit]
        return at


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(_BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def _key(value: np.ndarray, length: int) -> np.ndarray:
    return shingles.mixed(value + np.uint64(length * 0xD1342543DE82EF95 & (1 << 64) - 1))


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, length)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    groups: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        groups.setdefault(len(word), []).append(k)
    yield from sorted(groups.items())


def word_keys(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, from which those of its edits follow."""
    out = np.empty(len(words), np.uint64)
    for length, at in _by_length(words):
        step = max(1, EDITS // length)
        for k in range(0, len(at), step):
            letters = _letters([words[i] for i in at[k : k + step]], length)
            out[at[k : k + step]] = _key((letters * _powers(length)[:length]).sum(axis=1, dtype=np.uint64), length)
    return out


def edits(words: list[str], length: int, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(new length, keys, word, place, code point)`` of the edits of words of one length, some at a time.

    Deletions have code point 0; replacements only take code points of ``alphabet`` above the replaced one.
    """
    powers = _powers(length)
    letters = _letters(words, length)
    terms = letters * powers[:length]
    whole = terms.sum(axis=1, dtype=np.uint64)
    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    span = max(1, EDITS // max(1, len(words) * (1 + len(alphabet))))
    for at in range(0, length, span):
        part = slice(at, min(length, at + span))
        here = letters[:, part]
        after = whole[:, None] - before[:, part] - terms[:, part]
        row, place = np.indices(here.shape).reshape(2, -1)
        yield length - 1, _key((before[:, part] + after * _INVERSE).ravel(), length - 1), row, place + at, np.zeros(here.size, np.uint64)
        row, place, letter = np.nonzero(alphabet[None, None, :] > here[:, :, None])
        new, old = alphabet[letter], here[row, place]
        yield length, _key(whole[row] + (new - old) * powers[place + at], length), row, place + at, new


class Filters:
    """Some filters, by class of length and number."""

    def __init__(self, rows: list[tuple[int, int, bytes]], shards: list[int]):
        self.shards = shards
        self.of_class: dict[int, list[tuple[int, Filter]]] = {}
        for kind, shard, data in rows:
            self.of_class.setdefault(kind, []).append((shard, Filter(np.frombuffer(data, np.uint64))))

    def find(self, keys: np.ndarray, length: int) -> np.ndarray:
        kind = min(length, LONG)
        found = []
        for shard, held in self.of_class.get(kind, []):
            if self.shards[kind] == 1:
                found.append(held.find(keys))
            else:
                own = np.flatnonzero((keys >> np.uint64(40)) % np.uint64(self.shards[kind]) == shard)
                found.append(own[held.find(keys[own])])
        return np.concatenate(found) if found else np.empty(0, np.int64)


class Spelling:
    """Parameters: words of at least ``least`` code points with ``occurrences`` or more; a form has ``ratio`` times the occurrences
    of the word. In one of ``misspelt`` (document, word) pairs, by hash, the word loses a letter; 0: in none."""

    def __init__(self, least: int = 5, occurrences: int = 3, ratio: int = 2, misspelt: int = 97):
        self.least, self.occurrences, self.ratio, self.misspelt = least, occurrences, ratio, misspelt

    def vocabulary(self, docs: DataFrame) -> DataFrame:
        """``word, n, length, key``. Counts are added up within tasks first, so a frequent word is a few rows."""
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        run_of = re.compile(f"[a-zÀ-ÿ]{{{self.least},}}")
        least, misspelt = self.least, self.misspelt

        def count(batches: Batches) -> Batches:
            held: Counter = Counter()
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in Counter(run_of.findall(lowered(text))).items():
                        if misspelt and (h := zlib.crc32(run.encode(), head)) % misspelt == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < least:
                                continue
                        held[run] += n
                    if len(held) > HELD:
                        yield rows_of(schema, word=list(held), n=list(held.values()))
                        held.clear()
            yield rows_of(schema, word=list(held), n=list(held.values()))

        def keyed(batches: Batches) -> Batches:
            out = pa.schema([*schema, ("length", pa.int32()), ("key", pa.int64())])
            for batch in batches:
                words = batch.column(0).to_pylist()
                yield rows_of(out, word=words, n=batch.column(1), length=[len(w) for w in words], key=word_keys(words).view(np.int64))

        some = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text")
        counted = map_batches(some, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return map_batches(counted.where(F.col("n") >= self.occurrences), keyed, "word string, n long, length int, key long")

    def near_words(self, vocabulary: DataFrame) -> DataFrame:
        """``word, n, near, near_n``: every two words of the stored ``vocabulary`` that are one edit apart, from both sides."""
        spark = vocabulary.sparkSession
        kind = F.least("length", F.lit(LONG)).alias("kind")
        sizes = {r["kind"]: r["count"] for r in vocabulary.groupBy(kind).count().collect()}
        shards = [-(-sizes.get(k, 0) // SHARD_WORDS) or 1 for k in range(LONG + 1)]
        number = F.pmod(F.shiftrightunsigned("key", 40), F.element_at(F.array(*map(F.lit, shards)), kind + 1)).cast("int")
        # As a Latin alphabet has few letters, so has the broadcast list of them: 90 at most.
        letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct()
        alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint64)

        def build(keys: pa.Table) -> pa.Table:
            made = Filter.of(keys.column("key").to_numpy().view(np.uint64))
            return pa.table({"kind": keys.column("kind")[:1], "shard": keys.column("shard")[:1], "bits": [made.words.tobytes()]})

        built = store(
            vocabulary.select(kind, number.alias("shard"), "key").groupBy("kind", "shard")
            .applyInArrow(build, "kind int, shard int, bits binary")
        )
        groups: list[list[tuple[int, int]]] = []
        room = 0
        for row in built.select("kind", "shard", F.octet_length("bits").alias("size")).orderBy("kind", "shard").collect():
            if row["size"] > room:
                groups.append([])
                room = GROUP_BYTES
            groups[-1].append((row["kind"], row["shard"]))
            room -= row["size"]
        least = self.least
        probed = []
        for group in groups:
            wanted = spark.createDataFrame(group, "kind int, shard int")
            rows = [(r["kind"], r["shard"], bytes(r["bits"])) for r in built.join(F.broadcast(wanted), ["kind", "shard"]).collect()]
            filters = spark.sparkContext.broadcast((rows, shards))
            probed.append(store(self._suspects(vocabulary, filters, alphabet, least)))
            filters.destroy()
        if not probed:
            return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
        suspects = probed[0]
        for more in probed[1:]:
            suspects = suspects.union(more)
        exact = suspects.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        return exact.select(F.inline(F.array(
            F.struct("word", "n", "near", "near_n"),
            F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
        )))

    @staticmethod
    def _suspects(vocabulary: DataFrame, filters, alphabet: np.ndarray, least: int) -> DataFrame:
        """``word, n, near``: edits that the filters do not rule out."""
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string())])

        def run(batches: Batches) -> Batches:
            held = Filters(*filters.value)
            for batch in batches:
                words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for length, at in _by_length(words):
                    step = max(1, EDITS // (length * (1 + len(alphabet))))
                    for k in range(0, len(at), step):
                        own = at[k : k + step]
                        found = set()
                        for size, keys, row, place, letter in edits([words[i] for i in own], length, alphabet):
                            if size < least:
                                continue
                            for f in held.find(keys, size):
                                i, p, c = own[row[f]], int(place[f]), int(letter[f])
                                found.add((i, words[i][:p] + (chr(c) if c else "") + words[i][p + 1 :]))
                        yield rows_of(schema, word=[words[i] for i, _ in found], n=[counts[i] for i, _ in found], near=[w for _, w in found])

        return map_batches(vocabulary.select("word", "n"), run, "word string, n long, near string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of forms (``word, form``) of every word ends.

    Forms are at least twice as frequent, so chains are short; every round doubles the steps taken.
    """
    now = store(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = store(now.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, spelling: Spelling | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of the vocabulary with the frequent spelling it belongs to.

    Words are runs of Latin letters (A-Z lower-cased) of the texts. Two are near when one inserted, deleted or replaced code point
    makes one the other. ``form`` is the most frequent near word (among equals the first by code points) if it has at least
    ``ratio`` times the occurrences, else null; ``root`` is where the chain of forms ends, the word itself without a form.

    Nulls and odd rows: null and empty texts have no words. Repeated rows count as often as they stand there. A null
    ``doc_id`` reads as an empty one where words lose letters. An empty table, or one without frequent words, gives an empty
    result. Words of any length take part. Columns besides ``doc_id`` and ``text`` are not read.
    """
    spelling = spelling or Spelling()
    vocabulary = store(spelling.vocabulary(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form")))
    chosen = spelling.near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    enough = -F.col("best.rank") >= spelling.ratio * F.col("n")
    near = store(chosen.select(
        F.col("word"), "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.rank")).alias("form_n"),
    ))
    ends = roots(near.where("form is not null"))
    return (
        vocabulary.select("word", "n").join(near, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
