"""Packing of documents into training sequences, neighbours by BM25 next to each other.

The token ids of every document are stored once. Documents are dealt into ranges of their most telling tokens, so
that related ones meet, and every range is cut into shards of bounded size. Each shard builds an inverted index of
token ids. A seed document opens a window, its best unused neighbours by BM25 fill it, and the document that does not
fit any more is cut: its rest opens the next window. Token statistics come from all documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Batches, map_batches, rows_of
from logweave.runtime import materialize

WINDOW = 4096
END_ID = 2
# Tokens of a shard's documents: bounds the index of one task. A longer document is a shard of its own.
SHARD_TOKENS = 2_000_000
# Tokens of a seed that are looked up.
QUERY_TOKENS = 16
K1, B = 1.2, 0.75
# Entries of each of the two halves of a worker's cache of words, and of texts between blanks.
CACHE_ENTRIES = 500_000


class _Cache(dict):
    """Least recently used entries in two halves: a full half becomes the old one, and what is used moves on."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.old.get(key) or self.make(key)
        if len(self) > CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        return value


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next beyond 255."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in itself else chr(next(others)) for b in range(256)]


class Encoder:
    """Token ids exactly as ``tokenizers`` gives them for a file of the word-end BPE kind, from a cache of words.

    Texts of plain Latin characters are cut at blanks and into words, and only words not seen before go through
    the library's model. Other texts, and those that may hold a special token's string, go through it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(_byte_letters()))
        # Below U+0250 nothing combines, and controls that only some libraries call blanks are left out.
        plain = [
            chr(i) for i in range(0x250)
            if not 0x1C <= i <= 0x1F and i not in (0x85, 0xA0) and all(ord(c) < 0x250 for c in chr(i).lower())
        ]
        kind = {"L": "", "N": ""}
        for c in plain:
            if (k := unicodedata.category(c)[0]) in kind:
                kind[k] += c
        group = {k: re.escape(v) for k, v in kind.items()}
        # Fixed value: how this tokenizer cuts words.
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{group['L']}]+|[{group['N']}]|[^\s{group['L']}{group['N']}]+").findall
        self.odd = re.compile("[^" + re.escape("".join(plain)) + "]").search
        self.words = _Cache(self._word)
        self.chunks = _Cache(self._chunk)

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.words[chunk]
        if chunk[-1] in ",." and chunk[:-1].isalpha():
            return self.words[chunk[:-1]] + self.words[chunk[-1]]
        return b"".join(map(self.words.__getitem__, self.cut(chunk)))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text as 32-bit integers; none for a null text."""
        if not text:
            return np.empty(0, np.uint32)
        if self.odd(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.lower().split())), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str | Callable[[], str]) -> Encoder:
    """One encoder per worker and file; a function names the file where the task runs."""
    path = tokenizer if isinstance(tokenizer, str) else tokenizer()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: the ids of every document, with ``end_id`` behind them, as little-endian 16-bit or 32-bit integers.

    The first byte of ``ids`` is 2 or 4, the width.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Batches:
        tool = encoder(tokenizer)
        for batch in batches:
            packed = []
            for text in batch.column(1).to_pylist():
                ids = np.append(tool.encode(text), np.uint32(end_id))
                packed.append(b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes())
            yield rows_of(schema, doc_id=batch.column(0), ids=packed)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids binary")


def packed_ids(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1)


def unpacked(ids: bytes) -> np.ndarray:
    return packed_ids(ids).astype(np.uint32)


def _document_counts(stored: DataFrame) -> DataFrame:
    """``token, n``: in how many documents each token stands. No longer than the tokenizer's vocabulary."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            own = []
            for ids in batch.column(0).to_pylist():
                ids = np.sort(packed_ids(ids), kind="stable")
                own.append(ids[np.concatenate(([True], ids[1:] != ids[:-1]))])
            found = np.bincount(np.concatenate(own)) if own else total[:0]
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[: len(found)] += found
        token = np.flatnonzero(total)
        yield rows_of(schema, token=token, n=total[token])

    return map_batches(stored.select("ids"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class _Shard:
    """Inverted index of a list of documents' ids."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, average: float):
        size = np.array([len(x) for x in ids])
        width = np.int64(len(idf))
        pairs = np.concatenate(ids).astype(np.int64)
        pairs += np.repeat(np.arange(len(ids)) * width, size)
        pairs.sort()
        new = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        tf = np.diff(np.append(new, len(pairs)))
        doc, token = np.divmod(pairs[new], width)
        weight = (idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / average))).astype(np.float32)
        # The most telling tokens of each document are its query.
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.query = []
        for a, b in zip(first, first[1:]):
            own = weight[a:b]
            top = np.argpartition(-own, QUERY_TOKENS - 1)[:QUERY_TOKENS] if b - a > QUERY_TOKENS else slice(None)
            self.query.append(token[a:b][top])
        order = np.argsort(token.astype(np.uint16 if width <= 1 << 16 else np.int64), kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(token[order], np.arange(width + 1))
        self.count = len(ids)

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents with a score, the best first; among equals the earlier one."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query[seed]]
        doc = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(doc, np.concatenate([self.weight[s] for s in spans]), self.count)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


def _placement(shard: _Shard, room: int, window: int, sizes: np.ndarray):
    """The order in which documents of a shard follow each other: seeds, and the neighbours that fill their windows."""
    used = np.zeros(shard.count, bool)
    seed, free = -1, room
    for start in range(shard.count):
        if used[start]:
            continue
        used[start] = True
        yield start
        seed, free = start, (free - sizes[start]) % window
        # Neighbours until the window is full; the one that is cut is the seed of the next window.
        while free:
            full = False
            for near in shard.neighbours(seed, used):
                used[near] = True
                yield int(near)
                left = free - sizes[near]
                if left <= 0:
                    seed, free, full = int(near), left % window, True
                    break
                free = left
            if not full:
                break


_PIECE = pa.schema([
    (n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
] + [("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Sequences:
    """Cuts the stream of a task's documents into full windows; the rest of the last one into powers of two."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id, self.fill = window, first_id, 0
        self.open: list[list] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[list]:
        """Place a document; the pieces of the windows that got full."""
        done: list[list] = []
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.window - self.fill)
            self.open.append([doc_id, at, ids[at : at + n], len(ids), self.next_id, self.fill])
            at, self.fill = at + n, self.fill + n
            if self.fill == self.window:
                done += self.open
                self.open, self.fill, self.next_id = [], 0, self.next_id + 1
        return done

    def close(self) -> list[list]:
        """The pieces of the last window: sequences whose lengths are powers of two need no padding."""
        done: list[list] = []
        limit, fill = 0, 0
        for doc_id, start, ids, total, _, _ in self.open:
            at = 0
            while at < len(ids):
                if fill == limit:
                    left = self.fill - sum(len(p[2]) for p in done)
                    limit, fill = 1 << (left.bit_length() - 1), 0
                    self.next_id += 1
                n = min(len(ids) - at, limit - fill)
                done.append([doc_id, start + at, ids[at : at + n], total, self.next_id, fill])
                at, fill = at + n, fill + n
        self.open, self.fill = [], 0
        return done


def _piece_rows(pieces: list[list], with_ids: bool) -> pa.RecordBatch:
    data = [p[2].astype("<u4").tobytes() for p in pieces]
    return rows_of(
        _PIECE, doc_id=[p[0] for p in pieces], start=[p[1] for p in pieces], length=[len(p[2]) for p in pieces],
        ids_crc32=[zlib.crc32(d) for d in data], doc_tokens=[p[3] for p in pieces], sequence_id=[p[4] for p in pieces],
        offset=[p[5] for p in pieces], ids=data if with_ids else [None] * len(pieces),
    )


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of token sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``start`` counts the document's ids before the piece, ``offset`` those of the sequence before it, ``ids_crc32`` is the
    CRC-32 of the piece's ids as little-endian 32-bit integers, ``doc_tokens`` the document's ids with the
    end id. ``ids`` (those integers) is null with ``with_ids=False``. Every id lies in exactly one piece. All sequences
    are full windows but the last ones of each task, whose lengths are powers of two.

    Nulls and odd rows: a null or empty text is the end id alone. Rows that repeat a ``doc_id``, or have none, are packed
    each. An empty table gives an empty result. Columns besides ``doc_id`` and ``text`` are not read.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    # Token ids hardly get smaller by a slow codec.
    stored = materialize(token_ids(docs, tokenizer, end_id))
    # One row per token of the vocabulary: bounded by the tokenizer, whatever the number of documents.
    counts = {r["token"]: r["n"] for r in _document_counts(stored).collect()}
    shape = stored.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids").cast("long"))).first()
    n_docs, average = shape[0], max(1.0, (shape[1] or 0) / 2 / max(shape[0], 1))
    idf = np.zeros(max([0, *counts]) + 1)
    for token, n in counts.items():
        idf[token] = np.log(1 + (n_docs - n + 0.5) / (n + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    # Tokens that a range of documents can share: not those of a few documents only.
    telling = np.zeros(len(idf))
    for token, n in counts.items():
        if n >= max(2, n_docs // 2000):
            telling[token] = idf[token]
    telling_shared = docs.sparkSession.sparkContext.broadcast(telling)

    def key(batches: Batches) -> Batches:
        """The two rarest of a document's telling tokens."""
        schema = pa.schema([("near", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            near = []
            for ids in batch.column(1).to_pylist():
                ids = unpacked(ids)
                weight = telling_shared.value[ids]
                one = ids[np.argmax(weight)]
                weight[ids == one] = 0
                near.append(int(one) << 32 | int(ids[np.argmax(weight)]))
            yield rows_of(schema, near=near, doc_id=batch.column(0), ids=batch.column(1))

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        out = _Sequences(window, TaskContext.get().partitionId() << 36)
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            shard = _Shard([x for _, x in held], shared.value, average)
            sizes = np.array([len(x) for _, x in held])
            pieces: list[list] = []
            for k in _placement(shard, (window - out.fill) % window, window, sizes):
                pieces += out.add(*held[k])
            return _piece_rows(pieces, with_ids)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = unpacked(ids)
                if held and tokens + len(ids) > SHARD_TOKENS:
                    yield packed()
                    held, tokens = [], 0
                held.append((doc, ids))
                tokens += len(ids)
        if held:
            yield packed()
        yield _piece_rows(out.close(), with_ids)

    keyed = map_batches(stored, key, "near long, doc_id long, ids binary")
    dealt = keyed.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id").select("doc_id", "ids")
    return map_batches(dealt, run, PIECES)
