"""Words, shingles and MinHash signatures of many texts at once, as numpy operations on their bytes.

Texts are handled in chunks of about ``CHUNK_BYTES``, so memory does not grow with the batch or the table.
A single longer text is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 18
# Odd multipliers of the word hash, the shingle hash and the MinHash functions.
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_BASE = np.uint64(0xD1342543DE82EF95)

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
BLANK = np.isin(_bytes, [32, 9, 10, 11, 12, 13])
# Everything in ASCII that is neither a letter nor a digit.
NOT_ALPHANUMERIC = (_bytes < 128) & ~np.isin(LOWER, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(WORD_BASE, 1024)


class Words:
    """Word hashes of a chunk: ``hash``, ``start`` and ``end`` byte of each, and ``text``, the place of its text in the chunk."""

    def __init__(self, data: np.ndarray, limits: np.ndarray, separators: np.ndarray):
        """``limits``: the end of each text in ``data``; a separator byte follows every text."""
        gap = separators[data]
        gap[limits] = True
        inside = ~gap
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        length = self.end - self.start
        global _POWERS
        if len(length) and length.max() > len(_POWERS):
            _POWERS = _powers(WORD_BASE, int(length.max()) * 2)
        letters = np.flatnonzero(inside)
        place = letters - np.repeat(self.start, length)
        value = (LOWER[data[letters]].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
        first = np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64) if len(length) else np.empty(0, np.int64)
        self.hash = mixed(np.add.reduceat(value, first)) if len(length) else np.empty(0, np.uint64)
        self.text = np.searchsorted(limits, self.start, side="right")


def chunks(texts: list[str | None], separators: np.ndarray = BLANK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """``(first, last, data, limits, words)`` for runs of texts; a null text is empty."""
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (not parts or size + len(texts[at] or "") <= CHUNK_BYTES):
            parts.append((texts[at] or "").encode())
            size += len(parts[-1]) + 1
            at += 1
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        limits = np.cumsum([len(p) + 1 for p in parts]) - 1
        yield first, at, data, limits, Words(data, limits, separators)


def shingle_hashes(words: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and group of every run of ``width`` words that lies in one group; groups ascend."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value = value * SHINGLE_BASE + words[j : j + n]
    whole = group[:n] == group[width - 1 :]
    return mixed(value[whole]), group[:n][whole]


def grouped(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each group, sorted: values, where each group starts, and the groups that have any."""
    if not len(values):
        return values, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    new = np.concatenate(([True], (values[1:] != values[:-1]) | (group[1:] != group[:-1])))
    values, group = values[new], group[new]
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return values, start, group[start]


def text_shingles(texts: list[str | None], width: int, separators: np.ndarray = BLANK, short: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with some words, but fewer than ``width``, has one shingle of all of them (none with ``short=False``).
    """
    out = [np.empty(0, np.uint64)] * len(texts)
    for first, last, _, _, words in chunks(texts, separators):
        values, group = all_shingles(words, last - first, width, short)
        values, start, owner = grouped(values, group)
        for g, part in zip(owner, np.split(values, start[1:]) if len(start) else []):
            out[first + g] = part
    return out


def all_shingles(words: Words, texts: int, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their text, with the rule of ``text_shingles`` for short texts; texts ascend."""
    values, group = shingle_hashes(words.hash, words.text, width)
    if short:
        count = np.bincount(words.text, minlength=texts)
        few = np.flatnonzero((count > 0) & (count < width))
        if len(few):
            first = np.searchsorted(words.text, few)
            extra = []
            for t, at in zip(few, first):
                value = int(count[t])
                for h in words.hash[at : at + count[t]]:
                    value = (value * int(SHINGLE_BASE) + int(h)) % (1 << 64)
                extra.append(value)
            values = np.concatenate((values, mixed(np.array(extra, np.uint64))))
            group = np.concatenate((group, few))
            order = np.argsort(group, kind="stable")
            values, group = values[order], group[order]
    return values, group


class MinHash:
    """``size`` MinHash functions; signatures are 32-bit values."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.RandomState(seed)
        self.size = size
        self.a = (rng.randint(0, 1 << 31, size).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.randint(0, 1 << 31, size).astype(np.uint32)

    def signatures(self, values: np.ndarray, start: np.ndarray) -> np.ndarray:
        """One row per run of ``values`` that begins at ``start``."""
        x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
        out = np.empty((len(start), self.size), np.uint32)
        if not len(start):
            return out
        for k in range(self.size):
            y = x * self.a[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y += self.b[k]
            out[:, k] = np.minimum.reduceat(y, start)
        return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A hash of every ``rows`` columns of MinHash values and of their place; columns that are left over are not used."""
    bands = signatures.shape[1] // rows
    hashed = np.tile(np.arange(bands, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        hashed = mixed(hashed * SHINGLE_BASE ^ signatures[:, r : bands * rows : rows].astype(np.uint64))
    return hashed.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
