"""A quality classifier: generalised additive model with pairwise interactions.

Boosting goes round the features one after the other and grows a shallow tree on the bins of a single one each
time, so that the sum of its trees is a lookup table per feature. The pairs of features that explain most of
what is left get two-dimensional tables the same way. Scoring is adding up table entries for whole batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import shingles
from logweave.llm.common import Batches, map_batches, rows_of, transform_text

# Bound of the fit: a larger labelled table is sampled by a hash down to about so many texts.
FIT_ROWS = 60_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1

FEATURES = (
    "log_words", "word_length", "upper_share", "symbol_share", "digit_share", "bang_share", "pipe_share", "distinct_words",
    "same_as_previous", "repeated_runs", "log_lines", "repeated_lines", "words_per_line", "short_words", "sentence_words", "long_word",
)


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_UPPER, _DIGIT = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"0123456789")
_SYMBOL, _BANG, _PIPE, _STOP = _class(b"#*$%&<>{}[]~^=\\"), _class(b"!"), _class(b"|"), _class(b".?!")


def _distinct(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct values in each group."""
    values, start, owner = shingles.grouped(values, group)
    out = np.zeros(groups)
    out[owner] = np.diff(np.append(start, len(values)))
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zero for texts without words."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, last, data, limits, words in shingles.chunks(texts):
        n = last - first
        begin = np.concatenate(([0], limits[:-1] + 1))
        count = lambda flag: np.add.reduceat(flag.astype(np.int64), begin)
        size = np.maximum(limits - begin, 1)
        n_words = np.bincount(words.text, minlength=n)
        length = words.end - words.start
        has = np.maximum(n_words, 1)
        per_text = lambda weight: np.bincount(words.text, weights=weight, minlength=n)
        distinct = _distinct(words.hash, words.text, n)
        same = np.zeros(len(words.hash), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
        runs, run_text = shingles.shingle_hashes(words.hash, words.text, 8)
        all_runs = np.bincount(run_text, minlength=n)
        ends = np.flatnonzero(data == 10)
        line = np.searchsorted(ends, words.start)
        place = np.arange(len(line)) - np.searchsorted(line, line)
        line_hash = np.zeros(len(ends), np.uint64)
        np.add.at(line_hash, line, words.hash * (2 * place.astype(np.uint64) + np.uint64(1)))
        full = np.flatnonzero(np.bincount(line, minlength=len(ends)) > 0)
        line_text = np.searchsorted(limits, ends[full])
        n_lines = np.bincount(line_text, minlength=n)
        longest = np.zeros(n)
        np.maximum.at(longest, words.text, length)
        block = np.column_stack((
            np.log1p(n_words), per_text(length) / has, count(_UPPER[data]) / size, count(_SYMBOL[data]) / size,
            count(_DIGIT[data]) / size, count(_BANG[data]) / size, count(_PIPE[data]) / size, distinct / has,
            per_text(same) / has, (all_runs - _distinct(runs, run_text, n)) / np.maximum(all_runs, 1), np.log1p(n_lines),
            1 - _distinct(line_hash[full], line_text, n) / np.maximum(n_lines, 1), n_words / np.maximum(n_lines, 1), per_text(length <= 3) / has,
            n_words / (1 + count(_STOP[data])), np.log1p(longest),
        ))
        block[n_words == 0] = 0
        out[first:last] = block
    return out


def _tree(gain: np.ndarray, weight: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """The values of a tree with few leaves over ordered bins, from sums of gradients and of second derivatives."""
    cuts = [0, len(gain)]
    g, h = np.concatenate(([0], np.cumsum(gain))), np.concatenate(([0], np.cumsum(weight)))
    part = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                score = part(a, at) + part(at, b) - part(a, b)
                k = int(np.argmax(score))
                best = max(best, (float(score[k]), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gain))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _pair_tree(gain: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best split into four quadrants of a two-dimensional table, and how much it explains."""
    g = np.pad(gain.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(weight.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n, m = gain.shape
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]

    def boxes(t):
        a = t[i, j]
        b = t[i, m] - a
        c = t[n, j] - a
        return a, b, c, t[n, m] - a - b - c

    score = sum(x * x / (y + ridge) for x, y in zip(boxes(g), boxes(h)))
    at = np.unravel_index(int(np.argmax(score)), score.shape)
    value = [float((x / (y + ridge))[at]) for x, y in zip(boxes(g), boxes(h))]
    out = np.empty_like(gain, dtype=float)
    p, q = at[0] + 1, at[1] + 1
    out[:p, :q], out[:p, q:], out[p:, :q], out[p:, q:] = value
    return out, float(score[at])


@dataclass
class AdditiveModel:
    """Bin edges and a table of log odds per feature; per pair its features and a two-dimensional table."""

    base: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]).astype(np.int64)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if not self.edges or not len(x):
            return z
        b = self.bins(x)
        for k, table in enumerate(self.tables):
            z += table[b[:, k]]
        for i, j, table in self.pairs:
            z += table[b[:, i] * PAIR_BINS // BINS, b[:, j] * PAIR_BINS // BINS]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on labelled feature rows. One class only, or no row, gives a constant model."""
    y = np.asarray(y, float)
    model = AdditiveModel(base=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.edges]
    z = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, k], g, BINS), np.bincount(b[:, k], h, BINS))
            table += step
            z += step[b[:, k]]
    coarse = b * PAIR_BINS // BINS
    g, h = slopes()
    square = lambda i, j, v: np.bincount(coarse[:, i] * PAIR_BINS + coarse[:, j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    rated = sorted(((_pair_tree(square(i, j, g), square(i, j, h))[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in rated[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(square(i, j, g), square(i, j, h))[0]
            table += step
            z += step[coarse[:, i], coarse[:, j]]
    return model


def learn(labelled: DataFrame) -> AdditiveModel:
    """Fit on ``text, label`` (0 or 1), about ``FIT_ROWS`` rows at most; the driver gets features and labels, no texts."""
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield rows_of(schema, label=batch.column(1), x=list(features(batch.column(0).to_pylist())))

    found = map_batches(labelled.select("text", F.col("label").cast("int").alias("label")), run, "label int, x array<double>").collect()
    # The order of the rows must not matter for the sums.
    found.sort(key=lambda r: (r["x"], r["label"]))
    return fit(np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in found]))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from 0.5 on). Only ``text`` is read.

    A null or empty text has zero features and gets their score. Repeated rows get equal scores; an empty table stays empty.
    Further columns are passed on; columns named ``score`` or ``predicted`` are replaced.
    """

    def rate(texts: list, _: dict) -> dict[str, list]:
        p = model.probability(features(texts))
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return transform_text(docs, {}, rate, {"score": "double", "predicted": "int"})
