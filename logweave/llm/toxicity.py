"""Toxicity scores from a weighted lexicon.

Texts are folded first: case, letters that only look Latin, and digits or signs that stand for letters. The lexicon is
learned from labelled texts: whole words and word beginnings (families of inflected or compounded forms) whose
log odds of standing in a toxic text are surely positive, and phrases around them that clean texts use,
which are exceptions. One Aho-Corasick automaton holds them all. The sum of the weights, also relative to the length,
goes through a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Batches, map_batches, rows_of, store

# Bounds of the learning step: labelled texts (a larger table is sampled by a hash down to about so many), lexicon entries, phrases.
LABELLED_ROWS = 200_000
MAX_TERMS, MAX_PHRASES = 5_000, 2_000
# Word beginnings that can become terms.
PREFIXES = range(4, 9)
# A term stands in at least so many toxic texts, its log odds exceed this by two standard errors, and the likelihood
# ratio against chance allows so many accidental terms among all candidates.
LEAST_TOXIC, LEAST_ODDS, ACCIDENTAL = 5, 1.5, 0.01
# A word beginning has to stand in so many times as many toxic texts as any longer form of it.
FAMILY = 1.5

# Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l", "ӏ": "l",
}
# Digits and signs inside words that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_WIDE = {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
_INVISIBLE = dict.fromkeys("​‌‍⁠﻿­", "")
_LOOKS = str.maketrans({**HOMOGLYPHS, **_WIDE, **_INVISIBLE})
_SUBSTITUTED = str.maketrans(SUBSTITUTES)
_FOREIGN = re.compile("[" + "".join([*HOMOGLYPHS, *_WIDE, *_INVISIBLE]) + "]")
_GAP = re.compile(r"[\W\d_]+")
_SIGN, _BLANK = re.compile(r"[0134578@$!|]"), re.compile(r"\s")
_RUN, _BLOCK = re.compile(r"[\w@$!|]+"), re.compile(r"[@$!|\d]+")
# A sign behind a letter and before more of the word; one that counts before letters.
_INSIDE, _BEFORE = re.compile(r"(?<=[^\W\d_])[0134578@$!|](?=[^\W_]|[@$])"), re.compile(r"[0134578@$]")


def _first_sign(run: str) -> int | None:
    """Place of the first sign of a run of letters, digits and signs that stands for a letter: one inside a word, or one
    of the signs and digits right before a letter. Every character is looked at a fixed number of times."""
    inside = _INSIDE.search(run)
    most = inside.start() if inside else len(run)
    for block in _BLOCK.finditer(run):
        if block.start() >= most:
            break
        behind = run[block.end() : block.end() + 1]
        if behind.isalnum() and not behind.isdecimal() and (sign := _BEFORE.search(run, block.start(), block.end())):
            return min(most, sign.start())
    return inside and most


def _spelled(match: re.Match) -> str:
    """A run with its signs as letters, from the word on in which the first of them stands."""
    run = match[0]
    at = _first_sign(run)
    if at is None:
        return run
    while at and run[at - 1].isalnum():
        at -= 1
    return run[:at] + run[at:].rstrip("!|").translate(_SUBSTITUTED)


def _unmasked(text: str) -> str:
    """Signs that stand for letters replaced, only in the words that have such signs."""
    out, at = [], 0
    for sign in _SIGN.finditer(text):
        k = sign.start()
        if k < at:
            continue
        start = max(text.rfind(" ", at, k), text.rfind("\n", at, k)) + 1 or at
        blank = _BLANK.search(text, k)
        end = blank.start() if blank else len(text)
        out += [text[at:start], _RUN.sub(_spelled, text[start:end])]
        at = end
    return "".join([*out, text[at:]]) if out else text


def fold(text: str | None) -> str:
    """The folded words of a text, each between blanks: ``' so many words '``."""
    text = (text or "").lower()
    if _FOREIGN.search(text):
        text = text.translate(_LOOKS)
    return f" {_GAP.sub(' ', _unmasked(text)).strip()} "


@dataclass
class Lexicon:
    """Terms with weights (``' word '`` or, for word beginnings, ``' begin'``), exception phrases, and the logistic curve."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), None))
        for term, weight in self.terms.items():
            automaton.add_word(term, (len(term), weight))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    def hits(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms outside exception phrases; of terms that begin together, the heaviest."""
        if not len(automaton):
            return []
        spans, found = [], {}
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spans.append((start, end))
            elif start not in found or found[start][1] < weight:
                found[start] = (end, weight)
        return [(s, e, w) for s, (e, w) in found.items() if not any(a <= s and e <= b + 1 for a, b in spans)]

    def features(self, automaton, folded: str) -> tuple[float, float, float]:
        """Of a folded text: sum of the weights, and the same by length, both damped; the number of terms."""
        hits = self.hits(automaton, folded)
        total, words = sum(w for _, _, w in hits), folded.count(" ")
        return math.log1p(total), math.log1p(100 * total / (20 + words)), math.log1p(len(hits))


def _folded(labelled: DataFrame) -> DataFrame:
    """``text, label`` with folded texts."""
    schema = pa.schema([("text", pa.string()), ("label", pa.int32())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield rows_of(schema, text=[fold(t) for t in batch.column(0).to_pylist()], label=batch.column(1))

    return map_batches(labelled, run, "text string, label int")


def _features(docs: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """``key`` and the three features of every folded text."""
    schema = pa.schema([(key, pa.int64()), *[(n, pa.float64()) for n in ("f0", "f1", "f2")]])

    def run(batches: Batches) -> Batches:
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([lexicon.features(automaton, t) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield rows_of(schema, **{key: batch.column(0)}, f0=x[:, 0], f1=x[:, 1], f2=x[:, 2])

    return map_batches(docs.select(F.col(key).cast("long").alias(key), "text"), run, f"`{key}` long, f0 double, f1 double, f2 double")


def _odds(p: int, n: int, toxic: int, clean: int) -> tuple[float, float]:
    """Log odds ratio of a term and its standard error."""
    odds = math.log((p + 0.5) / (toxic - p + 0.5)) - math.log((n + 0.5) / (clean - n + 0.5))
    return odds, math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))


def _likelihood(p: int, n: int, toxic: int, clean: int) -> float:
    """Log likelihood ratio of a term in ``p`` toxic and ``n`` clean texts against the share of toxic texts."""
    share = toxic / (toxic + clean)
    return p * math.log(p / ((p + n) * share)) + (n * math.log(n / ((p + n) * (1 - share))) if n else 0.0)


def _terms_of(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}


def _counts(texts: DataFrame, of_text) -> DataFrame:
    """``term, n``: in how many folded texts each term stands, added up within batches before the shuffle."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        pick = of_text()
        for batch in batches:
            found = Counter()
            for text in batch.column(0).to_pylist():
                found.update(pick(text))
            yield rows_of(schema, term=list(found), n=list(found.values()))

    return map_batches(texts.select("text"), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, least: int, most: int) -> dict[str, int]:
    """The most frequent terms, at most ``most``."""
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most).collect()
    return {r["term"]: r["n"] for r in rows}


def _beginnings(term: str) -> list[str]:
    """The shorter word beginnings of a term."""
    return [term[: k + 1] for k in PREFIXES if k + 1 < len(term.rstrip())] + ([term[:-1]] if term[-1] == " " else [])


def _select(candidates: dict[str, int], clean_counts: dict[str, int], toxic: int, clean: int, least: float) -> dict[str, float]:
    """The telling terms. A word beginning is one only where it unites a family of words: where far more toxic texts
    have it than have any single longer form. Longer forms go where such a beginning is about as telling."""
    sure = {}
    for term, p in candidates.items():
        n = clean_counts.get(term, 0)
        odds, error = _odds(p, n, toxic, clean)
        if odds - 2 * error > least and _likelihood(p, n, toxic, clean) > math.log(len(candidates) / ACCIDENTAL):
            sure[term] = odds - 2 * error
    longer: dict[str, int] = {}
    for term in candidates:
        for head in _beginnings(term):
            longer[head] = max(longer.get(head, 0), candidates[term])
    kept = {t for t in sure if t[-1] == " " or candidates[t] >= FAMILY * longer.get(t, 0)}
    chosen = {t: sure[t] for t in kept if not any(h in kept and sure[h] >= sure[t] - 1.0 for h in _beginnings(t))}
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:MAX_TERMS])


def _hit_terms(lexicon: Lexicon):
    """For a folded text: the terms that stand outside exception phrases."""
    automaton = lexicon.automaton()
    return lambda folded: {
        term for start, end, _ in lexicon.hits(automaton, folded)
        for term in (folded[start : end + 1],) if term in lexicon.terms
    }


def _phrases(lexicon: Lexicon):
    """For a folded text: the phrases of a term with the word before or after it."""
    automaton = lexicon.automaton()

    def of(folded: str) -> set[str]:
        out = set()
        for start, end, _ in lexicon.hits(automaton, folded):
            stop = folded.index(" ", end if folded[end] == " " and end > start else end)
            after = folded.find(" ", stop + 1)
            before = folded.rfind(" ", 0, start)
            if after > 0:
                out.add(folded[start : after + 1])
            if before >= 0:
                out.add(folded[before : stop + 1])
        return out

    return of


def learn(labelled: DataFrame, rows: int = LABELLED_ROWS) -> Lexicon:
    """A lexicon from ``text, label`` (0 or 1); rows with another label are skipped.

    The fit is bounded: a larger table is sampled by a hash of its texts to about ``rows``. Candidate
    terms are counted in Spark over all of these texts; the driver gets the few thousand that pass the
    thresholds, and three features and a label of each text for the logistic curve. Without toxic or
    without clean texts the lexicon is empty and scores are constant.
    """
    labelled = labelled.where("label in (0, 1)").select("text", F.col("label").cast("int").alias("label"))
    total = labelled.count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * rows / total))
    # Folded once; everything below reads these texts.
    labelled = store(_folded(labelled))
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    prior = math.log((toxic + 0.5) / (clean + 0.5))
    if not toxic or not clean:
        return Lexicon(curve=(prior, 0.0, 0.0, 0.0))
    positive, negative = labelled.where("label = 1"), labelled.where("label = 0")
    candidates = _top(_counts(positive, lambda: _terms_of), max(LEAST_TOXIC, toxic // 1000), 40 * MAX_TERMS)
    wanted = set(candidates)
    clean_counts = _top(_counts(negative, lambda: lambda folded: _terms_of(folded) & wanted), 1, 40 * MAX_TERMS)
    lexicon = Lexicon(_select(candidates, clean_counts, toxic, clean, 0.5 * LEAST_ODDS))
    # Phrases that clean texts use more surely than toxic ones.
    fine = _top(_counts(negative, lambda: _phrases(lexicon)), 3, MAX_PHRASES)
    if fine:
        known = set(fine)
        foul = _top(_counts(positive, lambda: lambda folded, of=_phrases(lexicon): of(folded) & known), 1, MAX_PHRASES)
        for phrase, n in fine.items():
            odds, error = _odds(foul.get(phrase, 0), n, toxic, clean)
            if odds + 2 * error < 0:
                lexicon.exceptions.add(phrase)
    # What is left of the terms outside these phrases decides.
    left = [_top(_counts(part, lambda: _hit_terms(lexicon)), 1, 2 * MAX_TERMS) for part in (positive, negative)]
    lexicon.terms = _select(left[0], left[1], toxic, clean, LEAST_ODDS)
    table = _features(labelled.withColumn("id", F.col("label")), lexicon, "id").collect()
    lexicon.curve = _logistic(np.array([tuple(r) for r in table]), prior)
    return lexicon


def _logistic(rows: np.ndarray, prior: float, steps: int = 60, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps: label first, then the features."""
    y, x = rows[:, 0], np.column_stack((np.ones(len(rows)), rows[:, 1:]))
    w = np.zeros(x.shape[1])
    w[0] = prior
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - keep @ w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on). Only ``text`` is read.

    A null or empty text has no hits and gets the score of a text without any. Repeated rows get equal scores; an empty
    table stays empty. Further columns are passed on; columns named ``score`` or ``predicted`` are replaced.
    """
    from logweave.llm.common import transform_text

    automata: list = []

    def rate(texts: list, _: dict) -> dict[str, list]:
        if not automata:
            automata.append(lexicon.automaton())
        x = np.array([lexicon.features(automata[0], fold(t)) for t in texts]).reshape(-1, 3)
        z = lexicon.curve[0] + x @ np.array(lexicon.curve[1:])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return transform_text(docs, {}, rate, {"score": "double", "predicted": "int"})


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """``text, label`` of the documents that may be learned from: ``crc32(doc_id) mod modulus`` is not ``held_out``.

    The labels are sampled to about ``rows`` first, so they are small enough for every task and the texts are not shuffled.
    """
    own = labels.where(f"doc_id is not null and `{label}` in (0, 1)").where(
        F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus != held_out
    ).select(F.col("doc_id").cast("long").alias("_label_doc"), F.col(label).cast("int").alias("label"))
    total = own.count()
    if total > rows:
        own = own.where(F.pmod(F.xxhash64("_label_doc"), F.lit(1_000_000)) < int(1_000_000 * rows / total))
    return docs.join(F.broadcast(own), F.col("doc_id") == F.col("_label_doc")).select("text", "label")
