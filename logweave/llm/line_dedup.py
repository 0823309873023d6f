"""Removal of lines that an earlier document already has.

Two Bloom filters over all line keys find the suspects: the first holds keys that were seen once, the second keys
that were seen again. Both are cut into segments of fixed size by the key's hash, and filled from what each task
has combined beforehand. Only lines that the second filter knows go on to the exact comparison, which also
chooses the document that keeps the line.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Batches, map_batches, rows_of, store, transform_text

BLANKS = b" \t\n\x0b\x0c\r"
# Keys a filter segment is made for, and its bits; three probes then let about one unrepeated key in 200 pass.
SEGMENT_KEYS, SEGMENT_BITS, PROBES = 1 << 14, 1 << 18, 3
_PROBE_BITS = 18


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """The key of every line of a text; None for lines whose key has under ``least`` code points. No text is one empty line."""
    keys: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(BLANKS).lower()  # of bytes: A-Z only
        keys.append(key if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least) else None)
    return keys


def _digests(keys: list[bytes | None]) -> list[bytes | None]:
    return [None if k is None else hashlib.sha256(k).digest() for k in keys]


def _document_keys(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, h1, h2, digest``: the distinct keys of each document, as SHA-256 and two hashes taken from it."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("digest", pa.binary())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {d for d in _digests(line_keys(text, least)) if d is not None}
                digests.extend(own)
                ids.extend([doc] * len(own))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 4)
            yield rows_of(schema, doc_id=ids, h1=h[:, 0], h2=h[:, 1], digest=digests)

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return map_batches(known, run, "doc_id long, h1 long, h2 long, digest binary")


def _probes(h2: np.ndarray) -> np.ndarray:
    """Bits of a segment that stand for each key."""
    h = h2.astype(np.uint64)
    return np.stack([(h >> np.uint64(_PROBE_BITS * j)) & np.uint64(SEGMENT_BITS - 1) for j in range(PROBES)], axis=1).astype(np.int64)


def _marks(keys: DataFrame, segments: int) -> DataFrame:
    """``segment, once, again``: the distinct keys of each task, split by whether the task saw them once or more often."""
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])

    def run(batches: Batches) -> Batches:
        seen = [np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())) for b in batches]
        if not seen:
            return
        h1, h2 = np.concatenate(seen, axis=1)
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        first = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
        count = np.diff(np.append(first, len(h1)))
        segment, h2 = h1[first] % segments, h2[first]
        order = np.argsort(segment, kind="stable")
        segment, h2, count = segment[order], h2[order], count[order]
        at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        parts = list(zip(np.split(h2, at[1:]), np.split(count, at[1:])))
        yield rows_of(
            schema, segment=segment[at].astype(np.int32),
            once=[h[n == 1].tobytes() for h, n in parts], again=[h[n > 1].tobytes() for h, n in parts],
        )

    return map_batches(keys.select("h1", "h2"), run, "segment int, once binary, again binary")


def _twice_seen(rows: pd.DataFrame) -> pd.DataFrame:
    """The second filter of one segment, as 64-bit words."""
    seen, again = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for once, twice in zip(rows["once"], rows["again"]):
        more = _probes(np.frombuffer(twice, "<i8"))
        seen[more] = again[more] = True
        new = _probes(np.frombuffer(once, "<i8"))
        again[new[seen[new].all(axis=1)]] = True
        seen[new] = True
    words = np.packbits(again, bitorder="little").view("<i8")
    return pd.DataFrame({"segment": rows["segment"].iloc[:1].to_numpy(), "bits": [words]})


def suspects(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (``doc_id, h1, h2, digest``) whose key is probably in several rows; none that is goes missing."""
    segments = max(1, -(-keys.count() // SEGMENT_KEYS))
    filters = store(_marks(keys, segments).groupBy("segment").applyInPandas(_twice_seen, "segment int, bits array<bigint>"))
    bit = [F.shiftrightunsigned("h2", _PROBE_BITS * j).bitwiseAND(SEGMENT_BITS - 1).cast("int") for j in range(PROBES)]
    known = [F.getbit(F.col("bits")[F.shiftright(p, 6)], p.bitwiseAND(63)) == 1 for p in bit]
    match = F.pmod("h1", F.lit(segments)).cast("int") == F.col("segment")
    for condition in known:
        match = match & condition
    return keys.join(filters, match).select("doc_id", "digest")


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``docs`` without the repeated lines: ``text`` is replaced, ``n_lines`` and ``n_dropped`` (long) are added.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. A key of at least ``least``
    code points that several documents have loses all its lines but those in the document with the smallest
    ``doc_id``. Keys are compared by their SHA-256. The other lines stay, joined by line feeds.

    Nulls and odd rows: a null or empty text is one empty line and comes back empty. Rows that share a ``doc_id`` are
    one document. Rows with a null ``doc_id`` are returned whole and are not counted as a document. An empty
    table gives an empty result. Further columns are passed on; columns named ``n_lines`` or ``n_dropped`` are
    replaced.
    """
    keys = store(_document_keys(docs, least))
    found = store(suspects(keys))
    first = store(
        found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc").select("digest", "first_doc")
    )
    drops = (
        found.join(first, "digest").where("doc_id > first_doc")
        .groupBy("doc_id").agg(F.collect_set("digest").alias("_dropped_keys"))
    )
    joined = docs.drop("_dropped_keys").join(drops.withColumnRenamed("doc_id", "_drop_doc"), F.col("doc_id") == F.col("_drop_doc"), "left")

    def keep(texts: list, more: dict[str, list]) -> dict[str, list]:
        kept, total, gone = [], [], []
        for text, dropped in zip(texts, more["dropped"]):
            lines = (text or "").split("\n")
            if dropped:
                dropped = set(dropped)
                digests = _digests(line_keys(text, least))
                stay = [line for line, d in zip(lines, digests) if d not in dropped]
            else:
                stay = lines
            kept.append("\n".join(stay))
            total.append(len(lines))
            gone.append(len(lines) - len(stay))
        return {"text": kept, "n_lines": total, "n_dropped": gone}

    return transform_text(
        joined, {"dropped": "_dropped_keys", "doc": "_drop_doc"}, keep, {"n_lines": "bigint", "n_dropped": "bigint"}
    )
