"""Centroid clustering of quantised vectors by popcounts of bit planes.

A vector of 64 whole numbers is stored as its bit planes: plane i is one 64-bit word with bit i of every component, the top
plane being the sign (two's complement). The product of two vectors is then exact: the number of common bits of each two planes,
weighted by both planes' powers of two. Vectors are packed once; every round reads only the planes, and what leaves a task are
the sums of its clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Batches, map_batches, rows_of, store

DIM = 64
# Quantised components lie below 2**LIMIT_BITS in size, so that a squared distance is a 64-bit number.
LIMIT_BITS = 27
# Vectors worked on at a time.
ROWS = 4096


def plane_weights(planes: int) -> np.ndarray:
    """What a bit of each plane is worth; the last one is the sign."""
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def pack(values: np.ndarray) -> np.ndarray:
    """The bit planes (rows x planes) of whole numbers (rows x 64), as few planes as the largest one needs."""
    top = int(max(values.max(initial=0), ~values.min(initial=0)))
    shifts = np.arange(top.bit_length() + 1, dtype=np.int64)
    bits = (values[:, None, :] >> shifts[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2).view(np.uint64)[:, :, 0]


def unpack_bits(planes: np.ndarray) -> np.ndarray:
    """The bits (rows x planes x 64) of planes."""
    return np.unpackbits(np.ascontiguousarray(planes)[:, :, None].view(np.uint8), axis=2)


def products(planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The exact products (rows x others) of vectors given by their planes."""
    own, theirs = plane_weights(planes.shape[1]), plane_weights(others.shape[1])
    columns = np.ascontiguousarray(planes.T)
    out = np.zeros((len(planes), len(others)), np.int64)
    for k, other in enumerate(others):
        for i, column in enumerate(columns):
            found = np.zeros(len(planes), np.int64)
            for word, weight in zip(other, theirs):
                if word:
                    found += np.bitwise_count(column & word) * weight
            out[:, k] += own[i] * found
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """The exact squared length of each vector."""
    weights = plane_weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for i, one in enumerate(weights):
        for j, two in enumerate(weights):
            out += np.bitwise_count(planes[:, i] & planes[:, j]) * (one * two)
    return out


def nearest(planes: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smaller one among equals) and the squared distance to it."""
    packed = pack(centroids)
    distance = norms[:, None] - 2 * products(planes, packed) + squares(packed)[None, :]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(planes)), best]


def _read(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, planes and squared lengths of a few thousand stored vectors; fewer planes are filled up with the sign."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        lists = part.column(1)
        first = lists.offsets.to_numpy()
        length = np.diff(first)
        place = first[:-1, None] + np.minimum(np.arange(length.max()), length[:, None] - 1)
        yield part.column(0), lists.values.to_numpy().view(np.uint64)[place], part.column(2).to_numpy()


class Clustering:
    """Parameters: ``clusters`` centroids, ``rounds`` of moving them, components times ``scale`` rounded down, first centroids
    by the SHA-256 of ``salt`` and the id."""

    def __init__(self, clusters: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:"):
        self.clusters, self.rounds, self.scale, self.salt = clusters, rounds, scale, salt

    def packed(self, vectors: DataFrame, key: str, column: str) -> DataFrame:
        """``id, planes, norm`` of the usable vectors."""
        schema = pa.schema([("id", pa.int64()), ("planes", pa.list_(pa.int64())), ("norm", pa.int64())])
        scale = float(self.scale)

        def run(batches: Batches) -> Batches:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    length = part.column(1).value_lengths().fill_null(0).to_numpy()
                    part = part.take(pa.array(np.flatnonzero(length == DIM)))
                    # Null components become NaN here.
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)
                    good = np.isfinite(x).all(axis=1)
                    v = np.floor(scale * x[good])
                    if (np.abs(v) >= 2.0**LIMIT_BITS).any():
                        raise ValueError(f"a component times {self.scale} is not below 2**{LIMIT_BITS}: distances would overflow")
                    planes = pack(v.astype(np.int64))
                    ids = part.column(0).filter(pa.array(good))
                    yield rows_of(schema, id=ids, planes=list(planes.view(np.int64)), norm=squares(planes))

        chosen = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x"))
        return map_batches(chosen, run, "id long, planes array<bigint>, norm long")

    def first_centroids(self, packed: DataFrame) -> np.ndarray:
        """The vectors with the smallest hashes, in the order of the hashes; at most ``clusters`` rows leave the tasks."""
        text = F.concat(F.lit(self.salt), F.coalesce(F.col("id").cast("string"), F.lit("")))
        order = packed.select(F.sha2(text.cast("binary"), 256).alias("hash"), "planes").orderBy("hash", "planes")
        found = [np.array(r["planes"], np.int64).view(np.uint64)[None] for r in order.limit(self.clusters).collect()]
        return np.array([plane_weights(p.shape[1]) @ unpack_bits(p)[0].astype(np.int64) for p in found]).reshape(-1, DIM)

    def moved(self, packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """The centroids after one round: the exact means of their vectors, rounded down."""
        schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

        def run(batches: Batches) -> Batches:
            n = np.zeros(len(centroids), np.int64)
            sums = np.zeros((len(centroids), DIM), np.int64)
            for batch in batches:
                for _, planes, norms in _read(batch):
                    best, _ = nearest(planes, norms, centroids)
                    member = (best[None, :] == np.arange(len(centroids))[:, None]).astype(np.float32)
                    # Bits of each place and plane counted by cluster: whole numbers below 2**24, exact in single precision.
                    counts = member @ unpack_bits(planes).reshape(len(planes), -1).astype(np.float32)
                    counts = counts.astype(np.int64).reshape(len(centroids), -1, DIM)
                    sums += np.einsum("p,cpd->cd", plane_weights(planes.shape[1]), counts)
                    n += member.sum(axis=1).astype(np.int64)
            some = np.flatnonzero(n)
            yield rows_of(schema, cluster=some.astype(np.int32), n=n[some], sums=list(sums[some]))

        parts = map_batches(packed.select("id", "planes", "norm"), run, "cluster int, n long, sums array<bigint>")
        # One row per task and cluster; they are added up by component, and only clusters x 64 sums reach the driver.
        added = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "x")).groupBy("cluster", "dim").agg(
            F.sum("n").alias("n"), F.sum("x").alias("x"))
        after = centroids.copy()
        for row in added.collect():
            after[row["cluster"], row["dim"]] = row["x"] // row["n"]
        return after

    def inertia(self, packed: DataFrame, centroids: np.ndarray) -> dict[int, int]:
        """The distances added up by cluster."""
        schema = pa.schema([("cluster", pa.int32()), ("total", pa.decimal128(38, 0))])

        def run(batches: Batches) -> Batches:
            total = [0] * len(centroids)
            for batch in batches:
                for _, planes, norms in _read(batch):
                    best, distance = nearest(planes, norms, centroids)
                    for k in range(len(centroids)):
                        total[k] += sum(distance[best == k].tolist())
            yield rows_of(schema, cluster=range(len(centroids)), total=[Decimal(t) for t in total])

        parts = map_batches(packed.select("id", "planes", "norm"), run, "cluster int, total decimal(38,0)")
        return {r["cluster"]: int(r["total"]) for r in parts.groupBy("cluster").agg(F.sum("total").alias("total")).collect()}


def cluster_vectors(
    vectors: DataFrame, clustering: Clustering | None = None, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Only vectors with exactly 64 components take part, none of them null or not finite; null, shorter and longer ones are
    left out. ``distance`` is the squared distance to the centroid, ``cluster_inertia`` and ``inertia`` add it up over the
    cluster and over all; ``centroid_sha256`` is that of the centroid's components, joined by commas.

    Odd rows: of fewer vectors than clusters, each is a first centroid. Rows that repeat an id are vectors of their own, and
    among equal hashes the planes decide; a null id is hashed as empty text. Of equal centroids the first gets all vectors, the
    others stay as they are. An empty table gives an empty result. Components from 2**17 on are refused, since distances would
    overflow. Other columns are not read.
    """
    clustering = clustering or Clustering()
    packed = store(clustering.packed(vectors, key, column))
    centroids = clustering.first_centroids(packed)
    if len(centroids):
        for _ in range(clustering.rounds):
            after = clustering.moved(packed, centroids)
            if (after == centroids).all():
                # A fixed point: no further round changes anything.
                break
            centroids = after
    inertia = clustering.inertia(packed, centroids) if len(centroids) else {}
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    schema = pa.schema([
        (key, pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()),
        ("inertia", pa.int64()), ("centroid_sha256", pa.string()),
    ])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for ids, planes, norms in _read(batch):
                best, distance = nearest(planes, norms, centroids)
                yield rows_of(schema, **{key: ids}, cluster=best.astype(np.int32), distance=distance,
                              cluster_inertia=[inertia[int(k)] for k in best], inertia=[total] * len(best),
                              centroid_sha256=[digests[k] for k in best])

    made = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return map_batches(packed.select("id", "planes", "norm"), run, made)
