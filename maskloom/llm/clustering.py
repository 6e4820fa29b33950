"""Clustering of vectors around centroids, nearest ones found by progressive search over Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskloom.llm.common import stored

#: Components of a vector, what they are multiplied by before rounding down, centroids and rounds.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Ends of the groups of coefficients, coarse to fine.
GROUPS = (4, 16, 32, 64)
#: Largest rounded component for which a squared distance fits 64 bits, and for which its 64-fold does.
LARGEST, LARGEST_FAST = 1 << 27, 1 << 24
#: Vectors that are compared at a time.
ROWS = 8192


# --- Transform and search -----------------------------------------------------------

def walsh(vectors: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, not scaled and so exact, coefficients by their number of sign changes.

    Squared distances of transforms are DIMS times those of the vectors.
    """
    out = vectors.copy()
    width = 1
    while width < DIMS:
        pairs = out.reshape(len(out), DIMS // (2 * width), 2, width)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(-1, DIMS)
        width *= 2
    return out[:, by_sign_changes()]


def by_sign_changes() -> np.ndarray:
    """The order of Hadamard rows by their sign changes: row r's entry at c is the parity of the bits of r & c."""
    r = np.arange(DIMS)
    signs = np.bitwise_count(r[:, None] & r[None, :]) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each transformed vector, ties to the smaller number.

    Differences are added up group by group, coarse to fine. The centroid that is nearest in the coarsest groups is
    finished first: its distance is a bound, and a centroid whose sum so far is larger is strictly worse and
    dropped. All that are left in the end have a sum over all coefficients.
    """
    n, k = len(vectors), len(centroids)
    sums = np.zeros((n, k), vectors.dtype)

    def add(rows: np.ndarray, columns: np.ndarray, a: int, b: int) -> None:
        step = vectors[rows, a:b] - centroids[columns, a:b]
        sums[rows, columns] += (step * step).sum(axis=1)

    first = GROUPS[0]
    for c in range(k):
        step = vectors[:, :first] - centroids[c, :first]
        sums[:, c] = (step * step).sum(axis=1)
    every, leader = np.arange(n), sums.argmin(axis=1)
    add(every, leader, first, DIMS)
    bound = sums[every, leader].copy()
    open_ = sums <= bound[:, None]
    open_[every, leader] = False
    for a, b in zip(GROUPS, GROUPS[1:]):
        rows, columns = np.nonzero(open_)
        add(rows, columns, a, b)
        open_[rows, columns] = sums[rows, columns] <= bound[rows]
    finished = open_
    finished[every, leader] = True
    best = np.where(finished, sums, sums[every, leader][:, None]).min(axis=1)
    number = (finished & (sums == best[:, None])).argmax(axis=1)
    return number, best // DIMS


# --- Vectors ----------------------------------------------------------------------

def kept(vectors: DataFrame) -> DataFrame:
    """vec_id and q, the rounded components, of all vectors with DIMS components, none of them null or not finite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = (F.size("embedding") == DIMS) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(usable)
    too_large = F.exists(x, lambda c: F.abs(c) > LARGEST / SCALE)
    return found.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.when(too_large, F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}: squared distances "
                                                              "would not fit 64 bits")))
                        .otherwise(F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))).alias("q"))


def first_centroids(rows: DataFrame) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, CENTROIDS rows at most."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(name.alias("name"), "q").orderBy("name", "q").limit(CENTROIDS).collect()
    return np.array([row["q"] for row in found], np.int64).reshape(-1, DIMS)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """(ids, vectors, numbers, distances) of ROWS vectors or fewer at a time."""
    of_centroids = walsh(centroids)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            q = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            largest = max(int(np.abs(q).max()), int(np.abs(centroids).max()))
            kind = np.int64 if largest <= LARGEST_FAST else object  # beyond, sums need more than 64 bits
            number, distance = nearest(walsh(q.astype(kind)), of_centroids.astype(kind))
            yield part.column("vec_id"), q, number, distance.astype(np.int64)


SUMS = "cluster int, dim int, total long, n long"


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the mean of its vectors, rounded down; one without vectors stays.

    Each batch gives a row per cluster and dimension, so what reaches the driver is CENTROIDS times DIMS sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, number, _ in _assigned(batches, centroids):
            for c in np.unique(number).tolist():
                own = q[number == c]
                yield pa.record_batch({"cluster": pa.array([c] * DIMS, pa.int32()), "dim": pa.array(range(DIMS), pa.int32()),
                                       "total": pa.array(own.sum(axis=0)), "n": pa.array([len(own)] * DIMS, pa.int64())})

    total = F.sum(F.col("total").cast("decimal(38,0)"))
    sums = rows.mapInArrow(run, SUMS).groupBy("cluster", "dim").agg(total.alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for row in sums:
        out[row["cluster"], row["dim"]] = int(row["total"]) // row["n"]
    return out


ASSIGNED = "vec_id long, cluster int, distance long"


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in _assigned(batches, centroids):
            yield pa.record_batch({"vec_id": ids, "cluster": pa.array(number.astype(np.int32)), "distance": pa.array(distance)})

    return rows.mapInArrow(run, ASSIGNED)


def fit(rows: DataFrame) -> np.ndarray:
    """The centroids after ROUNDS rounds. rows: as `kept` gives them."""
    centroids = first_centroids(rows)
    for _ in range(ROUNDS if len(centroids) else 0):
        centroids = moved(rows, centroids)
    return centroids


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, and the inertia and hash of its centroid, of every vector of DIMS components.

    Vectors of another length, that are null or have null or non-finite components, and rows without vec_id take no
    part. Rows that repeat a vec_id are vectors of their own; where they compete for a first centroid, the
    smaller vector comes first. With fewer than CENTROIDS vectors there are as many centroids as vectors. Distances
    are 64-bit: a component too large for that is an error, not a wrong result. An empty table gives no rows;
    other columns are not read.
    """
    rows = stored(kept(vectors), "rounded")
    centroids = fit(rows)
    found = stored(assigned(rows, centroids), "assigned")
    # A row per cluster, CENTROIDS at most.
    sums = {row["cluster"]: int(row["s"]) for row in
            found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, s in sums.items()]
    of_cluster = found.sparkSession.createDataFrame(
        names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (found.join(F.broadcast(of_cluster), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
