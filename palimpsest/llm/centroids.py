"""Centroid clustering in whole numbers, each vector's nearest centroid found progressively in Walsh-Hadamard order.

Vectors and centroids are transformed by the 64-point Walsh-Hadamard matrix, exactly: all entries are 1 or -1, and the
squared distance of two transforms is 64 times that of the vectors. Coefficients come coarse to fine, by their number of
sign changes. Differences are added up group by group; after the first group the centroid that is nearest so far is
finished, and from then on a centroid whose sum is strictly above that distance is out. What is left finishes all 64.

A round is one pass over the written vectors; each task returns the count and sums of its vectors for each centroid.

Edge cases: vectors that are null, have another number of components, or a null or non-finite one, take no part; so do
rows with a null id. Rows that repeat an id each count; where the first centroids' ids repeat the smaller vector is first.
With fewer vectors than centroids there are as many centroids as vectors. Distances are exact; one that no long holds
becomes the largest long, and sums likewise. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written
from palimpsest.llm.vectors import HIGHEST, dense, floored, sound_rows

SIZE = 64
GROUPS = (0, 2, 8, 24, SIZE)  # ends of the groups of coefficients
#: The largest component for which all sums of 64 squared differences of coefficients are longs.
SMALL = 1 << 21
ASSIGNED = "vec_id long, cluster int, distance decimal(38,0)"
WIDE = pa.decimal128(38, 0)


def walsh() -> np.ndarray:
    """The 64-point Walsh-Hadamard matrix, its rows by their number of sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < SIZE:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1))]


WALSH = walsh()


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles as longs if small, else as Python's integers, so that what follows is exact either way."""
    if np.abs(values).max(initial=0) <= SMALL:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number (ties: the smaller) and the squared distance to it, for whole vectors and centroids."""
    if vectors.dtype != centroids.dtype:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    x, c = vectors @ WALSH.T, centroids @ WALSH.T
    n, k = len(x), len(c)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros((k, n), x.dtype)

    def add(j: int, rows: np.ndarray, lo: int, hi: int) -> None:
        d = x[rows, lo:hi] - c[j, lo:hi]
        sums[j, rows] += (d * d).sum(axis=1)

    every = np.arange(n)
    for j in range(k):
        add(j, every, 0, GROUPS[1])
    first = np.argmin(sums, axis=0)
    for j in range(k):
        add(j, np.flatnonzero(first == j), GROUPS[1], SIZE)
    most = sums[first, every].copy()  # a whole distance, which no nearer centroid's sum can pass
    done = np.zeros((k, n), bool)
    done[first, every] = True
    for lo, hi in zip(GROUPS[1:], GROUPS[2:]):
        for j in range(k):
            add(j, np.flatnonzero(~done[j] & (sums[j] <= most)), lo, hi)
    # A sum that stopped early is strictly above most, so it can't win or tie.
    best = np.argmin(sums, axis=0)
    return best, sums[best, every] // SIZE


def placed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, whole vectors, clusters and distances, batch by batch."""
    for batch in batches:
        vectors = whole(dense(batch.column(1)).reshape(-1, SIZE))
        yield batch.column(0), vectors, *nearest(vectors, centroids)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each its vectors' mean, rounded down; one without vectors stays."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, SIZE), object)
        for _, vectors, cluster, _ in placed(batches, centroids):
            for j in np.unique(cluster).tolist():
                counts[j] += (cluster == j).sum()
                sums[j] += vectors[cluster == j].sum(axis=0).astype(object)  # a batch's sum of small vectors is a long
        used = np.flatnonzero(counts)
        columns = [pa.array([Decimal(int(v)) for v in sums[used, i]], WIDE) for i in range(SIZE)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), *columns], ["cluster", "n", *(f"s{i}" for i in range(SIZE))])

    schema = "cluster int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(SIZE))
    sums = kept.mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(SIZE)))
    out = centroids.astype(object)
    for r in sums.collect():  # a row for each centroid at most
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(SIZE)]
    return whole(out.astype(np.float64)) if max(map(abs, out.ravel().tolist())) <= SMALL else out


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256). Components count as floor(scale * x)."""
    rows = sound_rows(vectors, id_col, vec_col).where(F.size("vec") == SIZE)
    kept = written(rows.select("vec_id", floored(F.col("vec"), scale).alias("vec")), "kept")
    start = kept.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256), "vec_id", "vec").limit(k).collect()
    out_schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return kept.sparkSession.createDataFrame([], out_schema)
    centroids = whole(np.array([r["vec"] for r in start]))
    for _ in range(rounds):
        centroids = moved(kept, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in placed(batches, centroids):
            wide = pa.array(distance).cast(WIDE) if distance.dtype != object else pa.array([Decimal(int(d)) for d in distance], WIDE)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), wide], ["vec_id", "cluster", "distance"])

    assigned = written(kept.mapInArrow(run, ASSIGNED), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    told = [(j, min(d, HIGHEST), min(sum(inertia.values()), HIGHEST), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in inertia.items()]
    told = kept.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    distance = F.least("distance", F.lit(HIGHEST)).cast("long").alias("distance")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", distance, "cluster_inertia", "inertia", "centroid_sha256")
