"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (SAMPLE rows, drawn by a hash of the id) and every row is put into one of its
leaves. A query walks the tree with a priority queue: the node with the highest score that one of its rows can be
expected to reach comes first; an inner node puts its children into the queue, a leaf is a visit. How many leaves a query
visits is calibrated: for CALIBRATION queries the true neighbours are found by brute force, and visits widen leaf by leaf
until the share of them that is found reaches the target. Beyond that a query goes on until its leaves hold as many rows
as it asks for.

Rows and visits meet in cells (leaf, part of its rows, part of its visits) of bounded size, so neither a leaf with a third
of all rows nor one that every query visits is one task's. Scores are computed in doubles from the original vectors.

Edge cases: rows with a null id, a null, empty or zero vector, or a null or non-finite component, take no part. Rows that
repeat an id count once, as the one with the smallest vector. Inner products are over the components that both vectors
have. With fewer candidates than asked for all are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import written
from palimpsest.llm.vectors import dense, fitted, one_an_id, sound_rows

SAMPLE, CALIBRATION = 32_768, 256  # rows that the tree is fitted on, queries whose true neighbours set the visits
LEAVES = 1024  # at most
FANOUT, ROUNDS = 8, 8
PART_ROWS, PART_VISITS = 4096, 2048  # of a cell, about
TARGET = 0.95  # of the calibration queries' true neighbours; the margin over 0.9 is for the other queries
FOUND = "query_id long, vec_id long, score double"


class Tree:
    """Nodes by number: centre, spread (the root of the mean variance over the components), children; leaves by number."""

    def __init__(self, points: np.ndarray, leaves: int, seed: int = 0) -> None:
        self.width, self.random = points.shape[1], np.random.default_rng(seed)
        self.centres, self.spread, self.children, self.leaf_of = [], [], [], {}
        self.least = max(1, len(points) // leaves)
        self.root = self.grown(points)

    def grown(self, points: np.ndarray) -> int:
        node = len(self.centres)
        self.centres.append(points.mean(axis=0))
        self.spread.append(float(np.sqrt(points.var(axis=0).mean())))
        self.children.append([])
        k = min(FANOUT, round(len(points) / self.least))
        parts = self.split(points, k) if k > 1 and self.spread[node] > 0 else []
        if len(parts) > 1:
            self.children[node] = [self.grown(points[rows]) for rows in parts]
        else:
            self.leaf_of[node] = len(self.leaf_of)
        return node

    def split(self, points: np.ndarray, k: int) -> list[np.ndarray]:
        """Lloyd's rounds from k points drawn at random; clusters without points go."""
        centres = points[self.random.choice(len(points), k, replace=False)]
        for _ in range(ROUNDS):
            near = nearest(points, centres)
            centres = np.stack([points[near == j].mean(axis=0) for j in np.unique(near)])
        near = nearest(points, centres)
        return [np.flatnonzero(near == j) for j in np.unique(near)]

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down the tree, to the nearest child at each node."""
        out, todo = np.zeros(len(points), np.int32), [(self.root, np.arange(len(points)))]
        points = fitted(points, self.width)
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            near = nearest(points[rows], np.stack([self.centres[c] for c in self.children[node]]))
            todo += [(c, rows[near == j]) for j, c in enumerate(self.children[node]) if (near == j).any()]
        return out

    def counted(self, by_leaf: dict[int, int]) -> None:
        """Tells the tree how many rows its leaves hold, and so what a walk may expect of each node: the highest of n normal
        values lies about sqrt(2 ln n) spreads above their mean."""
        self.rows = [0] * len(self.centres)
        for node in reversed(range(len(self.centres))):  # children have higher numbers
            own = by_leaf.get(self.leaf_of[node], 0) if node in self.leaf_of else 0
            self.rows[node] = own + sum(self.rows[c] for c in self.children[node])
        self.matrix = np.stack(self.centres)
        self.reach = np.array([s * np.sqrt(2 * np.log(max(n, 1))) for s, n in zip(self.spread, self.rows)])

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(leaf, its rows) in the order of a best-bin-first walk; leaves without rows are left out."""
        query = fitted(query[None, :], self.width)[0]
        hope = self.matrix @ query + np.linalg.norm(query) * self.reach
        queue = [(-hope[self.root], self.root)]
        while queue:
            _, node = heapq.heappop(queue)
            if node in self.leaf_of:
                yield self.leaf_of[node], self.rows[node]
            for c in self.children[node]:
                if self.rows[c]:
                    heapq.heappush(queue, (-hope[c], c))


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)


def top(query: np.ndarray, ids: np.ndarray, vecs: np.ndarray, rough: np.ndarray, largest: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows, ties to the smaller id. rough: matrix products, whose last digits follow a row's
    place in the matrix; rows within their error of the k-th are scored anew, one by one, so that equal vectors tie.
    largest: the largest component."""
    at = np.arange(len(ids))
    if k < len(ids):
        least = np.partition(rough, len(ids) - k)[len(ids) - k]
        at = np.flatnonzero(rough >= least - 1e-12 * (np.linalg.norm(query) * largest * vecs.shape[1] + 1e-300))
    scores = (vecs[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -scores))[:k]
    return ids[at][order], scores[order]


def found_in(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int) -> pa.Table:
    """Rows FOUND: each query's k best of the rows, but for its own."""
    width = min(queries.shape[1], vecs.shape[1])
    queries, vecs = np.ascontiguousarray(queries[:, :width]), np.ascontiguousarray(vecs[:, :width])
    parts, largest = [], float(np.abs(vecs).max(initial=0))
    for at in range(0, len(query_ids), 128):
        for q, query, rough in zip(query_ids[at : at + 128], queries[at : at + 128], queries[at : at + 128] @ vecs.T):
            i, s = top(query, ids, vecs, rough, largest, k + 1)
            keep = np.flatnonzero(i != q)[:k]
            parts.append((np.full(len(keep), q), i[keep], s[keep]))
    columns = [np.concatenate([p[c] for p in parts]) if parts else [] for c in range(3)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def ranked_best(found: DataFrame, k: int) -> DataFrame:
    """found with each query's first k, rank from 1."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def by_brute_force(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """Rows FOUND and rank, exact. queries: few (vec_id, vec), which go to every task."""
    width = max(len(r["vec"]) for r in queries)
    held = rows.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in queries]), np.array([r["vec"] + [0.0] * (width - len(r["vec"])) for r in queries])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from found_in(*held.value, batch.column(0).to_numpy(), dense(batch.column(1)), k).to_batches()

    return ranked_best(rows.select("vec_id", "vec").mapInArrow(run, FOUND), k)


def indexed(rows: DataFrame, leaves: int | None = None, sample: int = SAMPLE) -> tuple[DataFrame, Tree | None]:
    """rows with their leaf, written, and the tree. leaves: about; None: half the root of the number of rows, LEAVES at most."""
    n = rows.count()
    if not n:
        return rows.withColumn("leaf", F.lit(0)), None
    leaves = leaves or max(1, min(LEAVES, round(n**0.5 / 2)))
    drawn = rows if n <= sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    taken = drawn.select("vec").limit(sample).toPandas()["vec"] if n else []
    width = max(map(len, taken), default=0)
    if not width:  # so few rows that the sample has none
        taken = rows.select("vec").limit(sample).toPandas()["vec"]
        width = max(map(len, taken))
    points = np.stack([np.pad(np.asarray(v, np.float64), (0, width - len(v))) for v in taken])
    tree = Tree(points, leaves)
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = held.value.place(dense(batch.column(1))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32())], ["vec_id", "vec", "leaf"])

    index = written(rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec array<double>, leaf int"), "index")
    tree.counted({r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()})  # LEAVES rows at most
    return index, tree


def calibrated(index: DataFrame, tree: Tree, queries: DataFrame, k: int, target: float) -> tuple[int, float]:
    """How many leaves a query must visit for the target share of the true neighbours of CALIBRATION queries, and that share."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()
    if not asked:
        return 1, 1.0
    true = written(by_brute_force(index, asked, k), "true")
    leaf_of = index.select("vec_id", "leaf").join(F.broadcast(true.select("query_id", "vec_id")), "vec_id")  # CALIBRATION * k rows
    places = {r["vec_id"]: {leaf: i for i, (leaf, _) in enumerate(tree.walk(np.array(r["vec"])))} for r in asked}
    needed = sorted(places[r["query_id"]][r["leaf"]] + 1 for r in leaf_of.collect())
    if not needed:
        return 1, 1.0
    visits = 1
    while (share := np.searchsorted(needed, visits, "right") / len(needed)) < target:
        visits += 1
    return visits, float(share)


def visited(queries: DataFrame, tree: Tree, visits: int, k: int) -> DataFrame:
    """Rows (query_id, leaf, qvec): the leaves that each query visits."""
    held = queries.sparkSession.sparkContext.broadcast(tree)
    schema = pa.schema([("query_id", pa.int64()), ("leaf", pa.int32()), ("qvec", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row, leaves = [], []
                for i, query in enumerate(dense(part.column(1))):
                    there = 0
                    for n, (leaf, size) in enumerate(held.value.walk(query)):
                        if n >= visits and there > k:
                            break
                        there += size
                        row.append(i)
                        leaves.append(leaf)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(leaves, pa.int32()), part.column(1).take(pa.array(row)).cast(pa.list_(pa.float64()))], schema=schema)

    return queries.select("vec_id", "vec").mapInArrow(run, "query_id long, leaf int, qvec array<double>")


def searched(index: DataFrame, tree: Tree, queries: DataFrame, k: int, visits: int) -> DataFrame:
    """Rows FOUND and rank: the k best rows of the leaves that each query visits."""
    spark, told = index.sparkSession, visited(queries, tree, visits, k)
    asked = {r["leaf"]: r["count"] for r in told.groupBy("leaf").count().collect()}
    sizes = {leaf: tree.rows[node] for node, leaf in tree.leaf_of.items()}
    cells = [(leaf, -(-sizes[leaf] // PART_ROWS), -(-n // PART_VISITS)) for leaf, n in asked.items()]
    cells = F.broadcast(spark.createDataFrame(cells, "leaf int, parts int, qparts int"))  # LEAVES rows at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    rows = index.join(cells, "leaf").select("leaf", dealt("vec_id", "parts").alias("part"), each("qparts").alias("qpart"), "vec_id", "vec")
    asking = told.join(cells, "leaf").select("leaf", each("parts").alias("part"), dealt("query_id", "qparts").alias("qpart"), "query_id", "qvec")

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, b = mine.combine_chunks(), theirs.combine_chunks()
        if not a.num_rows or not b.num_rows:
            return found_in(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), k)
        vecs = lambda t, c: dense(t.column(c).chunk(0))
        return found_in(b["query_id"].to_numpy(), vecs(b, "qvec"), a["vec_id"].to_numpy(), vecs(a, "vec"), k)

    cell = ["leaf", "part", "qpart"]
    return ranked_best(rows.groupBy(*cell).cogroup(asking.groupBy(*cell)).applyInArrow(meet, FOUND), k)


def neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET, leaves: int | None = None, visits: int | None = None,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score, leaves_visited, calibrated_recall). is_query: a condition on vec_id. visits: as
    many leaves a query, None: calibrated; leaves_visited counts a query's least."""
    rows = sound_rows(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    rows = written(one_an_id(rows), "rows")
    index, tree = indexed(rows, leaves)
    if tree is None:
        found, visits, share = rows.sparkSession.createDataFrame([], FOUND + ", rank int"), 0, None
    else:
        queries, share = index.where(is_query), None
        if visits is None:
            visits, share = calibrated(index, tree, queries, k, target)
        found = searched(index, tree, queries, k, visits)
    return found.select("query_id", "rank", "vec_id", "score", F.lit(visits).alias("leaves_visited"), F.lit(share).cast("double").alias("calibrated_recall"))
