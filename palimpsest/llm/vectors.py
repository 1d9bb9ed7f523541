"""What the vector operators share: which vectors count, their matrices, one row an id, running bests, blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20  # of query vectors that are sent to every task at once
EXACT = 1 << 53  # integers below are exact as doubles
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def sound(vec: Column) -> Column:
    """Whether a vector is there and every component is a finite number. An empty vector is sound."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vec.isNotNull() & ~odd


def sound_rows(vectors: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """Rows (vec_id long, vec array<double>, more) of sound vectors with an id."""
    vec = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), *more).where(F.col("vec_id").isNotNull() & sound(F.col("vec")))


def one_an_id(rows: DataFrame) -> DataFrame:
    """rows, brought down to one an id where ids repeat: that with the smallest other columns, in their order."""
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    others = [c for c in rows.columns if c != "vec_id"]
    return rows.groupBy("vec_id").agg(F.min(F.struct(*others)).alias("least")).select("vec_id", "least.*").select(*rows.columns)


def floored(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as a double. Spark's floor gives a long; numbers beyond EXACT are whole anyway."""

    def one(x: Column) -> Column:
        y = x * F.lit(float(scale))
        return F.when(F.abs(y) < F.lit(float(EXACT)), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vec, one)


def dense(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def fitted(matrix: np.ndarray, width: int) -> np.ndarray:
    """matrix with as many columns as width, cut or filled up with zeros."""
    return matrix[:, :width] if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers held as doubles, exact, over the components that both have; what a long
    can't hold becomes the nearest long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LOWEST, HIGHEST).astype(np.int64)


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the columns of its k highest allowed scores, the first of equals first, and which of them are any."""
    n, m = scores.shape
    k = min(k, m)
    span = 1 << max(1, m.bit_length())
    if max(-int(scores.min(initial=0)), int(scores.max(initial=0))) < (1 << 61) // span:
        ordered = np.where(allowed, scores * span - np.arange(m), LOWEST)
        at = np.argpartition(ordered, m - k, axis=1)[:, m - k :] if k < m else np.broadcast_to(np.arange(m), (n, m))
        at = np.take_along_axis(at, np.argsort(-np.maximum(np.take_along_axis(ordered, at, 1), -HIGHEST), axis=1), 1)
    else:
        at = np.lexsort((np.broadcast_to(np.arange(m), (n, m)), ~scores, ~allowed), axis=1)[:, :k]
    return at, np.take_along_axis(allowed, at, 1)


class Best:
    """The k highest scores of each of n queries among all that was added, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.ids, self.scores, self.there = k, np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def add(self, rows: slice, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """scores of the queries in rows against ids, which ascend."""
        at, any_ = best_of(scores, allowed, self.k)
        i = np.concatenate((self.ids[rows], ids[at]), axis=1)
        s = np.concatenate((self.scores[rows], np.take_along_axis(scores, at, 1)), axis=1)
        there = np.concatenate((self.there[rows], any_), axis=1)
        order = np.lexsort((i, ~s, ~there), axis=1)[:, : self.k]
        self.ids[rows], self.scores[rows], self.there[rows] = (np.take_along_axis(x, order, 1) for x in (i, s, there))


def slabs(n: int, width: int, cells: int = 1 << 20) -> Iterator[slice]:
    """n queries in slices whose scores against width rows take a few megabytes."""
    step = max(1, cells // max(1, width))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def in_blocks(queries: DataFrame, most: int = BLOCK_BYTES) -> list[DataFrame]:
    """queries (vec_id, vec, ...) as frames whose vectors are most bytes at most together, unless a single one is larger;
    each block's size is measured before anything is collected. Pass a written frame, it is read for each block."""
    size = F.size("vec") * 8 + 64
    total = queries.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // most))
    while n > 1 or total > most:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n))
        largest = queries.groupBy(block.alias("b")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.max("bytes")).first()[0] or 0
        if largest <= most:
            return [queries.where(block == i) for i in range(n)]
        n *= 2
    return [queries]
