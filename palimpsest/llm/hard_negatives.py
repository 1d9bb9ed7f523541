"""Hard negatives by a secondary sort: for each anchor and each of its nearest rows of the same label, the nearest rows
of other labels that are neither too close to the positive's score nor too far below it.

Pair scores are packed into keys (anchor, descending score, positives first, id), dealt by anchor and sorted within
partitions; an iterator over the sorted keys opens a window at each positive and emits negatives as they pass, so no
anchor's pairs are ever held together.

Scores of the anchors, in blocks of a measured size, against all rows are reduced where they are made, without loss: no
row but the best n_positives of each task can be one of an anchor's positives, and, once the positives are known, none
but the first n_negatives of each task in a positive's window can be returned. Only those are packed and shuffled.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that repeat an id
count once, as the one with the smallest label, then scaled vector. Inner products are over the components that both vectors
have; one that no long holds becomes the nearest long. An anchor without positives, a positive without negatives in its
window and an empty table give no rows. A positive's score below zero has an empty window. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import hex64, written
from palimpsest.llm.vectors import LOWEST, Best, dense, floored, in_blocks, one_an_id, slabs, sound_rows, whole_products

PAIR = "anchor_id long, score long, id long"
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pairs(ids: np.ndarray, best: Best) -> Iterator[pa.RecordBatch]:
    """What best holds as rows PAIR, each once; ids are the anchors."""
    row, at = np.nonzero(best.there)
    found = np.unique(np.stack([ids[row], best.scores[row, at], best.ids[row, at]], axis=1), axis=0)
    for part in (found[i : i + 10_000] for i in range(0, len(found), 10_000)):
        yield pa.record_batch([pa.array(c) for c in part.T], ["anchor_id", "score", "id"])


def scored(rows: DataFrame, block: list, low: int, high: int, n_positives: int, n_negatives: int) -> DataFrame:
    """Rows PAIR of the anchors in block (vec_id, vec, label, positive scores). Without scores: each task's best
    n_positives rows of the anchor's label. With them: each task's first n_negatives in each positive's window."""
    block = sorted(block, key=lambda r: r["vec_id"])
    ids, labels = (np.array([r[c] for r in block], np.int64) for c in ("vec_id", "label"))
    width = max((len(r["vec"]) for r in block), default=0)
    matrix = np.array([r["vec"] + [0.0] * (width - len(r["vec"])) for r in block], np.float64).reshape(len(block), width)
    known = None
    if block and "scores" in block[0].asDict():
        known = np.full((len(block), n_positives), -1, np.int64)  # below zero a window is empty
        for i, r in enumerate(block):
            known[i, : len(r["scores"])] = r["scores"]
    held = rows.sparkSession.sparkContext.broadcast((ids, labels, matrix, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix, known = held.value
        best = [Best(len(ids), n_positives)] if known is None else [Best(len(ids), n_negatives) for _ in range(n_positives)]
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            other, theirs, vecs = batch.column(0).to_numpy()[order], batch.column(2).to_numpy()[order], dense(batch.column(1))[order]
            for part in slabs(len(ids), len(other)):
                s = whole_products(matrix[part], vecs)
                same = labels[part, None] == theirs
                if known is None:
                    best[0].add(part, other, s, same & (ids[part, None] != other))
                    continue
                for k, b in enumerate(best):
                    # Whole numbers n with low * p <= 100 * n <= high * p, without products that no long holds.
                    ends = [(-(-low * p // 100), high * p // 100) if p >= 0 else (0, -1) for p in known[part, k].tolist()]
                    lo, hi = np.array(ends, np.int64).T
                    inside = ~same & (s >= lo[:, None]) & (s <= hi[:, None])
                    if inside.any():
                        b.add(part, other, s, inside)
        merged = best[0]
        if known is not None:
            merged = Best(0, 1)
            merged.ids, merged.scores, merged.there = (np.concatenate([getattr(b, c) for b in best], axis=1) for c in ("ids", "scores", "there"))
        yield from pairs(ids, merged)

    return rows.select("vec_id", "vec", "label").mapInArrow(run, PAIR)


def packed(anchor: Column, score: Column, kind: int, other: Column) -> Column:
    """25 bytes that sort by anchor, descending score, kind and id."""
    flip = lambda c: hex64(c.bitwiseXOR(F.lit(LOWEST)))
    return F.unhex(F.concat(flip(anchor), flip(F.bitwise_not(score)), F.lit(f"{kind:02x}"), flip(other)))


def passed(batches: Iterator[pa.RecordBatch], low: int, high: int, n_negatives: int) -> Iterator[pa.RecordBatch]:
    """Rows MINED from sorted keys. Held at a time: the open windows of one anchor."""
    top = np.uint64(1 << 63)
    names = [c.split()[0] for c in MINED.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in MINED.split(", ")])
    anchor, windows = None, []
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), KEY)
        long = lambda name: (keys[name].astype(np.uint64) ^ top).view(np.int64)  # noqa: E731, B023
        out = []
        for a, s, kind, other in zip(long("anchor").tolist(), (~long("score")).tolist(), keys["kind"].tolist(), long("id").tolist()):
            if a != anchor:
                anchor, windows = a, []
            if kind == 0:
                windows.append([s, other, 0])
                continue
            for w in windows:
                if w[2] < n_negatives and low * w[0] <= 100 * s <= high * w[0]:
                    w[2] += 1
                    out.append((a, w[1], w[2], other, w[0], s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], names)


def mined(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
    scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """Rows MINED. is_anchor: a condition on vec_id. Components count as floor(scale * x); low and high are percentages of
    the positive's score."""
    rows = sound_rows(vectors, id_col, vec_col, F.col(label_col).cast("long").alias("label")).where("label is not null")
    rows = written(one_an_id(rows.select("vec_id", "label", floored(F.col("vec"), scale).alias("vec"))), "rows")
    anchors = written(rows.where(is_anchor), "anchors")
    first = None
    for block in in_blocks(anchors):
        made = scored(rows, block.collect(), low, high, n_positives, n_negatives)
        first = made if first is None else first.unionByName(made)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    positives = written(first.withColumn("place", place).where(F.col("place") <= n_positives).drop("place"), "positives")
    scores = positives.groupBy("anchor_id").agg(F.array_distinct(F.collect_list("score")).alias("scores"))  # n_positives at most
    told = written(anchors.join(scores, anchors["vec_id"] == scores["anchor_id"]).drop("anchor_id"), "told")
    keys = positives.select("anchor_id", packed(F.col("anchor_id"), F.col("score"), 0, F.col("id")).alias("key"))
    for block in in_blocks(told):
        negatives = scored(rows, block.collect(), low, high, n_positives, n_negatives)
        keys = keys.unionByName(negatives.select("anchor_id", packed(F.col("anchor_id"), F.col("score"), 1, F.col("id")).alias("key")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(parts, "anchor_id").select("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: passed(batches, low, high, n_negatives), MINED)
