"""A quality classifier: histogram gradient-boosted trees over document statistics, scored by flat arrays in numpy.

Statistics of every whole text are computed where the text is; trees are fitted on at most `most` labelled rows (a
documented bound: the rows with the smallest hashes of their ids, so a fit doesn't depend on partitioning).

Edge cases: a null text counts as empty and gets a score like any other; equal texts get equal scores; an empty table
gives an empty result; with fewer than two classes among the labels every score is their mean, or 0.5 without labels.
Labels without a document, or null, are not used; of several labels for one id, each counts. Columns other than the id
and the text are never looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

FEATURES = (
    "words", "characters", "mean_word", "distinct_share", "top_word_share", "repeat_share", "lines", "distinct_lines",
    "mean_line", "capitals", "digits", "symbols", "stops", "shouts", "other_marks", "long_words", "short_words",
    "ends_share", "not_ascii", "bytes_a_word",
)
MOST_ROWS = 50_000


def statistics(text: str) -> list[float]:
    """FEATURES of one text."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counted = Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.array(list(map(len, words)) or [0])
    bare = text.encode()
    held = np.bincount(np.frombuffer(bare, np.uint8), minlength=256)
    at = lambda s: held[list(s.encode())].sum()
    symbols, stops, shouts = at("#*$%&|<>"), at(".,;:"), at("!?")
    marks = held[33:48].sum() + held[58:65].sum() + held[91:97].sum() + held[123:127].sum()
    return [
        len(words), len(text), sizes.mean(), len(counted) / n, max(counted.values(), default=0) / n,
        1 - len(pairs) / max(1, len(words) - 1), len(lines), len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        held[65:91].sum() / chars, held[48:58].sum() / chars, symbols / n, stops / n, shouts / n, (marks - symbols - stops - shouts) / n,
        (sizes > 12).mean(), (sizes < 3).mean(), sum(w[-1] in ".!?" for w in words) / n, held[128:].sum() / chars, len(bare) / n,
    ]


@dataclass
class Trees:
    """All trees in flat arrays: node i goes to right[i] where its feature is above its threshold, else to left[i]; a
    leaf goes to itself. roots: each tree's first node."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features: all rows go down all trees at once, a level a step."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] > self.threshold[at], self.right[at], self.left[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 10, ridge: float = 1.0) -> Trees:
    """Gradient-boosted trees for the logistic loss, grown level by level on histograms of binned features."""
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    start = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            place = np.full(len(y), roots[-1])
            level = [roots[-1]]
            for d in range(depth + 1):
                following = []
                for node in level:
                    here = np.flatnonzero(place == node)
                    gs, hs = g[here].sum(), h[here].sum()
                    nodes[node][4] = rate * gs / (hs + ridge)
                    best = (1e-6, 0, 0)
                    for f, e in enumerate(edges if d < depth and len(here) >= 2 * least else []):
                        b = binned[here, f]
                        gl = np.cumsum(np.bincount(b, g[here], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[here], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(nl < least) | (len(here) - nl < least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), f, int(gain.argmax()))
                    if best[0] > 1e-6:
                        _, f, cut = best
                        left, right = len(nodes), len(nodes) + 1
                        nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                        nodes[node][:4] = [f, edges[f][cut], left, right]
                        place[here] = np.where(binned[here, f] > cut, right, left)
                        following += [left, right]
                level = following
            flat = np.array([n[4] for n in nodes])
            raw += flat[place]
    table = list(zip(*nodes)) if nodes else [[]] * 5
    ints = lambda c: np.array(c, np.int64)
    return Trees(start, ints(roots), ints(table[0]), np.array(table[1], float), ints(table[2]), ints(table[3]), np.array(table[4], float), depth)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, features) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "features"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, features array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3. A null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def classified(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_ROWS, **settings) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of all documents. settings: fit()'s."""
    known = written(described(docs, id_col, text_col), "features")
    told = labels.select(F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("y")).where("y is not null")
    joined = known.join(told, known["doc_id"] == F.col("labelled")).where(~held_out(F.col("doc_id")))
    ordered = joined.select("features", "y", F.xxhash64("doc_id").alias("o"), "doc_id")
    total = ordered.count()
    if total > 2 * most:  # a hash below this sends the sample and a margin, not 'most' rows of each task
        upto = int((1.5 * most / total) * (1 << 64)) - (1 << 63)
        ordered = ordered.where(F.col("o") <= upto)
    sample = ordered.orderBy("o", "doc_id", "y").limit(most).toPandas()
    model = fit(np.array(sample["features"].tolist(), float).reshape(-1, len(FEATURES)), sample["y"].to_numpy(float), **settings)
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column(1)
            x = np.asarray(features.flatten()).reshape(len(batch), len(FEATURES))
            score = np.concatenate([held.value.scores(x[i : i + 2048]) for i in range(0, len(x), 2048)] or [np.zeros(0)])
            yield pa.record_batch([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = known.mapInArrow(run, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
