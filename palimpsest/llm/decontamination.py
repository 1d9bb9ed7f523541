"""Benchmark decontamination by greedy string tiling: documents that share a seed with a test item are tiled against it,
longest matches first, and a document whose tiles cover enough of an item leaks it, in whatever order its passages stand.

Words are \\w+ of the lower-cased text. A seed is SEED words, or the whole item if it has fewer. No tile is shorter than a
seed, so items without a seed in a document have no tile there.

Edge cases: a null or empty text or item has no words and matches nothing; equal rows get equal results; items of equal
text each match; an empty table, or an empty benchmark, gives no matches. Ids may be null. Other columns pass through
cleaned() unread, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import filter_of, fresh, may_have, written
from palimpsest.llm.tokens import BASE, INVERSE, powers

SEED, COVERAGE = 5, 0.6
BROADCAST_BYTES = 16 << 20  # of benchmark text; beyond, seeds are joined by a shuffle
SALTS = 32  # tasks that a seed's documents are dealt over in that shuffle
WORD = re.compile(r"\w+")


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2 ** 64, of all windows of size ids, from the hashes of what comes before them: the cost
    doesn't follow size."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ids + 2).astype(np.uint64) * powers(BASE, len(ids)), dtype=np.uint64)))
    return (upto[size:] - upto[:n]) * powers(INVERSE, n)


def shared_runs(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(-length, place in doc, place in item) of all runs of size or more words that both have, free, and that can't be made longer."""
    if len(item) < size or len(doc) < size:
        return []
    upto = lambda free: np.concatenate(([0], np.cumsum(free)))
    whole = lambda free: upto(free)[size:] - upto(free)[:-size] == size
    heads: dict[int, list[int]] = {}
    hashes, scan = rolling(item, size), rolling(doc, size)
    for j in np.flatnonzero(whole(free_item)).tolist():
        heads.setdefault(int(hashes[j]), []).append(j)
    hits = np.flatnonzero(np.isin(scan, np.fromiter(heads, np.uint64, len(heads)))) if heads else np.zeros(0, int)
    hits = hits[whole(free_doc)[hits]]
    found, done_to = [], {}
    for i in hits.tolist():
        for j in heads[int(scan[i])]:
            if done_to.get(i - j, -1) >= i or not (doc[i : i + size] == item[j : j + size]).all():
                continue
            k = size
            while i + k < len(doc) and j + k < len(item) and free_doc[i + k] and free_item[j + k] and doc[i + k] == item[j + k]:
                k += 1
            done_to[i - j] = i + k - size
            found.append((-k, i, j))
    return found


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (length, place in doc, place in item). Ids below 0 match nothing.

    At each step the longest run of free words that both have is marked, the first in doc, then in item, of equals; what is
    marked takes no further part. Runs are found by rolling hashes of windows, whose size halves from the item's length to
    least; a run of which a part is marked meanwhile goes back in the queue with its free parts.
    """
    free_doc, free_item = doc >= 0, np.ones(len(item), bool)
    tiles, size = [], max(least, len(item))
    while True:
        queue = shared_runs(doc, item, free_doc, free_item, size)
        heapq.heapify(queue)
        while queue:
            low, i, j = heapq.heappop(queue)
            free = free_doc[i : i - low] & free_item[j : j - low]
            if free.all():
                free_doc[i : i - low] = free_item[j : j - low] = False
                tiles.append((-low, i, j))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])))).reshape(-1, 2)
            for a, b in edges.tolist():
                if b - a >= size:
                    heapq.heappush(queue, (a - b, i + a, j + a))
        if size == least:
            return tiles
        size = max(least, size // 2)


class Items:
    """Test items as word ids, with their seeds sorted by hash."""

    def __init__(self, rows: list[tuple]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items = []
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in rows:
            words = WORD.findall((text or "").lower())
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            size = min(SEED, len(ids))
            if size:
                for at, h in enumerate(rolling(ids, size).tolist()):
                    seeds.setdefault(size, []).append((h, len(self.items), at))
                self.items.append((item_id, ids, size))
        self.seeds = {}
        for size, found in seeds.items():
            found.sort()
            self.seeds[size] = (np.array([h for h, _, _ in found], np.uint64), np.array([i for _, i, _ in found]), np.array([a for _, _, a in found]))

    def of(self, text: str, threshold: float) -> list[tuple]:
        """(item_id, coverage, tiles, longest tile, item words) of each item that the text leaks."""
        get = self.vocabulary.get
        doc = np.array([get(w, -1) for w in WORD.findall(text.lower())], np.int64)
        covered: dict[int, np.ndarray] = {}
        for size, (hashes, items, places) in self.seeds.items():
            scan = np.unique(rolling(doc, size))
            lo, hi = np.searchsorted(hashes, scan, "left"), np.searchsorted(hashes, scan, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for item, at in zip(items[a:b].tolist(), places[a:b].tolist()):
                    covered.setdefault(item, np.zeros(len(self.items[item][1]), bool))[at : at + size] = True
        found = []
        for item in sorted(covered):
            item_id, ids, size = self.items[item]
            # Tiles cover nothing that no seed covers, so this bound loses nothing.
            if covered[item].mean() < threshold:
                continue
            tiles = tile(doc, ids, size)
            share = sum(k for k, _, _ in tiles) / len(ids)
            if share >= threshold:
                found.append((item_id, share, len(tiles), max(k for k, _, _ in tiles), len(ids)))
        return found


def text_key(text: Column) -> Column:
    """256 bits that tell texts apart; null for null."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def small(benchmark: DataFrame, text_col: str) -> bool:
    """Whether the benchmark's measured size allows a copy in each worker."""
    return (benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) <= BROADCAST_BYTES


FOUND = "coverage double, tiles int, longest_tile int, item_words int"


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and leaked item: doc_id, text_key, item_id, coverage, tiles, longest_tile, item_words."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text"))
    kinds = f"doc_id {read.schema['doc_id'].dataType.simpleString()}, text_key binary, item_id {items.schema['item_id'].dataType.simpleString()}, {FOUND}"
    if not small(items, "item_text"):
        return matches_by_join(read, items, threshold, kinds)
    held = read.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])  # BROADCAST_BYTES of text at most
    empty = pa.RecordBatch.from_pylist([], schema=arrow_schema(read.sparkSession, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(held.value)
        for batch in batches:
            rows = [(d.as_py(), k.as_py(), *found) for d, t, k in zip(*batch.columns) if t.is_valid for found in index.of(t.as_py(), threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), empty.schema)], schema=empty.schema) if rows else empty

    return read.mapInArrow(run, kinds)


def arrow_schema(spark: SparkSession, kinds: str) -> pa.Schema:
    """Arrow's types of a Spark schema, whatever types its ids have."""
    return spark.createDataFrame([], kinds).toArrow().schema


def seeds_of(rows: DataFrame, key: str, text: str, sizes: list[int] | None, asked: Broadcast | None = None) -> DataFrame:
    """Rows (key, seed, places, size, words): the hashes of a text's runs of words of the given sizes (None: of the
    smaller of SEED and the text's length), each with how often it occurs, and the text's words. asked: a filter over seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = WORD.findall((t.as_py() or "").lower())
                for size in sizes or ([min(SEED, len(words))] if words else []):
                    found = Counter(xxhash.xxh64_intdigest(" ".join(words[i : i + size]), size) - (1 << 63) for i in range(len(words) - size + 1))
                    out += [(k, h, n, size, len(words)) for h, n in found.items()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 5, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
            made = pa.record_batch(columns, ["key", "seed", "places", "size", "words"])
            yield made if asked is None else made.filter(pa.array(may_have(asked.value, made.column(1).to_numpy()) == 1))

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key binary, seed long, places int, size int, words int")


def matches_by_join(read: DataFrame, items: DataFrame, threshold: float, kinds: str) -> DataFrame:
    """For benchmarks of any size: seeds of distinct texts and items meet in a shuffle; pairs whose shared seeds can't cover
    enough of the item go; each other pair is tiled once. Then every row with the text meets every item with the other."""
    keyed = items.withColumn("item_key", text_key(F.col("item_text")))
    of_items = written(seeds_of(keyed.dropDuplicates(["item_key"]), "item_key", "item_text", None), "item-seeds").withColumnRenamed("key", "item_key")
    sizes = sorted(r["size"] for r in of_items.select("size").distinct().collect())  # SEED at most
    asked = filter_of(of_items.select(F.col("seed").alias("fp")))
    of_docs = seeds_of(read, "text_key", "text", sizes, asked).select(F.col("key").alias("text_key"), "seed", "size").distinct() if sizes else None
    schema = arrow_schema(read.sparkSession, kinds)
    if of_docs is None:
        return read.sparkSession.createDataFrame([], kinds)
    covers = F.sum("places") * F.first("size") >= F.lit(threshold) * F.first("words")
    salt = F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int")  # a stock phrase is no single task's
    dealt = of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = of_docs.withColumn("salt", salt).join(dealt, ["seed", "size", "salt"]).groupBy("text_key", "item_key").agg(covers.alias("may")).where("may").select("text_key", "item_key")
    pairs = written(pairs, "seeded")
    texts = read.join(pairs.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", "text")
    full = pairs.join(keyed.dropDuplicates(["item_key"]).select("item_key", "item_text"), "item_key").join(texts, "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, item_key, item_text, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(key, item_key, *found[1:]) for found in Items([(0, item_text)]).of(text, threshold)]
            if rows:
                fields = [pa.field("text_key", pa.binary()), pa.field("item_key", pa.binary()), *list(schema)[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))

    tiled = full.select("text_key", "item_key", "item_text", "text").mapInArrow(run, f"text_key binary, item_key binary, {FOUND}")
    tiled = written(tiled, "tiled")
    named = tiled.join(keyed.select("item_id", "item_key"), "item_key").join(read.select("doc_id", "text_key"), "text_key")
    return named.select(*schema.names)


def cleaned(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns. The leaks are few beside the corpus; Spark picks the anti join by their size."""
    leaking, key = fresh(docs, "leaking"), fresh(docs, "leaking_text")
    leaks = matches(docs, benchmark, threshold, id_col, text_col).select(F.col("doc_id").alias(leaking), F.col("text_key").alias(key)).distinct()
    return docs.join(written(leaks, "leaks"), docs[id_col].eqNullSafe(F.col(leaking)) & (text_key(docs[text_col]) == F.col(key)), "left_anti")
