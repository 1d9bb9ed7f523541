"""SimHash near-duplicates: fingerprints, a grid range join over segment popcounts, components.

Edge cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other. Equal
rows get equal results, one each. Ids keep their type; the smallest is so in that type's order. A null id never becomes a component's id unless all its ids are null. An empty table
gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import components, fresh, hex64, hot_join, written

SEED = 42
CHUNK = 1 << 16
EVEN = 0x5555555555555555  # the low bit of each of the 32 segments
THIRDS = (range(0, 11), range(11, 22), range(22, 32))  # of the segments


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text; bytes.lower and bytes.split know ASCII alone, as asked."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.concatenate(([0], np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1))
    ends = np.concatenate((starts[1:] - 1, [len(joined)]))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[-n:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, fp long")


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments (0, 1 or 2 each), packed into the place of their segments."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed embeddings, whose counts are 0 to 3. Counts that differ by 1 have the xor 01 or 11, by
    2 10, by 3 11; those of 3 and 0 are told from those of 1 and 2 by their own two bits, which are equal."""
    x = a.bitwiseXOR(b)
    even = lambda c: c.bitwiseAND(F.lit(EVEN))
    low, high = even(x), even(F.shiftrightunsigned(x, 1))
    level = even(F.bitwise_not(a.bitwiseXOR(F.shiftrightunsigned(a, 1))))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low).bitwiseOR(level)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signed(x: int) -> int:
    """64 bits as the long that they are."""
    return x - (1 << 64) if x >> 63 else x


def cells(nodes: DataFrame) -> DataFrame:
    """Each fingerprint's grid cells: in each pair of thirds of the segments its own cell and those one step away.

    Distance 4 or less overall leaves 2 or less once the third with most of it is left out, and points at 2 or less
    share a cell within one step of both; so fingerprints without a common cell are further apart than 4 in the
    popcounts, hence in the bits. A cell's left-out third is marked by a count of 3, which no segment has.
    """
    e, found = embedding(F.col("fp")), []
    for out in THIRDS:
        kept = [i for i in range(32) if i not in out]
        own = e.bitwiseAND(F.lit(signed(sum(3 << 2 * i for i in kept)))).bitwiseOR(F.lit(signed(3 << 2 * out[0])))
        ones, threes = (F.array(*(F.lit(signed(x << 2 * i)).cast("long") for i in kept)) for x in (1, 3))
        # Counts 0 and 1 differ in the low bit of their two, 1 and 2 in both.
        low = F.transform(ones, lambda m: F.when(e.bitwiseAND(F.shiftleft(m, 1)) == 0, own.bitwiseXOR(m)))
        both = F.transform(threes, lambda m: F.when(e.bitwiseAND(m) != 0, own.bitwiseXOR(m)))
        found += [F.array(own), low, both]
    return nodes.select("*", F.explode_outer(F.concat(*found)).alias("cell")).where("cell is not null")


def spread(nodes: DataFrame) -> DataFrame:
    """Nodes over all shuffle partitions: a small table otherwise makes its many cells in one or two tasks. Dealt by a
    hash of fp, since a shuffle by fp itself would be merged into the one before, whose partitions are joined if small."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))


def near_components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Components of distinct fingerprints under Hamming distance of radius (4 at most) or less: rows (fp, root).

    Rows of cells that hold one fingerprint alone go first. Each of the others' members are checked against its smallest
    and largest fingerprint; what that joins is one component. Then members of a cell are compared where their components
    differ and at least one is not the component of the cell's first member, so a large group of near copies is never
    paired with itself and no link between components is lost.
    """
    if radius > 4:
        raise ValueError("the grid covers distances of 4 or less")
    nodes = prints.select("fp").distinct()
    placed = cells(spread(nodes))
    ends = placed.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    # Spark takes a table for as large as the one whose rows were exploded, so unhinted it may send all cells through the driver.
    shared = written(placed.join(ends.hint("merge"), "cell"), "shared")
    close = lambda x, y: (x != y) & (manhattan(embedding(x), embedding(y)) <= radius) & (hamming(x, y) <= radius)
    hubs = shared.select("fp", F.explode(F.array("lo", "hi")).alias("hub")).where(close(F.col("fp"), F.col("hub")))
    first = written(components(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("b"))), "hubs").withColumnsRenamed({"node": "fp", "root": "comp"})
    comp = F.coalesce("comp", "fp").alias("comp")
    tagged = written(shared.select("cell", "fp").join(first, "fp", "left").select("cell", "fp", comp), "tagged")
    heads = tagged.groupBy("cell").agg(F.min("comp").alias("head"), F.max("comp").alias("top")).where("head <> top").drop("top")
    mixed = written(tagged.join(heads, "cell"), "mixed")
    left = mixed.where("comp <> head").select("cell", F.col("fp").alias("lf"), F.col("comp").alias("a"), "head")
    right = mixed.select(F.col("cell").alias("rc"), F.col("fp").alias("rf"), F.col("comp").alias("b"))
    # Two members outside the head's component meet in one order; those of the head's component are on the right alone.
    once = (F.col("a") != F.col("b")) & ((F.col("b") == F.col("head")) | (F.col("lf") < F.col("rf")))
    links = left.join(right, (F.col("cell") == F.col("rc")) & once & close(F.col("lf"), F.col("rf"))).select("a", "b")
    second = written(components(links), "links")
    known = nodes.join(first, "fp", "left").select("fp", comp)
    return known.join(second, F.col("comp") == F.col("node"), "left").select("fp", F.coalesce("root", "comp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), copies."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    roots = written(near_components(prints, radius), "roots")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(roots, "fp")
    classes = written(least.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_rows")), "classes")
    by_print = written(hot_join(roots, classes, "root").select("fp", "component_id", "component_rows"), "by-print")
    return hot_join(prints, by_print, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id", "component_rows")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id."""
    return kept_of(docs, near_duplicates(docs, id_col, text_col, shingle, radius), id_col)


def kept_of(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Documents whose id is their component's in found (doc_id, component_id). Documents with a null id stay only where
    their component has no other id; rows that repeat an id that stays are brought down to one."""
    found = written(found, "found")
    gone, place = fresh(docs, "gone"), fresh(docs, "place")
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone)).distinct()
    kept = docs.join(dropped, docs[id_col].eqNullSafe(F.col(gone)), "left_anti")
    # An id may stand for several texts. Only if one does is a second shuffle of the texts needed.
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(*docs.columns))
    return kept.withColumn(place, first).where(F.col(place) == 1).drop(place)
