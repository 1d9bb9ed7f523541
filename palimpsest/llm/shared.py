"""Helpers that every operator of this subpackage uses: the shared folder, lineage cuts, ranks and components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.store import shared_root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs a reread, not a recompute."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes the files behind a frame made by written(); call it once nothing reads the frame any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, with underscores behind it while it is taken."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than one row in this many of all is hot; so there are at most as many hot keys.
HOT_PART, HOT_BYTES = 1000, 16 << 20


HOT_SALTS = 32


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right on key, a column of both that is unique in right. The rows of right whose key many rows of
    left have, HOT_PART at most, are sent to every task where together they are HOT_BYTES at most; where they are more, a
    hot key's rows are dealt over HOT_SALTS tasks and meet a copy of its row in each. So no task gets all of a hot key's
    rows; all other keys meet in a shuffle. left and right are read twice, so pass written ones."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = left.count()
    hot = counts.where(F.col("__n") * HOT_PART > total).select(key)
    few = right.join(F.broadcast(hot), key, "left_semi")
    size = few.agg(F.sum(F.octet_length(F.to_json(F.struct(*few.columns))))).first()[0] or 0
    if not size:
        return left.join(right, key)
    few = written(few, "hot")
    mine = few.select(key)
    if size <= HOT_BYTES:
        hot_rows = left.join(F.broadcast(few), key)
    else:
        salted = left.join(F.broadcast(mine), key).withColumn("__salt", F.floor(F.rand(1) * HOT_SALTS).cast("int"))
        hot_rows = salted.join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1)))), [key, "__salt"]).drop("__salt")
    return hot_rows.unionByName(left.join(F.broadcast(mine), key, "left_anti").join(right, key))


FILTER_BITS = 26  # of a key: a filter has 8 MB whatever the corpus' size


def filter_of(keys: DataFrame) -> Broadcast:
    """Bits that are set for each of the keys (column fp, a long), broadcast: 2 ** FILTER_BITS bits, whatever their number."""
    place = f"(fp & {(1 << FILTER_BITS) - 1})"
    words = keys.selectExpr(f"shiftright({place}, 6) AS w", f"shiftleft(1L, CAST({place} & 63 AS INT)) AS bit")
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 for each key that a filter of filter_of() may stand for, 0 for one that it surely doesn't."""
    place = keys & ((1 << FILTER_BITS) - 1)
    return bits[place >> 6] >> (place & 63) & 1


def before(df: DataFrame, group: list[str], order: list[str], value: str | None, out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds out: the sum of value (None: 1) over the rows that come before in their group, in a fixed order by hash,
    without one task for a whole group.

    Rows of a group are dealt into hash buckets of about rows_per_bucket; a bucket starts from the sum of the buckets
    before it. df is read three times, so pass a written one. order: the columns that tell rows apart; rows equal in all
    of them are interchangeable. Null keys count as a group of their own.
    """
    buckets = max(8, -(-df.count() // rows_per_bucket))
    amount = F.col(value) if value else F.lit(1)
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "__b"]
    sizes = dealt.groupBy(*keys).agg(F.sum(amount).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("__r", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    for k in keys:
        first = first.withColumnRenamed(k, f"__k_{k}")
    same = F.lit(True)
    for k in keys:
        same = same & inside[k].eqNullSafe(first[f"__k_{k}"])
    return inside.join(first, same).withColumn(out, F.col("__first") + F.col("__r")).drop("__b", "__r", "__first", *[f"__k_{k}" for k in keys])


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds out: a gapless rank from 0 within each group."""
    return before(df, group, order, None, out)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each a grouping and a join, written to the
    shared folder. No node's neighbours are ever gathered. Isolated nodes don't appear; no edges give no rows.
    """
    state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:  # each round lowers the sum of the labels or is the last
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(low.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = turned.unionByName(low.withColumnRenamed("m", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        following = written(small, "edges")
        now = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(state)
        state = following
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def hex64(c: Column) -> Column:
    """A long's 64 bits as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")
