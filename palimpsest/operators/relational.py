"""Relational building blocks that reports, listings and ingest share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def made_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns behind inline: what refers to them later doesn't write their expressions out again, as merged
    projections and pushed filters would."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions by its keys: a file of small rows is otherwise read by one task, which then does all the
    work that is made of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def latest(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """The last row of each group by these columns; ties settle on the later columns. Rows aren't sorted: a partial maximum goes before the shuffle."""
    rest = [c for c in df.columns if c not in group and c not in by]
    top = df.groupBy(*group).agg(F.max(F.struct(*by, *rest)).alias("top"))
    return top.select(*group, *(F.col(f"top.{c}").alias(c) for c in by + rest))


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank from 1. Catalyst limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page; order has to end with a key."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "children") -> DataFrame:
    """Parents with the number of their children, 0 without any; children are counted before the join."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys that are asked for and not there."""
    return wanted.join(there.select(key).distinct(), key, "left_anti")


def idempotent(new: DataFrame, there: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of new to insert: the first of each key that isn't there yet. Rows with a null among the keys never collide."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    first = new.where(~null).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(there.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new.where(null))


def versioned(current: DataFrame, incoming: DataFrame, keys: list[str], content: str) -> DataFrame:
    """A versioned upsert: (keys, version, content, active, change). New keys start at 1; changed ones close the current
    version and add the next; what doesn't come in again stays as it is."""
    old = current.select(*keys, F.col("version").alias("v"), F.col(content).alias("old"))
    new = incoming.select(*keys, F.col(content).alias("new"))
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("v").isNull(), "inserted").when(F.col("new").isNull() | F.col("new").eqNullSafe(F.col("old")), "kept").otherwise("changed")
    both = both.withColumn("change", change)
    row = lambda v, c, a: F.struct(v.cast("int").alias("version"), c.alias(content), F.lit(a).alias("active"))
    rows = (
        F.when(F.col("change") == "inserted", F.array(row(F.lit(1), F.col("new"), True)))
        .when(F.col("change") == "kept", F.array(row(F.col("v"), F.col("old"), True)))
        .otherwise(F.array(row(F.col("v"), F.col("old"), False), row(F.col("v") + 1, F.col("new"), True)))
    )
    return both.select(*keys, "change", F.explode(rows).alias("r")).select(*keys, "change", "r.*")


def islands(df: DataFrame, group: list[str], order: list[str], path: list[str], value: str) -> DataFrame:
    """Runs of rows with the same path: (group, path, island, first, last, items). A path that comes back later is another run."""
    w = Window.partitionBy(*group).orderBy(*order)
    differs = F.lit(False)
    for p in path:
        differs = differs | ~F.col(p).eqNullSafe(F.lag(p).over(w))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("__new", (differs | first).cast("int")).withColumn("island", F.sum("__new").over(w))
    return marked.groupBy(*group, "island", *path).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("items"))


def numbered_keys(df: DataFrame, key: str, order: list[str], out: str = "label") -> DataFrame:
    """Repeated keys told apart: X, X (2), X (3)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", n).withColumn(out, F.when(F.col("__n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit(" ("), F.col("__n").cast("string"), F.lit(")")))).drop("__n")


def filled_levels(df: DataFrame, group: list[str], order: list[str], levels: list[str]) -> DataFrame:
    """Headings carried down to the rows below them; a heading ends when one of a higher level follows it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out, higher = df, F.lit(0)
    for level in levels:
        at = F.last(F.when(F.col(level).isNotNull(), F.struct(*order)), ignorenulls=True).over(w)
        out = out.withColumn(f"__at_{level}", F.coalesce(at[order[-1]].cast("long"), F.lit(-1)))
        out = out.withColumn(f"__v_{level}", F.last(level, ignorenulls=True).over(w))
    for level in levels:
        out = out.withColumn(f"{level}_filled", F.when(F.col(f"__at_{level}") >= higher, F.col(f"__v_{level}")))
        higher = F.greatest(higher, F.col(f"__at_{level}"))
    return out.drop(*[f"__{k}_{level}" for k in ("at", "v") for level in levels])


def round_robin(df: DataFrame, group: str, rank: str, item: str, cap: int) -> DataFrame:
    """Items taken from the groups in turn, each item once, cap in all: (place, group, item). Nothing but `cap` rows meets in one task."""
    first = df.groupBy(item).agg(F.min(F.struct(rank, group)).alias("f")).select(F.col(f"f.{rank}").alias(rank), F.col(f"f.{group}").alias(group), item)
    cut = first.orderBy(rank, group, item).limit(cap)
    return cut.withColumn("place", F.row_number().over(Window.orderBy(rank, group, item))).select("place", group, item)


def digest_tree(df: DataFrame, key: Column, digest: Column, fan: int = 2, deepest: int | None = None) -> DataFrame:
    """One row (hash, n): a digest of all rows, whatever their order, as a tree over the hex digits of their keys' MD5.

    A level of the tree has 16 ** fan children to a node, and there are as many levels as leaves of about that many keys
    need, so no task holds many more digests than a node has children, however sparse the keys are. Rows that repeat key
    and digest are counted before they meet; a null is told from an empty text. An empty table gives no row. deepest: no
    more levels below the root than these, whatever the number of keys, of which a leaf then holds more.
    """
    width = 16**fan
    told = df.select(F.coalesce(key.cast("string"), F.lit("\0")).alias("k"), F.coalesce(digest, F.lit("\0")).alias("d")).groupBy("k", "d").agg(F.count(F.lit(1)).alias("n"))
    rows = told.select(F.md5("k").alias("path"), F.concat_ws(":", "k", "d", F.col("n").cast("string")).alias("h"), "n")
    keys, depth = told.select("k").distinct().count(), 0
    while keys > width ** (depth + 1) and depth != deepest:
        depth += 1
    for level in range(depth, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("path", "h")))
        rows = rows.groupBy(F.substring("path", 1, fan * level).alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda x: x["h"]), "\n"), 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "path")
    return rows.select(F.col("h").alias("hash"), "n")
