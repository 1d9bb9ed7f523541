"""Sharding by balanced label propagation: documents are linked by equal texts and by given edges between texts; linked
documents move towards their neighbours' shards as far as quotas allow, documents without links make way and fill up
what is left.

Documents of one text are interchangeable neighbours of each other, so they are one node with as many places as documents.
Nodes first go whole to the shard where most of their documents are, else to their next best one; those of more than a
SHARE-th of a shard, SHARE a shard at most, first and on the driver, the largest first; a node is cut only where no shard
has room for it. Then labels spread over the edges between nodes: in each round a join brings each node its neighbours'
present shards, a node whose neighbours are mostly elsewhere asks to move there, and as many move as the shard has room
for. Rounds go on while they cut fewer edges. Counts are at most one apart.

Edge cases: a null text counts as an empty one; rows that repeat an id and a text are placed each; an empty table gives
an empty result; with fewer documents than shards the last shards stay empty; an id may be null. Columns other than the
id and the text are not read.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import before, hot_join, ranked, written

LOG = logging.getLogger(__name__)
OVERHEAD = 16  # bytes that each document adds to its text's
SHARE = 50


def by_number(values: list[int], of: Column) -> Column:
    """values[of], as a literal array of as many entries as there are shards."""
    return F.get(F.array(*(F.lit(int(v)) for v in values)), of)


def quotas(total: int, n_shards: int) -> list[int]:
    """Documents of each shard."""
    return [total // n_shards + (i < total % n_shards) for i in range(n_shards)]


def fitted(groups: list, room: list[int]) -> list[tuple[str, int, int]]:
    """Places (g, shard, n) of groups (g, all, prefs), the largest first, and takes them off room: whole in the best of
    their shards with room, else in the fullest that has room for all, else cut over the emptiest shards."""
    out = []
    for r in sorted(groups, key=lambda r: (-r["all"], r["g"])):
        left = r["all"]
        while left:
            fits = [s for s in (x["shard"] for x in r["prefs"]) if room[s] >= left] or sorted((s for s, free in enumerate(room) if free >= left), key=lambda s: room[s])
            to = fits[0] if fits else room.index(max(room))
            n = min(left, room[to])
            out.append((r["g"], to, n))
            room[to] -= n
            left -= n
    return out


def propagated(cells: DataFrame, want: list[int], rounds: int) -> DataFrame:
    """cells (g, shard, n) after all groups have found their places. want: places in each shard, for linked documents."""
    prefs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("low"), "shard"))).alias("prefs")  # n_shards entries at most
    groups = written(cells.groupBy("g").agg(F.sum("n").alias("all"), prefs), "groups")
    room, large = list(want), F.col("all") * SHARE > min(want)
    planned = fitted(groups.where(large).collect(), room)
    waiting, done = groups.where(~large), []

    def settled(aimed: DataFrame, fits: Column) -> DataFrame:
        """Keeps the groups that fit, takes them off room, and returns the others."""
        tried = written(aimed.withColumn("fits", fits), "tried")
        got = tried.where("fits").select("g", F.col("to").alias("shard"), F.col("all").alias("n"))
        for r in got.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            room[r["shard"]] -= r["n"]
        done.append(got)
        return tried.where("not fits").select("g", "all", "prefs")

    for k in range(rounds):
        aim = F.get("prefs", F.pmod(F.lit(k), F.size("prefs")))["shard"]
        aimed = written(waiting.withColumn("to", aim), "aimed")
        if aimed.isEmpty():
            break
        waiting = settled(before(aimed, ["to"], ["g"], "all", "queue"), F.col("queue") + F.col("all") <= by_number(room, F.col("to")))
    else:
        # Laid end to end over the free places, all but one group at the end of each shard lie within one.
        ends = [sum(room[: i + 1]) for i in range(len(room))]
        queued = before(written(waiting, "waiting"), [], ["g"], "all", "queue")
        aimed = queued.withColumn("to", F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= F.col("queue"))))
        waiting = settled(aimed, F.col("queue") + F.col("all") <= by_number(ends, F.col("to")))
        planned += fitted(waiting.collect(), room)
    out = cells.sparkSession.createDataFrame(planned, "g string, shard int, n long")
    for got in done:
        out = out.unionByName(got)
    return out


def node(text: Column) -> Column:
    """The node of a text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def alike(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Edges (a, b) between texts that differ in case, digits, white space and punctuation alone: each to the smallest node
    of its kind, so a kind of any size has as many edges as texts."""
    bare = F.sha2(F.trim(F.regexp_replace(F.lower(text_col), r"[^\p{L}]+", " ")), 256)
    texts = written(docs.where(F.length(text_col) > 0).select(bare.alias("kind"), node(F.col(text_col)).alias("a")).distinct(), "kinds")
    hubs = written(texts.groupBy("kind").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs")
    return hot_join(texts, hubs, "kind").where("a <> b").select("a", "b")


def cut_edges(edges: DataFrame, labels: DataFrame) -> int:
    """How many edges join different shards. labels: (g, shard), a row for each node."""
    ends = labels.withColumnsRenamed({"g": "b", "shard": "there"})
    return hot_join(written(edges.join(labels.withColumnRenamed("g", "a"), "a"), "ends"), ends, "b").where("shard <> there").count()


def spread(cells: DataFrame, edges: DataFrame, want: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """cells (g, shard, n) after label propagation over edges (a, b), each once, and the edges that are cut before and after
    each round that was kept. Nodes that lie in several shards count as in that with most of them, and stay."""
    cells, both = written(cells, "cells"), written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    first = F.max(F.struct("n", (-F.col("shard")).alias("low")))
    label = lambda c: written(c.groupBy("g").agg(first.alias("f"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")).select("g", (-F.col("f.low")).alias("shard"), "parts", "n"), "labels")
    labels = label(cells)
    cuts = [cut_edges(edges, labels.select("g", "shard"))]
    for k in range(rounds):
        if not cuts[-1]:
            break
        told = hot_join(both, labels.select(F.col("g").alias("b"), "shard"), "b")
        votes = told.groupBy("a", "shard").agg(F.count(F.lit(1)).alias("votes")).join(labels.select(F.col("g").alias("a"), F.col("shard").alias("own"), "parts", "n"), "a")
        ranked_votes = votes.groupBy("a", "own", "parts", "n").agg(F.max(F.struct("votes", (-F.col("shard")).alias("low"))).alias("best"), F.coalesce(F.max(F.when(F.col("shard") == F.col("own"), F.col("votes"))), F.lit(0)).alias("held"))
        # Half of the nodes at a time, or two neighbours would change places for ever.
        turn = F.pmod(F.xxhash64("a", F.lit(k)), F.lit(2)) == 0
        asking = ranked_votes.where((F.col("best.votes") > F.col("held")) & (F.col("parts") == 1) & turn)
        asking = written(asking.select(F.col("a").alias("g"), (-F.col("best.low")).alias("to"), "n"), "asking")
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [w - load.get(i, 0) for i, w in enumerate(want)]
        queued = before(asking, ["to"], ["g"], "n", "queue")
        moving = written(queued.where(F.col("queue") + F.col("n") <= by_number(room, F.col("to"))).select("g", F.col("to").alias("shard"), "n"), "moving")
        following = written(cells.join(moving.select("g"), "g", "left_anti").unionByName(moving), "cells")
        now = label(following)
        cut = cut_edges(edges, now.select("g", "shard"))
        if cut >= cuts[-1]:
            break
        cells, labels = following, now
        cuts.append(cut)
    return cells, cuts


def shards(docs: DataFrame, n_shards: int = 40, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", edges: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, linked) of all documents, law "rows". edges: further
    links (a, b) between nodes, see node(); documents of equal texts are linked without."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n_shards)).cast("int")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), node(text).alias("g"), start.alias("shard")
    )
    rows = written(rows, "rows")
    total = rows.count()
    cells = rows.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
    linked = cells.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").select("g")
    if edges is not None:
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        edges = edges.join(rows.select(F.col("g").alias("a")).distinct(), "a", "left_semi").join(rows.select(F.col("g").alias("b")).distinct(), "b", "left_semi")
        edges = written(edges, "given")
        linked = linked.unionByName(edges.select(F.explode(F.array("a", "b")).alias("g"))).distinct()
    cells = propagated(written(cells.join(linked, "g"), "cells"), quotas(total, n_shards), rounds)
    if edges is not None:
        cells, cuts = spread(cells, edges, quotas(total, n_shards), rounds)
        LOG.info("edges cut, before and after each round: %s", cuts)
    spans = cells.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("spans"))  # n_shards entries at most
    spans = written(spans, "spans")
    alone = rows.join(spans.select("g"), "g", "left_anti")
    members = hot_join(written(rows.join(spans.select("g"), "g", "left_semi"), "linked"), spans, "g").select(*rows.columns, "spans")
    members = ranked(written(members, "members"), ["g"], ["doc_id", "text_crc32", "size"], "r")
    upto = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit(-1).alias("s")), lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.when((a["s"] < 0) & (F.col("r") < a["at"] + x["n"]), x["shard"]).otherwise(a["s"]).alias("s")), lambda a: a["s"])
    placed = members.withColumn("shard", upto).select("doc_id", "size", "text_crc32", "shard", F.lit(1).alias("linked"))
    placed = written(placed.unionByName(alone.select("doc_id", "size", "text_crc32", "shard", F.lit(0).alias("linked"))), "placed")
    return repaired(placed, total, n_shards)


def repaired(placed: DataFrame, total: int, n_shards: int) -> DataFrame:
    """Moves as few documents as the law asks for, those without links first, and numbers each shard's places."""
    held = [[0, 0] for _ in range(n_shards)]
    for r in placed.groupBy("shard", "linked").count().collect():
        held[r["shard"]][r["linked"]] = r["count"]
    want = quotas(total, n_shards)
    load = [a + b for a, b in held]
    surplus = [max(0, have - w) for have, w in zip(load, want)]
    lack = [max(0, w - have) for have, w in zip(load, want)]
    sums = lambda xs: [sum(xs[:i]) for i in range(len(xs))]
    out_first, in_first = sums(surplus), sums(lack)
    stay = [have - s for have, s in zip(load, surplus)]
    order = ranked(placed, ["shard", "linked"], ["doc_id", "text_crc32", "size"], "r")
    e = F.col("r") + F.when(F.col("linked") == 1, by_number([a for a, _ in held], F.col("shard"))).otherwise(0)
    told = order.withColumn("e", e).withColumn("over", by_number(surplus, F.col("shard")))
    told = told.withColumn("gone", F.when(F.col("e") < F.col("over"), F.col("e") + by_number(out_first, F.col("shard"))))
    to = F.lit(None).cast("int")
    for i in range(n_shards):  # the shard among whose free places number `gone` is
        if lack[i]:
            to = F.when((F.col("gone") >= in_first[i]) & (F.col("gone") < in_first[i] + lack[i]), F.lit(i)).otherwise(to)
    told = told.withColumn("to", to)
    slot = F.when(F.col("gone").isNull(), F.col("e") - F.col("over")).otherwise(by_number(stay, F.col("to")) + F.col("gone") - by_number(in_first, F.col("to")))
    return told.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.coalesce("to", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), (F.col("linked") == 1).alias("linked"))
