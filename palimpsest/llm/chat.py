"""Chat formatting as prefix trees: conversations that share their first turns share those turns' text, which is emitted
once, depth first, with position ids, the intervals of ancestors that a branch attends to, and its loss mask.

Template, per turn: <|im_start|>role newline text <|im_end|> newline. Inside texts and roles a backslash is put before the
bar of every <, backslashes, | so no control string is left there, and taken out again when read. In roles line ends
are written \\n, and backslashes \\-.

A segment is the part of a conversation that no conversation before it (in the order of the prefixes' hashes) has: one
run of the tree's stream. Its text starts at position position_start of the conversation and at `start` of the stream;
tokens attend to `ancestors` (runs of the stream, in the conversation's order) and to what precedes them in the segment.
All numbers count characters, not tokens: a tokenizer that treats control strings as tokens cuts at the same places, and
its own counts of a segment's pieces take the characters' place.

Edge cases: a null role or text is empty; turns that repeat a number are ordered by role and text and all kept; rows of
a null conv_id are one conversation; a null turn comes first; an empty table gives empty tables. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import hot_join, written

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\-")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\-"), F.lit("\\"))


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, chain, leaf, turns): formatted turns in order, the hash of each prefix, and that of the whole."""
    clean = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    each = F.struct("turn", "role", "text")
    told = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("raw"))
    turns = F.transform("raw", lambda t: F.struct(F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END)).alias("text"), F.length(escaped_role(t["role"])).alias("role_length"), (t["role"] == LEARNED).alias("learned")))
    told = told.select("conv_id", turns.alias("turns"))
    longer = lambda a, t: F.concat(a, F.array(F.md5(F.concat(F.coalesce(F.get(a, F.size(a) - 1), F.lit("")), t["text"]))))
    told = told.withColumn("chain", F.aggregate("turns", F.array().cast("array<string>"), longer))
    return told.withColumn("leaf", F.get("chain", F.size("chain") - 1))


def prefix_trees(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (tree_id, segment_id, start, length, position_start, ancestors, loss, text, n_turns) and members
    (conv_id, segment_id): the segment that ends each conversation, whose ancestors and itself are the whole of it.

    ancestors: (segment_id, start, end, position) each; loss: (begin, end) positions of what is learned.
    """
    spark = rows.sparkSession
    told = written(conversations(rows), "conversations")
    members = told.select("conv_id", F.col("leaf").alias("segment_id"))
    kept = told.groupBy("leaf").agg(F.min(F.struct("conv_id")).alias("k")).select(F.col("leaf").alias("l"), F.col("k.conv_id").alias("c"))
    distinct = told.join(kept, (F.col("leaf") == F.col("l")) & F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("leaf", "chain", "turns")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(distinct.repartitionByRange(n, "chain").sortWithinPartitions("chain").withColumn("part", F.spark_partition_id()), "dealt")

    last = dealt.groupBy("part").agg(F.max("chain").alias("last"))  # a row for each of n parts
    bound = last.select(F.col("part").alias("p"), F.lag("last").over(Window.orderBy("part")).alias("bound"))
    in_part = Window.partitionBy("part").orderBy("chain")
    known = dealt.withColumn("previous", F.lag("chain").over(in_part)).join(F.broadcast(bound), F.col("part") == F.col("p"))
    previous = F.coalesce("previous", "bound", F.array().cast("array<string>"))
    same = F.size(F.filter(F.zip_with("chain", previous, lambda a, b: a.eqNullSafe(b)), lambda x: x))
    lengths = F.transform("turns", lambda t: F.length(t["text"]).cast("long"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    known = known.select("leaf", "chain", "turns", "part", F.get("chain", F.lit(0)).alias("tree_id"), same.alias("shared"), lengths.alias("lengths"))
    known = known.withColumn("position_start", total(F.slice("lengths", F.lit(1), F.col("shared"))))
    known = known.withColumn("length", total("lengths") - F.col("position_start"))
    known = written(known, "known")

    keys = ["tree_id", "part"]
    sizes = known.groupBy(*keys).agg(F.sum("length").alias("n"))
    earlier = Window.partitionBy("tree_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("length").over(Window.partitionBy(*keys).orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.slice("turns", F.col("shared") + 1, F.size("turns"))
    begin = lambda t, at: at + len(START) + t["role_length"] + 1
    step = lambda a, t: F.struct((a["at"] + F.length(t["text"])).alias("at"), F.when(t["learned"], F.concat(a["found"], F.array(F.struct(begin(t, a["at"]).alias("begin"), (a["at"] + F.length(t["text"]) - len(END)).alias("end"))))).otherwise(a["found"]).alias("found"))
    nothing = F.struct(F.col("position_start").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("found"))
    laid = known.withColumn("inside", inside).join(firsts, keys).select(
        "tree_id", F.col("leaf").alias("segment_id"), (F.col("first") + F.col("inside")).alias("start"), "length", "position_start",
        F.aggregate(own, nothing, step, lambda a: a["found"]).alias("loss"), F.array_join(F.transform(own, lambda t: t["text"]), "").alias("text"), F.size("turns").cast("long").alias("n_turns"), "chain", "shared", "lengths",
    )
    laid = written(laid, "laid")

    place = F.posexplode(F.transform("chain", lambda h, i: F.struct(h.alias("node"), total(F.slice("lengths", F.lit(1), i)).alias("at"), F.get("lengths", i).alias("size"))))
    turns = laid.select("segment_id", "start", "position_start", "shared", place.alias("i", "t")).select("segment_id", "start", "position_start", "shared", "i", "t.*")
    owned = turns.where("i >= shared").select("node", F.col("segment_id").alias("owner"), (F.col("start") - F.col("position_start")).alias("shift"))
    owned, above = written(owned, "owned"), written(turns.where("i < shared"), "above")  # a common first turn is a hot node
    runs = hot_join(above.select("segment_id", "node", "at", "size"), owned, "node").groupBy("segment_id", "owner").agg(F.min("at").alias("position"), F.max(F.col("at") + F.col("size")).alias("to"), F.first("shift").alias("shift"))
    run = F.struct("position", F.col("owner").alias("segment_id"), (F.col("position") + F.col("shift")).alias("start"), (F.col("to") + F.col("shift")).alias("end"))
    attended = runs.groupBy("segment_id").agg(F.array_sort(F.collect_list(run)).alias("ancestors"))
    kind = attended.schema["ancestors"].dataType
    segments = laid.drop("chain", "shared", "lengths").join(attended, "segment_id", "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast(kind)))
    return written(segments, "segments"), members


def whole(segments: DataFrame) -> DataFrame:
    """Rows (segment_id, text, loss) of whole conversations, put together from each segment's ancestors and itself."""
    owner = segments.select(F.col("segment_id").alias("o"), F.col("text").alias("from"), F.col("position_start").alias("p0"), F.col("loss").alias("l"))
    above = written(segments.select("segment_id", F.explode("ancestors").alias("a")).withColumn("o", F.col("a.segment_id")), "attended")
    above = hot_join(above, owner, "o")
    size = F.col("a.end") - F.col("a.start")
    ends = F.col("a.position") + size
    piece = F.substring("from", (F.col("a.position") - F.col("p0") + 1).cast("int"), size.cast("int"))
    parts = above.select("segment_id", F.col("a.position").alias("at"), piece.alias("text"), F.filter("l", lambda x: (x["begin"] >= F.col("a.position")) & (x["end"] <= ends)).alias("loss"))
    parts = parts.unionByName(segments.select("segment_id", F.col("position_start").alias("at"), "text", "loss"))
    in_order = parts.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("at", "text", "loss"))).alias("p"))
    return in_order.select("segment_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.flatten(F.transform("p", lambda x: x["loss"])).alias("loss"))


def digests(segments: DataFrame, members: DataFrame) -> DataFrame:
    """What is read back from the trees: a row per conversation, with digests of its turns and of what is learned."""
    read = whole(segments)
    blocks = F.split("text", r"<\|im_end\|>\n")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    read = read.withColumn("blocks", F.transform(blocks, lambda b: F.substring(b, len(START) + 1, 1 << 30)))
    role = lambda b: unescaped_role(F.substring_index(b, "\n", 1))
    body = lambda b: unescaped(F.substring(b, F.instr(b, "\n") + 1, F.length(b)))
    read = read.withColumn("turns", F.array_join(F.transform("blocks", lambda b: F.concat(role(b), F.lit("\n"), body(b), F.lit("\n"))), ""))
    cut = lambda x: unescaped(F.substring(F.col("text"), (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int")))
    read = read.withColumn("learned", F.array_join(F.transform("loss", cut), ""))
    told = read.select(
        "segment_id", F.size("blocks").cast("long").alias("n_turns"), F.sha2(F.encode("turns", "UTF-8"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )
    return members.join(told, "segment_id").drop("segment_id")
