"""Ranked retrieval beyond the lexical channel: exact cosine, reciprocal-rank fusion and thematic reranking, for many queries in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.functions.text import WORD, fold, occurs, roots
from palimpsest.operators.lexical import sent
from palimpsest.operators.relational import dealt, top_n

K = 60
SENT_NUMBERS = 4_000_000  # in the vectors of a block of queries, at most, which are sent to every task
ROWS = 1024  # vectors that are scored at once against as many queries
#: Text of a semantic query, whose vector comes from outside, and the vectors' version of a corpus entry.
VERSION = "norma-v2"
NO_VECTORS, NO_SERVICE = "No hay embeddings actuales; se utilizó la búsqueda léxica.", "El servicio local de inteligencia artificial no está disponible. Se utilizó la búsqueda léxica."


def fallback(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """Results of the narrow search; of the wide one for queries that found nothing."""
    return narrow.unionByName(wide.join(narrow.select("query_id").distinct(), "query_id", "left_anti"))


def packed_vectors(df: DataFrame, id_col: str, vec_col: str, names: tuple[str, str], rows: int) -> DataFrame:
    """Rows (names, size): the ids of up to `rows` vectors of one size, and their components as bytes of doubles. Vectors that
    are null or hold a null, and null ids, go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, sizes = batch.column(1), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), rows):
                    take = pa.array(at[i : i + rows])
                    values = vecs.take(take).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    ids = batch.column(0).take(take)
                    yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([values.tobytes()]), pa.array([size], pa.int32())], [*names, "size"])

    known = df.select(id_col, F.col(vec_col).cast("array<double>").alias("__v")).where(F.col(id_col).isNotNull() & F.col("__v").isNotNull() & ~F.exists("__v", lambda x: x.isNull()))
    return known.mapInArrow(run, f"{names[0]} array<{known.schema[id_col].dataType.simpleString()}>, {names[1]} binary, size int")


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and of b, each summed from the first component to the last."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def best_cosines(v: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of q the k rows of v with the highest cosines, and those that equal the last of them, unless they are below
    the row's least: (rows of q, rows of v, cosines). A product of matrices says which rows come near; these are summed in
    order, so that equal vectors get equal cosines wherever they stand."""
    vn, qn = np.sqrt(in_order(v, v)), np.sqrt(in_order(q, q))
    with np.errstate(all="ignore"):
        norms = np.outer(qn, vn)
        rough = (q @ v.T) / norms
        rough[np.isnan(rough)] = np.inf
        rough[norms == 0] = -np.inf
        low = least if k >= len(v) else np.maximum(least, np.partition(rough, len(v) - k, axis=1)[:, len(v) - k])
        i, j = np.nonzero((rough >= low[:, None] - 1e-9) & (norms != 0))
        return i, j, in_order(v[j], q[i]) / (vn[j] * qn[i])


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact: each stated query against every vector; (query_id, id, score, rank). queries: (query_id, q). A block of them,
    SENT_NUMBERS at most, is sent to every task, where a product of matrices scores ROWS vectors against ROWS queries; of
    each task's vectors go on what can be among a query's first k. Vectors of another dimension or norm 0 don't score."""
    spark = vectors.sparkSession
    typed = queries.schema["query_id"].dataType
    names = f"query_id {typed.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    known = dealt(vectors.select("id", F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)"), "id")
    size = queries.agg(F.coalesce(F.sum(F.size("q")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // SENT_NUMBERS)), None
    for block in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        asked = packed_vectors(some, "query_id", "q", ("qids", "qs"), ROWS).where("size > 0").collect()
        held = spark.sparkContext.broadcast([(pa.array(r["qids"], to_arrow_type(typed)), bytes(r["qs"]), r["size"]) for r in asked])
        scored = known.mapInArrow(lambda batches, held=held: scored_against(batches, held.value, k), names)
        best = top_n(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)
        out = best if out is None else out.unionByName(best)
    return out


def scored_against(batches: Iterator[pa.RecordBatch], queries: list[tuple[pa.Array, bytes, int]], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, id, score) of vectors (id, v) that can be among the first k of a query (ids, components, size)."""
    best = [np.full((len(ids), k), -np.inf) for ids, _, _ in queries]
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for n, (qids, qs, size) in enumerate(queries):
            q, mine = np.frombuffer(qs, np.float64).reshape(-1, size), np.flatnonzero(sizes == size)
            for at in (mine[i : i + ROWS] for i in range(0, len(mine), ROWS)):
                ids = batch.column(0).take(pa.array(at))
                v = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                i, j, score = best_cosines(v, q, k, best[n].min(axis=1))
                place = np.argsort(pc.sort_indices(ids).to_numpy())  # of the ids in order
                order = np.lexsort((place[j], -score, ~np.isnan(score), i))
                i, j, score = i[order], j[order], score[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, score, rank = (x[rank < k] for x in (i, j, score, rank))
                new = np.full((len(q), k), -np.inf)
                new[i, rank] = np.where(np.isnan(score), np.inf, score)
                best[n] = np.sort(np.concatenate((best[n], new), axis=1), axis=1)[:, k:]
                yield pa.record_batch([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], ["query_id", "id", "score"])


def fuse(lists: DataFrame, k: int = K) -> DataFrame:
    """Reciprocal-rank fusion of rows (query_id, list, doc_id, rank): a document counts once a list, at its best rank."""
    if k < 1:
        raise ValueError("k has to be 1 or more")
    once = lists.groupBy("query_id", "list", "doc_id").agg(F.min("rank").alias("rank"))
    return once.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists side by side: (query_id, doc_id, rank_a, rank_b)."""
    a, b = first.select("query_id", "doc_id", F.col("rank").alias("rank_a")), second.select("query_id", "doc_id", F.col("rank").alias("rank_b"))
    return a.join(b, ["query_id", "doc_id"], "full_outer")


def anchors(concepts: DataFrame, text_col: str = "concept") -> DataFrame:
    """The root that most of a query's concepts share, if at least two do: (query_id, anchor). Ties go to the first root in order."""
    each = concepts.select("query_id", F.explode(roots(F.col(text_col))).alias("root")).groupBy("query_id", "root").agg(F.count(F.lit(1)).alias("n"))
    return top_n(each.where("n > 1"), ["query_id"], [F.col("n").desc(), F.col("root")], 1).select("query_id", F.col("root").alias("anchor"))


def affinity(anchor: Column, asked: Column, heading: Column, body: Column) -> Column:
    """6 if the anchor is among the heading's or body's roots, 2 for each asked root in the heading, 1 for each in the body."""
    in_heading, in_body = F.size(F.array_intersect(asked, roots(heading))), F.size(F.array_intersect(asked, roots(body)))
    has = F.coalesce(F.array_contains(F.array_union(roots(heading), roots(body)), anchor), F.lit(False))
    return F.when(has, 6).otherwise(0) + 2 * in_heading + in_body


def expanded(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The text with the concepts of the rules that its folded form matches, each word once, behind it."""
    plain = fold(text)
    found = F.array(*(F.when(occurs(plain, p), F.split(F.lit(c), " ")) for p, c in rules))
    extra = F.array_distinct(F.flatten(F.filter(found, lambda x: x.isNotNull())))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", text, F.array_join(extra, " "))).otherwise(text)


def concepts(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The concepts (each a text of words) of the rules that a text's folded form matches, in the rules' order."""
    plain = fold(text)
    return F.filter(F.array(*(F.when(occurs(plain, p), F.lit(c)) for p, c in rules)), lambda x: x.isNotNull())


def semantic_text(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """What a query's vector is made of: the question, and its concepts behind it."""
    found = concepts(text, rules)
    return F.when(F.size(found) > 0, F.concat(text, F.lit("\nConceptos de búsqueda: "), F.array_join(found, "; "))).otherwise(text)


def entry_text(df: DataFrame, columns: list[str]) -> Column:
    """What a corpus entry's vector is made of: its columns that aren't empty, one a line."""
    return F.concat_ws("\n", *(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in columns))


def entry_hash(df: DataFrame, columns: list[str]) -> Column:
    """The versioned hash of a corpus entry: of all its columns as JSON, keys in order, so any change makes its vector stale."""
    told = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(VERSION + "\n"), told), 256)


def pertinent(question: Column, heading: Column, body: Column) -> Column:
    """Whether an entry may answer: a question on contractual liability takes those that name both a failure and its consequence."""
    whole = fold(F.concat_ws(" ", heading, body))
    has = lambda *parts: F.rlike(whole, F.lit("|".join(parts)))
    both = has("incumpl", "no cumple", "no cumpl", "retras", "mora") & has("resarc", "dano", "perjuicio", "responsab")
    return ~F.contains(fold(question), F.lit("responsabilidad contractual")) | both


def focal(candidates: DataFrame, priority: Column, n: int) -> DataFrame:
    """Of a wide candidate list (query_id, doc_id, score, ...) the n that come first by priority, then score, then id, ranked anew."""
    return top_n(candidates.withColumn("priority", priority).drop("rank"), ["query_id"], [F.col("priority").desc(), F.col("score").desc(), F.col("doc_id")], n)


def snippet(text: Column, first: Column, most: int = 40, least: int = 15) -> Column:
    """A run of at most `most` words that begins at the word with place `first` (lexical.placed_words); where fewer than
    `least` words follow it, the last `least`."""
    whole = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    held = F.transform(whole, lambda w: F.size(F.filter(F.split(fold(w), WORD), lambda x: x != "")))
    step = lambda s, n: F.when(s["seen"] >= first, s).otherwise(F.struct((s["seen"] + n).alias("seen"), (s["at"] + 1).alias("at")))
    hit = F.aggregate(held, F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at")), step, lambda s: s["at"])
    return F.array_join(F.slice(whole, F.greatest(F.lit(1), F.least(hit, F.size(whole) - least + 1)), F.lit(most)), " ")


def hybrid(lexical: DataFrame, semantic: DataFrame, queries: DataFrame, docs: DataFrame, limit: int, k: int = K) -> DataFrame:
    """Two channels fused, reordered by what queries and entries are about, filtered by pertinence: (query_id, doc_id,
    affinity, score, place, mode, warning).

    lexical, semantic: (query_id, doc_id, rank). queries: (query_id, text, concepts), a stated set. docs: (doc_id, heading,
    body). Without concepts the order is that of the fusion. A query without semantic results is served by the lexical
    channel alone and says so. The channels are read more than once.
    """
    lists = lexical.select("query_id", "doc_id", "rank", F.lit("lexical").alias("list")).unionByName(semantic.select("query_id", "doc_id", "rank", F.lit("semantic").alias("list")))
    fused = fuse(lists, k).withColumn("score", F.round("score", 9))
    told = queries.select("query_id", F.col("text").alias("question"), F.array_distinct(F.flatten(F.transform("concepts", roots))).alias("asked"), "concepts")
    anchored = told.join(anchors(queries.select("query_id", F.explode("concepts").alias("concept"))), "query_id", "left")
    found = docs.join(sent(fused), "doc_id").join(anchored, "query_id")
    found = found.where(pertinent(F.col("question"), F.col("heading"), F.col("body")))
    near = F.when(F.size("concepts") > 0, affinity(F.col("anchor"), F.col("asked"), F.col("heading"), F.col("body"))).otherwise(0)
    ranked = top_n(found.select("query_id", "doc_id", "score", near.alias("affinity")), ["query_id"], [F.col("affinity").desc(), F.col("score").desc(), F.col("doc_id")], limit, "place")
    return degraded(ranked, semantic)


def degraded(results: DataFrame, semantic: DataFrame) -> DataFrame:
    """results with mode and warning: queries that the semantic channel has nothing for are served by the lexical one alone."""
    there = semantic.select("query_id", F.lit(True).alias("both")).distinct()
    marked = results.join(there, "query_id", "left")
    mode = F.when(F.col("both"), "hibrida").otherwise("lexica")
    return marked.withColumn("mode", mode).withColumn("warning", F.when(F.col("both").isNull(), F.lit(NO_VECTORS))).drop("both")


def by_problem(lexical: DataFrame, semantic: DataFrame, fits: DataFrame | None, each: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """One search for each problem of each case: (results, allotment). lexical, semantic: (case, problem, doc_id, rank);
    fits: (problem, doc_id) that may be used, null: all.

    Lists are fused within the problem, its best `each` kept. Results are dealt in rounds, so that no problem goes without
    while another has several; a document stands once in a case, which has `cap` at most: (case, place, doc_id, score).
    The allotment says which of the results each problem may cite: (case, problem, position, doc_id).
    """
    keys = ["case", "problem", "doc_id"]
    once = lambda df, name: df.groupBy(*keys).agg(F.min("rank").alias("rank")).withColumn("list", F.lit(name))
    lists = once(lexical, "lexical").unionByName(once(semantic, "semantic"))
    fused = lists.groupBy(*keys).agg(F.round(F.sum(F.lit(1.0) / (F.lit(K) + F.col("rank"))), 9).alias("score"))
    if fits is not None:
        fused = fused.join(fits, ["problem", "doc_id"], "left_semi")
    chosen = top_n(fused, ["case", "problem"], [F.col("score").desc(), F.col("doc_id")], each, "position")
    first = chosen.groupBy("case", "doc_id").agg(F.min(F.struct("position", "problem", "score")).alias("f"))
    results = top_n(first.select("case", "doc_id", "f.*"), ["case"], [F.col("position"), F.col("problem")], cap, "place")
    allotment = chosen.join(results.select("case", "doc_id"), ["case", "doc_id"]).select("case", "problem", "position", "doc_id")
    return results.select("case", "place", "doc_id", "score"), allotment
