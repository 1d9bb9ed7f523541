"""Registered queries: text functions, classification, extraction, retrieval and grounding over the driver's texts.

The driver's texts are invented, so dictionaries are given words that occur in them; the Spanish legal ones are tested
on their own texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dictionaries as D
from palimpsest.functions import text as X
from palimpsest.operators import documents as O
from palimpsest.operators import lexical as L
from palimpsest.operators import grounding as G
from palimpsest.operators import retrieval as R
from palimpsest.operators.store import written
from palimpsest.plans.lexical_sql import ASK, HITS, POST, RANKED, TOKENS, placed, stems

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        from palimpsest.plans.driver_catalog import tables_of

        QUERIES[f.__name__] = lambda spark, sf_dir: f(tables_of(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


DRIVER_CLASSES = {"english": (("the", 1.0), ("that", 1.5), ("with", 1.0)), "german": (("der", 1.0), ("und", 1.5), ("nicht", 1.0)), "french": (("les", 1.0), ("dans", 1.5), ("est", 1.0)), "spanish": (("que", 1.0), ("para", 1.5), ("las", 1.0))}


def class_sql(table: str, key: str, text: str, classes: dict, threshold: float, otherwise: str) -> str:
    sums = {n: " + ".join(f"CASE WHEN regexp_matches(t, '{X.term_pattern(w)}') THEN {v} ELSE 0 END" for w, v in terms) for n, terms in classes.items()}
    scored = ", ".join(f"({s})::DOUBLE AS s_{n}" for n, s in sums.items())
    best = "greatest(" + ", ".join(f"s_{n}" for n in classes) + ")"
    pick = " ".join(f"WHEN s_{n} = m THEN '{n}'" for n in classes)
    return f"""SELECT {key}, CASE WHEN m < {threshold} THEN {otherwise} {pick} END AS class, CASE WHEN m < {threshold} THEN 0 ELSE m END AS class_score FROM
        (SELECT *, {best} AS m FROM (SELECT {key}, {scored} FROM (SELECT {key}, strip_accents(lower({text})) AS t FROM {table})))"""


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def fold_accents(t):
    return t("documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS h FROM (SELECT doc_id, {TOKENS.format('text', 3)} AS w FROM documents)")
def tokenize(t):
    w = t("documents").select("doc_id", X.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("h"))


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(strip_accents(lower(p_name || ' ' || p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 20), '_+$', ''), ''), 'documento') AS slug FROM part""")
def slug(t):
    return t("part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_type"), 20).alias("slug"))


@query("""SELECT doc_id, count(*) AS windows, CAST(sum(p) AS BIGINT) AS places, md5(string_agg(w, '|' ORDER BY p)) AS h FROM
       (SELECT doc_id, p, substr(text, p + 1, 1200) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text), 1050)) AS p FROM documents)) WHERE length(trim(w, ' ')) >= 40 GROUP BY 1""")
def window_chunks(t):
    rows = t("documents").where("length(text) > 0").select("doc_id", F.explode(X.windows(F.col("text"))).alias("w")).select("doc_id", "w.*")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("at").alias("places"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "|")).alias("h"))


@query(class_sql("documents", "doc_id", "text", DRIVER_CLASSES, 1.0, "NULL"))
def classify_area(t):
    return O.classified(t("documents").select("doc_id", "text"), "text", DRIVER_CLASSES, 1.0).drop("text")


@query(class_sql("documents", "doc_id", "text", DRIVER_CLASSES, 3.0, "'otro'"))
def classify_type(t):
    return O.classified(t("documents").select("doc_id", "text"), "text", DRIVER_CLASSES, 3.0, D.OTHER_TYPE).drop("text")


def alt(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


@query(f"""SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 'consulta_general' WHEN NOT contains(text, '?') AND regexp_matches(f, '{alt(D.ANALYSE)}') THEN 'analizar_documento'
       WHEN NOT contains(text, '?') AND regexp_matches(f, '{alt(D.SAVE)}') THEN 'guardar_documento' WHEN regexp_matches(f, '{alt(D.LAW)}') AND regexp_matches(f, '{alt(D.DOCUMENT)}') THEN 'consulta_documento_normativa'
       WHEN regexp_matches(f, '{alt(D.LAW)}') THEN 'consulta_general' ELSE 'consulta_documento' END AS intent FROM (SELECT *, strip_accents(lower(text)) AS f FROM conversations)""")
def detect_intent(t):
    return t("conversations").select("conv_id", "turn", O.intent(F.col("text"), F.col("role") == "user").alias("intent"))


@query(f"""SELECT conv_id, turn, CASE WHEN length(text) >= 400 OR length(text) - length(replace(text, '?', '')) >= 2 THEN true ELSE false END AS complex FROM conversations""")
def complex_case(t):
    return t("conversations").select("conv_id", "turn", ((F.length("text") >= 400) | (F.regexp_count("text", F.lit(r"\?")) >= 2)).alias("complex"))


@query()
def extract_entities(t):
    """Findings with their offsets; rows only, for SQL gives no offsets."""
    rows = t("documents").select("doc_id", F.explode(O.findings("text")).alias("f"))
    return rows.select("doc_id", "f.*")


@query()
def segment_clauses(t):
    return t("documents").select("doc_id", F.explode_outer(O.clauses("text")).alias("c")).select("doc_id", "c.orden", "c.inicio", "c.fin")


@query()
def risk_rules_all(t):
    """All rules over all documents, each with the type that its text has. Rows only: SQL on the other side gives no clauses."""
    docs = O.classified(t("documents").select("doc_id", "text"), "text", D.TYPES, D.TYPE_THRESHOLD, D.OTHER_TYPE)
    found = docs.withColumns({"clauses": O.clauses("text"), "findings": O.findings("text")})
    return O.risks(found, "text", "class", "clauses", "findings").select("doc_id", F.col("class").alias("kind"), F.explode("risks").alias("r")).select("doc_id", "kind", "r.codigo", "r.severidad", "r.evidencia", "r.clausula")


def with_next(t, *columns):
    """Documents beside the one with the next number: their columns, and those of the next with `next_` before them."""
    docs = t("documents")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), *(F.col(c).alias(f"next_{c}") for c in columns))
    return docs.select("doc_id", *columns).join(following, "doc_id")


@query()
def diff_paragraphs(t):
    """Each document beside the one with the next number, by paragraphs. SQL has no alignment; tested against plain loops."""
    return with_next(t, "text").select("doc_id", F.explode(O.compared("text", "next_text")).alias("c")).select("doc_id", "c.tipo", "c.ubicacion", "c.anterior", "c.nuevo", "c.explicacion")


@query("SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[correo]', 'g'), '(Bs|USD|US\\$)\\.? ?[0-9][0-9.,]*', '[monto]', 'g'), '[0-9]{5,}', '[numero]', 'g'), '[A-Z][a-z]+ [A-Z][a-z]+', '[nombre]', 'g'), 1, 300) AS redacted FROM documents")
def redact(t):
    return t("documents").select("doc_id", O.redacted(F.col("text")).alias("redacted"))


# A piece ends behind the last sentence end in its 350 characters, else the last line end, else the last space, else there.
CUT = r"""CASE WHEN length(rest) <= 350 THEN length(rest) WHEN regexp_matches(head, '[.;!?]\s') THEN length(regexp_extract(head, '^(.*[.;!?]\s)', 1, 's')) WHEN contains(head, chr(10)) THEN length(regexp_extract(head, '^(.*\n)', 1, 's'))
         WHEN contains(head, ' ') THEN length(regexp_extract(head, '^(.* )', 1, 's')) ELSE 350 END"""


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, -1 AS j, text AS rest, substr(text, 1, 350) AS head, '' AS piece FROM documents WHERE text <> '' UNION ALL
       SELECT doc_id, j + 1, substr(rest, {CUT} + 1), substr(rest, {CUT} + 1, 350), substr(rest, 1, {CUT}) FROM c WHERE rest <> '')
       SELECT doc_id, CAST(j AS INTEGER) AS j, sha256(piece) AS piece, length(piece) AS n FROM c WHERE j >= 0""")
def cite_chunks(t):
    """Pieces of a text at most 350 characters long, cut behind sentences, lines or spaces; joined they are the text."""
    rows = t("documents").where("text <> ''").select("doc_id", F.posexplode(O.citable("text")).alias("j", "piece"))
    return rows.select("doc_id", "j", F.sha2("piece", 256).alias("piece"), F.length("piece").cast("long").alias("n"))


@query("SELECT page_id, md5(regexp_replace(replace(html, chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')) AS h, length(regexp_replace(html, '[ \\t\\n\\r\\f\\v]', '', 'g')) >= 200 AS long_enough FROM pages")
def ingest_normalize(t):
    from palimpsest.sources.ingest import bare_length, normalised

    return t("pages").select("page_id", F.md5(normalised(F.col("html"))).alias("h"), (bare_length(F.col("html")) >= 200).alias("long_enough"))


@query("SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'rechazado' WHEN strlen(html) > 20000 THEN 'rechazado' WHEN length(regexp_replace(html, '[ \\t\\n\\r\\f\\v]', '', 'g')) < 200 THEN 'fallido' ELSE 'procesado' END AS status FROM pages")
def ingest_status(t):
    from palimpsest.sources.ingest import status

    return t("pages").select("page_id", status(F.rlike("url", F.lit("^https?://")), F.octet_length("html"), F.col("html"), 20000).alias("status"))


# Retrieval: the benchmark's items are the queries, documents the corpus.


def vocabulary(t):
    return written(L.vocabulary((t("documents"), F.col("text")), (t("benchmark"), F.col("text"))), "vocabulary")


def counted(t):
    """The documents' words, and the vocabulary, each made once."""
    found = written(L.counted_words(t("documents"), "doc_id", F.col("text")), "words")
    return found, written(L.vocabulary_of(found, L.counted_words(t("benchmark"), "item_id", F.col("text"))), "vocabulary")


def index(t, *more):
    """The documents with the postings of what is asked for, and what is asked for, each made once."""
    docs = t("documents")
    asked = written(L.lexemes(t("benchmark"), "item_id", F.col("text"), L.vocabulary_of(L.seen_words(t("benchmark"), F.col("text")))), "asked")
    known = written(L.asked_words(docs, F.col("text"), asked), "vocabulary")
    return written(L.held(docs.select("doc_id", "text", *more), "doc_id", F.col("text"), known, *docs.select(*more).columns), "postings"), asked


def searched(t, limit):
    """The first documents of each item by the lexical channel."""
    return L.ranked(L.best_matches(*index(t), limit), limit)


@query(f"WITH {POST} SELECT lexeme, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM post GROUP BY 1")
def postings(t):
    return L.postings_of_counted(*counted(t)).groupBy("lexeme").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))


@query(f"WITH {POST} SELECT w AS word, lexeme FROM stems")
def stem_words(t):
    """The vocabulary's stems."""
    return vocabulary(t)


@query(f"WITH {POST}, {ASK} SELECT query_id, lexeme FROM ask")
def fts_or(t):
    return L.lexemes(t("benchmark"), "item_id", F.col("text"), vocabulary(t))


SEARCHED = "SELECT query_id, doc_id, round(0.1 * h, 4)::DOUBLE AS score, rank, total"


@query(f"WITH {POST}, {ASK}, {HITS}, {RANKED} {SEARCHED} FROM ranked JOIN (SELECT query_id, count(*) AS total FROM hits GROUP BY 1) USING (query_id) WHERE rank <= 10")
def fts_search(t):
    found = written(L.best_matches(*index(t), 10), "matches")
    return L.ranked(found, 10, with_total=True).drop("first").withColumn("score", F.col("score").cast("double")).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {POST}, {ASK}, {HITS}, inside AS (SELECT query_id, doc_id, h FROM hits JOIN documents USING (doc_id) WHERE query_id % 4 = 3 OR lang = CASE query_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE 'es' END),
       {RANKED.replace('hits', 'inside')} {SEARCHED} FROM ranked JOIN (SELECT query_id, count(*) AS total FROM inside GROUP BY 1) USING (query_id) WHERE rank <= 10""")
def fts_area(t):
    """Three of four questions ask for an area, here a language; ranks and totals are those inside it."""
    asks = F.when(F.col("query_id") % 4 == 0, "de").when(F.col("query_id") % 4 == 1, "en").when(F.col("query_id") % 4 == 2, "es")
    areas = t("benchmark").select(F.col("item_id").alias("query_id")).withColumn("area", asks)
    found = written(L.best_matches(*index(t, F.col("lang").alias("area")), 10, areas), "inside")
    return L.ranked(found, 10, with_total=True).drop("first").withColumn("score", F.col("score").cast("double")).withColumn("rank", F.col("rank").cast("long"))


FIRST_WORDS = "regexp_extract(text, '^\\S+(?:\\s+\\S+){0,2}')"


@query(f"""WITH {POST}, ask AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, lexeme FROM ({placed('benchmark', 'item_id', FIRST_WORDS)}) JOIN stems USING (w)),
       need AS (SELECT query_id, count(*) AS lexemes FROM ask GROUP BY 1),
       placed AS (SELECT DISTINCT query_id, doc_id, lexeme, pos FROM doc_words JOIN stems USING (w) JOIN ask USING (lexeme)),
       capped AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, lexeme ORDER BY pos) <= 255),
       whole AS (SELECT query_id, doc_id, any_value(lexemes) AS lexemes FROM capped JOIN need USING (query_id) GROUP BY 1, 2 HAVING count(DISTINCT lexeme) = any_value(lexemes)),
       e AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos, lexeme) AS k FROM capped JOIN whole USING (query_id, doc_id)),
       ends AS (SELECT x.query_id, x.doc_id, x.k, x.pos, y.lexeme, max(y.k) AS last, arg_max(y.pos, y.k) AS lpos, any_value(x.lexemes) AS lexemes FROM e x JOIN e y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND y.k <= x.k GROUP BY ALL),
       runs AS (SELECT query_id, doc_id, k, pos, min(last) AS begun, arg_min(lpos, last) AS bpos FROM ends GROUP BY query_id, doc_id, k, pos HAVING count(*) = any_value(lexemes)),
       covers AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, begun ORDER BY k) = 1)
       SELECT query_id, doc_id, round(sum(0.1::DOUBLE / (1 + CASE WHEN (pos - bpos) - (k - begun) >= 0 THEN (pos - bpos) - (k - begun) ELSE (k - begun) // 2 END)), 6) AS score FROM covers GROUP BY 1, 2""")
def fts_all(t):
    """Documents that have all of a question's first three words, by the density of their covers."""
    questions = t("benchmark").select("item_id", F.regexp_extract("text", r"^\S+(?:\s+\S+){0,2}", 0).alias("text"))
    known = vocabulary(t)
    asked = written(L.lexemes(questions, "item_id", F.col("text"), known), "asked")
    post = L.postings(t("documents"), "doc_id", F.col("text"), known, asked, places=True)
    return L.all_of(post, asked)


@query(f"WITH {POST}, {ASK}, {HITS}, {RANKED} SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 20")
def fts_candidates(t):
    """The first twenty without a total, so documents that can't be among them aren't scored."""
    docs, asked = index(t)
    return L.bounded_search(L.posted(docs), asked, 20).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


CONCEPTS = (("licence", "released under the license"), ("mail", "mail example com"), ("nothing", "zzzz"))


@query(f"""WITH {POST}, c AS (SELECT DISTINCT query_id, lexeme FROM (SELECT query_id, unnest({TOKENS.format('t', 1)}) AS w FROM (VALUES {', '.join(map(str, CONCEPTS))}) v(query_id, t)) JOIN stems USING (w)),
       h AS (SELECT query_id, doc_id, sum(n) AS h FROM post JOIN c USING (lexeme) GROUP BY 1, 2) SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS k FROM h) WHERE k <= 15""")
def union_concepts(t):
    """All concepts in one scan of the documents."""
    known = vocabulary(t)
    concepts = written(L.lexemes(t("documents").sparkSession.createDataFrame(CONCEPTS, "name string, text string"), "name", F.col("text"), known), "concepts")
    post = written(L.postings(t("documents"), "doc_id", F.col("text"), known, concepts), "postings")
    return L.search(post, concepts, 15).select("query_id", "doc_id")


@query(f"""WITH {POST}, {ASK}, hits AS (SELECT query_id, doc_id, lang, sum(n) AS h FROM post JOIN ask USING (lexeme) JOIN documents USING (doc_id) GROUP BY 1, 2, 3),
       w AS (SELECT *, query_id % 3 = 0 AND lang = 'de' OR query_id % 3 <> 0 AND lang = 'xx' AS inside FROM hits),
       n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS k FROM w WHERE inside), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS k FROM w)
       SELECT query_id, doc_id FROM n WHERE k <= 5 UNION ALL SELECT query_id, doc_id FROM a WHERE k <= 5 AND query_id NOT IN (SELECT query_id FROM n)""")
def fts_fallback(t):
    """Queries ask for an area (here a language that only some have); those without results there go without it."""
    docs, asked = index(t, F.col("lang").alias("area"))
    areas = t("benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "de").otherwise("xx").alias("area"))
    best = lambda *areas: written(L.ranked(L.best_matches(docs, asked, 5, *areas), 5).select("query_id", "doc_id"), "found")
    return R.fallback(best(areas), best())


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
       s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM embeddings, q),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_topk(t):
    """Queries: the rows whose id is divisible by 100; each against all rows."""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return R.cosine_top(vectors, queries, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT vec_id, len(embedding) = 64 AS right_size, len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AS finite, abs(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) < 0.001 AS unit FROM embeddings""")
def vector_quality(t):
    return t("embeddings").select("vec_id", *G.vector_checks(F.col("embedding"), 64))


NEAR = "near AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT item_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e WHERE q.label <> 3))"
LISTS = f"WITH {POST}, {ASK}, {HITS}, {RANKED}, {NEAR}, a AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 20), b AS (SELECT query_id, doc_id, rank FROM near WHERE rank <= 20)"


def nearest(t, k=20):
    """The semantic channel: a document's vector is that with its number, a question's that with the item's number, for the
    model that makes them is outside. Questions of label 3 have no current vector and go without."""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    own = t("embeddings").where("label <> 3").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q"))
    queries = t("benchmark").join(own, "item_id").select(F.col("item_id").alias("query_id"), "q")
    return R.cosine_top(vectors, queries, k).select("query_id", F.col("id").alias("doc_id"), "rank")


def two_lists(t):
    """Both channels, each made once."""
    return written(searched(t, 20), "lexical"), written(nearest(t), "semantic")


@query(f"{LISTS} SELECT query_id, doc_id, a.rank AS rank_a, b.rank AS rank_b FROM a FULL JOIN b USING (query_id, doc_id)")
def rank_merge(t):
    return R.merged(*two_lists(t)).select("query_id", "doc_id", F.col("rank_a").cast("long").alias("rank_a"), F.col("rank_b").cast("long").alias("rank_b"))


@query(f"{LISTS} SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2")
def rrf(t):
    a, b = two_lists(t)
    lists = a.select("query_id", "doc_id", "rank", F.lit("a").alias("list")).unionByName(b.select("query_id", "doc_id", "rank", F.lit("b").alias("list")))
    return R.fuse(lists).withColumn("score", F.round("score", 9))


ROOTS = "list_distinct(list_transform(list_filter(regexp_split_to_array(strip_accents(lower({})), '[^a-z0-9_ß]+'), lambda w: length(w) >= 4), lambda w: substr(w, 1, 6)))"


@query(f"SELECT item_id, array_to_string(list_sort({ROOTS.format('text')}), ' ') AS roots FROM benchmark")
def roots(t):
    return t("benchmark").select("item_id", F.array_join(F.array_sort(X.roots(F.col("text"))), " ").alias("roots"))


@query(f"""WITH r AS (SELECT conv_id AS query_id, root, count(*) AS n FROM (SELECT conv_id, unnest({ROOTS.format('text')}) AS root FROM conversations) GROUP BY 1, 2)
       SELECT query_id, root AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, root) AS k FROM r WHERE n > 1) WHERE k = 1""")
def anchor(t):
    return R.anchors(t("conversations").select(F.col("conv_id").alias("query_id"), F.col("text").alias("concept")))


PAIRS = f"WITH {POST}, {ASK}, {HITS}, {RANKED}, pairs AS (SELECT query_id AS item_id, doc_id, first FROM ranked WHERE rank <= 20)"
SENT_BYTES = 32 << 20


def pairs(t):
    """Items and the documents that the lexical channel finds for them, which is what later steps look at, and the place of
    the first word of each that is asked for."""
    return written(searched(t, 20).select(F.col("query_id").alias("item_id"), "doc_id", "first"), "pairs")


def with_texts(t, found, name="asked_text"):
    """Pairs of items and documents with both texts. The pairs with their items' texts go to the documents where they have
    SENT_BYTES at most, which is measured; else the documents that are found are shuffled to them."""
    both = found.join(t("benchmark").select("item_id", F.col("text").alias(name)), "item_id")
    size = both.agg(F.sum(F.octet_length(name) + 32)).first()[0] or 0
    docs = t("documents").select("doc_id", "text")
    return docs.join(F.broadcast(both), "doc_id") if size <= SENT_BYTES else docs.join(L.sent(found.select("doc_id").distinct()), "doc_id", "left_semi").join(both, "doc_id")


@query(f"""{PAIRS}, b AS (SELECT item_id, {ROOTS.format('text')} AS asked FROM benchmark), d AS (SELECT doc_id, {ROOTS.format('split_part(text, chr(10), 1)')} AS head, {ROOTS.format('text')} AS body FROM documents)
       SELECT item_id, doc_id, CAST(CASE WHEN list_contains(head, list_sort(asked)[1]) OR list_contains(body, list_sort(asked)[1]) THEN 6 ELSE 0 END + 2 * len(list_intersect(asked, head)) + len(list_intersect(asked, body)) AS INTEGER) AS affinity
       FROM pairs JOIN b USING (item_id) JOIN d USING (doc_id)""")
def affinity(t):
    """Of each item and the documents that are found for it."""
    roots = X.roots(F.col("asked_text"))
    value = R.affinity(F.get(F.array_sort(roots), F.lit(0)), roots, F.substring_index("text", "\n", 1), F.col("text"))
    return with_texts(t, pairs(t)).select("item_id", "doc_id", value.alias("affinity"))


#: What the driver's questions are about: words of its languages that some of them have.
DRIVER_CONCEPTS = ((r"\bthe\b", "that with this"), (r"\bof\b", "that from were"), (r"\bque\b", "para esta"), (r"\bder\b", "nicht eine"))
CONCEPTS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(strip_accents(lower(text)), '{p}') THEN '{c}' END" for p, c in DRIVER_CONCEPTS) + "], lambda x: x IS NOT NULL)"
ANCHOR_SQL = f"(SELECT query_id, root FROM (SELECT query_id, root, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, root) AS k, count(*) AS n FROM (SELECT query_id, unnest({ROOTS.format('c')}) AS root FROM (SELECT item_id AS query_id, unnest({CONCEPTS_SQL}) AS c FROM benchmark)) GROUP BY 1, 2) WHERE k = 1 AND n > 1)"
HYBRID = f"""{LISTS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2),
       c AS (SELECT item_id AS query_id, cs, {ROOTS.format("array_to_string(cs, ' ')")} AS asked FROM (SELECT item_id, {CONCEPTS_SQL} AS cs FROM benchmark)),
       r AS (SELECT doc_id, {ROOTS.format("split_part(text, chr(10), 1)")} AS head, {ROOTS.format('text')} AS body FROM documents),
       s AS (SELECT f.*, CAST(CASE WHEN len(cs) = 0 THEN 0 ELSE CASE WHEN list_contains(head, root) OR list_contains(body, root) THEN 6 ELSE 0 END + 2 * len(list_intersect(asked, head)) + len(list_intersect(asked, body)) END AS INTEGER) AS affinity
             FROM f JOIN r USING (doc_id) JOIN c USING (query_id) LEFT JOIN {ANCHOR_SQL} USING (query_id)),
       h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY affinity DESC, score DESC, doc_id) AS place FROM s)"""


def asked_about(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text", R.concepts(F.col("text"), DRIVER_CONCEPTS).alias("concepts"))


def found_by_both(t, limit=5):
    docs = t("documents").select("doc_id", F.substring_index("text", "\n", 1).alias("heading"), F.col("text").alias("body"))
    return R.hybrid(*two_lists(t), asked_about(t), docs, limit)


@query(f"{HYBRID} SELECT query_id, doc_id, affinity, score, place FROM h WHERE place <= 5")
def hybrid_search(t):
    """Lexical and exact cosine candidates, fused, reordered by affinity with the question's concepts and their anchor."""
    return found_by_both(t).select("query_id", "doc_id", "affinity", "score", F.col("place").cast("long").alias("place"))


@query(f"{HYBRID} SELECT query_id, count(*) AS n, CASE WHEN query_id IN (SELECT query_id FROM near) THEN 'hibrida' ELSE 'lexica' END AS mode, CASE WHEN query_id IN (SELECT query_id FROM near) THEN NULL ELSE '{R.NO_VECTORS}' END AS warning FROM h WHERE place <= 5 GROUP BY 1")
def degrade_lexical(t):
    """Questions without a current vector are served by the lexical channel, with a warning."""
    return found_by_both(t).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.first("mode").alias("mode"), F.first("warning").alias("warning"))


QUESTIONS = """CASE c % 9 WHEN 0 THEN 'El inquilino no paga el alquiler y quiero venderlo' WHEN 1 THEN 'Compré una casa al vendedor' WHEN 2 THEN 'Mi papá falleció sin testamento' WHEN 3 THEN 'Me debe dinero y se atrasó'
             WHEN 4 THEN 'Presté dinero: hay daño' WHEN 5 THEN 'Hay que repartir los bienes de la herencia' WHEN 6 THEN 'La servidumbre del vecino' WHEN 7 THEN 'Responsabilidad contractual por un alquiler de un año' ELSE 'Otra cosa' END || ', cliente ' || CAST(c AS STRING)"""
#: What each of them is expanded with: the words of all rules that it meets, each once.
EXPANDED = {
    0: "arrendamiento arrendatario arrendador locacion enajenacion cosa arrendada adquirente respetar mora requerimiento intimacion retraso incumplimiento resarcimiento", 1: "venta vendedor comprador obligaciones entrega transferencia",
    2: "sucesion legal herencia hijos descendientes", 3: "obligacion deudor acreedor pago cumplimiento mora requerimiento intimacion retraso incumplimiento resarcimiento", 4: "prestamo mutuo restitucion deudor acreedor obligacion responsabilidad hecho ilicito resarcimiento dano",
    5: "particion division herencia coherederos comunidad", 6: "servidumbre paso ejercicio",
    7: "responsabilidad contractual incumplimiento obligacion deudor mora resarcimiento dano perjuicios cumplimiento arrendamiento arrendatario arrendador locacion duracion plazo termino convenido",
}


WHENS = " ".join(f"WHEN {k} THEN ' {w}'" for k, w in EXPANDED.items())


@query(f"SELECT c, q || CASE c % 9 {WHENS} ELSE '' END AS expanded FROM (SELECT c, {QUESTIONS} AS q FROM (SELECT c_custkey AS c FROM customer))")
def expand_query(t):
    """Questions with the concepts of all rules that they meet behind them."""
    asked = t("customer").select(F.col("c_custkey").alias("c")).select("c", F.expr(QUESTIONS).alias("q"))
    return asked.select("c", R.expanded(F.col("q"), D.EXPANSIONS).alias("expanded"))


# Grounding.


@query(f"{PAIRS} SELECT doc_id, item_id, contains(regexp_replace(lower(d.text), '\\s+', ' ', 'g'), regexp_replace(lower(b.text), '\\s+', ' ', 'g')) AS literal FROM pairs JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)")
def quote_literal(t):
    """Whether the documents that are found for an item hold it literally."""
    return with_texts(t, pairs(t)).select("doc_id", "item_id", G.quoted(F.col("text"), F.col("asked_text")).alias("literal"))


@query("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+')) AS n FROM documents), e AS (SELECT doc_id - 1 AS doc_id, n AS e FROM d)
       SELECT doc_id, CAST(len(list_filter(n, lambda x: NOT list_contains(coalesce(e, []), x))) AS INTEGER) AS unsupported FROM d LEFT JOIN e USING (doc_id)""")
def doc_figures(t):
    """Figures of an answer that its evidence (here the next document) lacks."""
    docs = t("documents").select("doc_id", G.figures(F.col("text")).alias("n"))
    evidence = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("e"))
    return docs.join(evidence, "doc_id", "left").select("doc_id", F.size(F.array_except("n", F.coalesce("e", F.array().cast("array<string>")))).alias("unsupported"))
