"""Registered queries: cases, forms, drafts and retrieval inside one document, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import dictionaries as D
from palimpsest.functions import text as X
from palimpsest.operators import cases as C
from palimpsest.operators import documents as O
from palimpsest.operators import grounding as G
from palimpsest.operators import lexical as L
from palimpsest.operators import relational as rel
from palimpsest.operators import retrieval as R
from palimpsest.operators.store import written
from palimpsest.plans.relational_queries import findings
from palimpsest.plans.text_queries import CUT, LISTS, ORACLE_SQL, PAIRS, QUERIES, TOKENS, pairs, query, two_lists, with_next, with_texts  # noqa: F401 - registered beside those

FOLD = "strip_accents(lower({}))"
WINDOWS = 'SELECT doc_id, p AS "at", substr(text, p + 1, 1200) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text), 1050)) AS p FROM documents)'


def case_sql(plain: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({plain}, '{p}') THEN '{n}'" for n, p, *_ in rules) + " END"


@query(f"SELECT conv_id, turn, {case_sql('f', D.DOCUMENT_INTENTS)} AS intent FROM (SELECT conv_id, turn, {FOLD.format('text')} AS f FROM conversations)")
def doc_intent(t):
    return t("conversations").select("conv_id", "turn", C.document_intent(F.col("text")).alias("intent"))


LONG = "list_distinct(regexp_extract_all({}, '[a-z]{{5,}}'))"
FITS = " ".join(f"WHEN family = '{n}' THEN regexp_matches(h, '{p}')" for n, _, p in D.THEMES)


ASKED_OF = "SELECT conv_id, turn, c.text AS q, b.text AS h, item_id FROM conversations c, benchmark b"


@query(f"""SELECT item_id, family, CAST(count(*) FILTER (CASE {FITS} ELSE len(list_intersect(list_filter({LONG.format('f')}, lambda w: w NOT IN {D.WEAK_WORDS}), {LONG.format('h')})) >= 2 END) AS BIGINT) AS fitting, count(*) AS asked FROM
       (SELECT *, {case_sql('f', D.THEMES)} AS family FROM (SELECT item_id, {FOLD.format('q')} AS f, {FOLD.format('h')} AS h FROM ({ASKED_OF}))) GROUP BY 1, 2""")
def family_pertinence(t):
    """Every turn as a question to every benchmark item as a heading: how many fit, of how many."""
    questions, items = t("conversations").select("text"), t("benchmark").select("item_id", F.col("text").alias("heading"))
    fits = C.fitting(questions, items, "text", "heading", "item_id").groupBy("item_id", "family").agg(F.count(F.lit(1)).alias("fitting"))
    asked = questions.groupBy(C.theme(F.col("text")).alias("family")).agg(F.count(F.lit(1)).alias("asked"))  # a row for each family
    every = items.select("item_id").join(F.broadcast(asked))
    same = every["family"].eqNullSafe(fits["family"]) & (every["item_id"] == fits["item_id"])
    return every.join(fits, same, "left").select(every["item_id"], every["family"], F.coalesce("fitting", F.lit(0)).cast("long").alias("fitting"), "asked")


FOCUS = """CAST(CASE WHEN contains(h, 'responsabilidad') AND contains(h, 'deudor') THEN 3 ELSE 0 END + CASE WHEN contains(h, 'resarcimiento') AND NOT contains(h, 'pecuniari') THEN 2 ELSE 0 END
       + CASE WHEN contains(b, 'contrato') THEN 1 ELSE 0 END - CASE WHEN contains(h, 'requerimiento') THEN 1 ELSE 0 END AS INTEGER)"""
ENTRIES = """CASE k % 6 WHEN 0 THEN 'Responsabilidad del deudor' WHEN 1 THEN 'Resarcimiento del daño' WHEN 2 THEN 'Requerimiento' WHEN 3 THEN 'Resarcimiento pecuniario' WHEN 4 THEN 'Venta' ELSE 'Mora' END"""
BODIES = """CASE k % 4 WHEN 0 THEN 'Quien no cumple el contrato responde del daño' WHEN 1 THEN 'El incumplimiento obliga al resarcimiento' WHEN 2 THEN 'El retraso causa perjuicio en el contrato' ELSE 'La cosa se entrega' END"""


@query(f"""WITH e AS (SELECT p_partkey AS k, p_size AS q, p_retailprice AS score FROM part), t AS (SELECT *, {FOLD.format(ENTRIES)} AS h, {FOLD.format(BODIES)} AS b FROM e),
       w AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, k) AS r FROM t), f AS (SELECT q, k, score, {FOCUS} AS priority FROM w WHERE r <= 40
             AND regexp_matches(h || ' ' || b, 'incumpl|no cumple|no cumpl|retras|mora') AND regexp_matches(h || ' ' || b, 'resarc|dano|perjuicio|responsab'))
       SELECT q AS query_id, k AS doc_id, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY priority DESC, score DESC, k) AS rank FROM f) WHERE rank <= 10""")
def focal_rank(t):
    """A question on contractual liability: four times as many candidates, the pertinent ones by priority, the first ten."""
    wide = rel.top_n(t("part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("score")), ["query_id"], [F.col("score").desc(), F.col("doc_id")], 40)
    known = wide.withColumns({"h": F.expr(ENTRIES), "b": F.expr(BODIES)}).where(R.pertinent(F.lit("responsabilidad contractual"), F.col("h"), F.col("b")))
    return R.focal(known, C.focus(F.col("h"), F.col("b")), 10).select("query_id", "doc_id", "priority", F.col("rank").cast("long").alias("rank"))


#: Complaints that stand behind the documents' own texts, which are in languages that the catalog doesn't know.
COMPLAINTS = """text || CASE doc_id % 10 WHEN 0 THEN ' No pagó el alquiler y está en mora.' WHEN 1 THEN ' Pido la resolución por humedad y filtración.' WHEN 2 THEN ' Subarrendó a otra persona.'
             WHEN 3 THEN ' Modificó la pared sin permiso.' WHEN 4 THEN ' Reclamo el daño y la penalidad.' WHEN 5 THEN ' Tengo prueba: fotografías y mensajes de WhatsApp.' WHEN 6 THEN ' La morada está en orden.' ELSE '' END"""


@query(f"SELECT doc_id, problem FROM (SELECT doc_id, unnest([{', '.join(f'''CASE WHEN regexp_matches(f, '{p}') THEN '{n}' END''' for n, p in D.PROBLEMS)}]) AS problem FROM (SELECT doc_id, {FOLD.format(COMPLAINTS)} AS f FROM documents)) WHERE problem IS NOT NULL")
def problem_catalog(t):
    told = t("documents").select("doc_id", F.expr(COMPLAINTS).alias("text"))
    return told.select("doc_id", F.explode(C.all_of(X.fold(F.col("text")), D.PROBLEMS)).alias("problem"))


@query(r"""SELECT doc_id, count(*) AS n, md5(string_agg(regexp_replace(trim(regexp_extract(line, '^[ \t]*\d+[.)][ \t]+(.+)$', 1), ' '), '\.+$', ''), '|' ORDER BY i)) AS h
       FROM (SELECT doc_id, i, CASE i % 3 WHEN 1 THEN i || '. ' || l WHEN 2 THEN '  ' || i || ') ' || l ELSE l END AS line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l FROM documents))
       WHERE regexp_matches(line, '^[ \t]*\d+[.)][ \t]+[^\n]') GROUP BY 1""")
def numbered_questions(t):
    """Two of three lines of every document stand as numbered questions."""
    number = lambda i: (i + 1).cast("string")
    line = lambda x, i: F.when(i % 3 == 0, F.concat(number(i), F.lit(". "), x)).when(i % 3 == 1, F.concat(F.lit("  "), number(i), F.lit(") "), x)).otherwise(x)
    asked = t("documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    rows = asked.select("doc_id", C.numbered_questions(F.col("text")).alias("q")).where(F.size("q") > 0)
    return rows.select("doc_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "|")).alias("h"))


@query()
def literal_facts(t):
    """Rows only: SQL on the other side knows no look-around."""
    return t("documents").select("doc_id", F.explode(C.literal_facts(F.col("text"))).alias("fact"))


SCORED = f"""{PAIRS}, c AS ({WINDOWS}), b AS (SELECT item_id, text AS q, list_distinct({TOKENS.format('text', 3)}) AS asked FROM benchmark),
       s AS (SELECT item_id, doc_id, "at", w, CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, list_distinct({TOKENS.format('w', 3)})))::DOUBLE / len(asked)
             + CASE WHEN length(q) >= 12 AND contains({FOLD.format('w')}, {FOLD.format('q')}) THEN 1 ELSE 0 END END AS score FROM pairs JOIN c USING (doc_id) JOIN b USING (item_id) WHERE length(trim(w, ' ')) >= 40)"""


def scored(t):
    """Windows of the documents that are found for each item, scored by it: each document is cut, and each window and item
    folded, once, before they meet."""
    found = pairs(t)
    asked = t("benchmark").select("item_id", X.fold(F.col("text")).alias("phrase"), F.array_distinct(X.words(F.col("text"))).alias("asked"))
    docs = t("documents").select("doc_id", "text").where("length(text) > 0").join(L.sent(found.select("doc_id").distinct()), "doc_id", "left_semi")
    cut = docs.select("doc_id", F.explode(X.windows(F.col("text"))).alias("w")).select("doc_id", "w.at", F.length("w.text").alias("n"), X.fold(F.col("w.text")).alias("plain"))
    cut = written(cut.withColumn("words", F.array_distinct(F.filter(F.split("plain", X.WORD), lambda w: F.length(w) >= 3))), "windows")
    both = cut.join(L.sent(found.select("item_id", "doc_id")), "doc_id").join(L.sent(asked), "item_id")
    return both.select("item_id", "doc_id", "at", "n", C.folded_chunk_score(F.col("asked"), F.col("phrase"), F.col("words"), F.col("plain")).alias("score"))


@query(f'{SCORED} SELECT item_id, doc_id, CAST("at" AS INTEGER) AS "at", round(score, 6) AS score FROM s')
def chunk_score(t):
    return scored(t).select("item_id", "doc_id", "at", F.round("score", 6).alias("score"))


@query(f"""{SCORED.replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT item_id, doc_id, "at", length(w) AS n, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY round(score, 6) DESC, "at") AS k FROM s),
       g AS (SELECT item_id, doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS taken, CAST(NULL AS BIGINT) AS "at" FROM o WHERE k = 1 UNION ALL
             SELECT o.item_id, o.doc_id, o.k, CASE WHEN g.taken < 6 AND g.used + o.n <= 6000 THEN g.used + o.n ELSE g.used END, CASE WHEN g.taken < 6 AND g.used + o.n <= 6000 THEN g.taken + 1 ELSE g.taken END,
                    CASE WHEN g.taken < 6 AND g.used + o.n <= 6000 THEN o."at" END FROM g JOIN o ON o.item_id = g.item_id AND o.doc_id = g.doc_id AND o.k = g.k + 1)
       SELECT item_id, doc_id, CAST(taken - 1 AS INTEGER) AS place, CAST("at" AS INTEGER) AS "at" FROM g WHERE "at" IS NOT NULL""")
def budget_pick(t):
    """Windows of each document that fit the budget, best first: of each its place and length meet, not its text."""
    best = scored(t).groupBy("item_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 6)).alias("low"), "at", "n"))).alias("c"))
    return best.select("item_id", "doc_id", F.posexplode(C.budgeted(F.col("c"))).alias("place", "c")).select("item_id", "doc_id", "place", "c.at")


@query(f"""SELECT conv_id, turn, NOT ((regexp_matches(a, '{D.WIDER_CLAIMS[0]}') AND NOT regexp_matches(e, '{D.WIDER_CLAIMS[0]}')) OR (contains(a, '{D.WIDER_CLAIMS[1]}') AND NOT contains(e, '{D.WIDER_CLAIMS[1]}'))) AS in_scope
       FROM (SELECT conv_id, turn, {FOLD.format('text')} AS a, {FOLD.format("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS e FROM conversations)""")
def doc_scope(t):
    """Each turn against the one before it."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return t("conversations").select("conv_id", "turn", "text", before.alias("e")).select("conv_id", "turn", C.in_scope(F.col("text"), F.col("e")).alias("in_scope"))


STORED, FOUND = "CASE WHEN p_size % 3 <> 0 THEN p_name END", "CASE WHEN p_size % 5 = 0 THEN ' - ' WHEN p_size % 4 = 0 THEN upper(p_name) WHEN p_size % 7 = 0 THEN p_name || 'x' WHEN p_size % 2 = 1 THEN p_name END"


@query(f"""SELECT p_partkey, CASE WHEN f IS NULL THEN 'pendiente' WHEN f = ' - ' THEN 'descartado' WHEN s IS NULL THEN 'detectado' WHEN lower(s) = lower(f) THEN 'igual' ELSE 'conflicto' END AS state
       FROM (SELECT p_partkey, {STORED} AS s, {FOUND} AS f FROM part)""")
def form_merge(t):
    stored = t("part").select("p_partkey", F.expr(STORED).alias("s")).where("s is not null")
    found = t("part").select("p_partkey", F.expr(FOUND).alias("f"))
    return found.join(stored, "p_partkey", "full_outer").select("p_partkey", C.merged_field(F.col("s"), F.col("f")).alias("state"))


@query("""SELECT c_custkey, 'titular_nombre' AS field, 'error' AS nivel, 'nombre_con_numeros' AS codigo FROM customer WHERE regexp_matches(c_name, '[0-9]')
       UNION ALL SELECT c_custkey, 'monto', 'aviso', 'monto_sin_moneda' FROM customer WHERE c_acctbal IS NOT NULL
       UNION ALL SELECT c_custkey, 'plazo', 'error', 'plazo_sin_unidad' FROM customer WHERE c_mktsegment IS NOT NULL""")
def form_review(t):
    fields = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in (("titular_nombre", F.col("c_name")), ("monto", F.col("c_acctbal").cast("decimal(18,2)").cast("string")), ("plazo", F.col("c_mktsegment")))))
    rows = t("customer").select("c_custkey", F.explode(fields).alias("x")).select("c_custkey", "x.*")
    return rows.withColumn("p", C.reviewed(F.col("field"), F.col("value"))).where("p is not null").select("c_custkey", "field", "p.*")


def drafts(t):
    nations = t("nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t("supplier").join(nations, "s_nationkey", "left").select("s_suppkey", C.draft(F.lit("CONTRATO"), {"parte": F.col("s_name"), "lugar": F.col("n_name")}).alias("draft"))


DRAFTS = "SELECT s_suppkey, 'CONTRATO' || chr(10) || 'parte: ' || s_name || chr(10) || 'lugar: ' || coalesce(n_name, '[FALTA: lugar]') AS draft FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2"


@query(DRAFTS)
def assemble_draft(t):
    return drafts(t)


@query(f"SELECT s_suppkey, array_to_string(regexp_extract_all(draft, '\\[FALTA: ([^\\]]+)\\]', 1), ',') AS missing FROM ({DRAFTS}) WHERE contains(draft, '[FALTA: ')")
def pending_markers(t):
    return drafts(t).select("s_suppkey", C.pending(F.col("draft")).alias("p")).where(F.size("p") > 0).select("s_suppkey", F.array_join("p", ",").alias("missing"))


def without(pattern: str, x: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '', 'g')"


def stands(x: str) -> str:
    """x in f, or in c without separators."""
    compact = without(G.SEPARATORS, x)
    return f"({x} <> '' AND (contains(f, {x}) OR ({compact} <> '' AND contains(c, {compact}))))"


@query(f"""{PAIRS}, x AS (SELECT doc_id, item_id, {FOLD.format('d.text')} AS f, {without(G.ENDS, FOLD.format('b.text'))} AS v, {without(G.ENDS, "split_part(b.text, '.', 1)")} AS e FROM pairs JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
       y AS (SELECT *, {without(G.SEPARATORS, 'f')} AS c, {without(G.ENDS, FOLD.format('e'))} AS g FROM x), z AS (SELECT *, length(e) >= 3 AND {stands('g')} AS proven FROM y)
       SELECT doc_id, item_id, v <> '' AND CASE WHEN {stands('v')} THEN length(v) >= 3 OR proven ELSE proven AND len(list_filter(regexp_extract_all(v, '{G.PIECES}'), lambda p: NOT {stands('p')})) = 0 END AS literal FROM z""")
def literal_check(t):
    """Whether the documents that are found for an item hold it as a value; its evidence is what stands before its first full stop."""
    return with_texts(t, pairs(t), "value").select("doc_id", "item_id", G.literal(F.col("value"), F.col("text"), F.substring_index("value", ".", 1)).alias("literal"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS key, CASE WHEN length(text) > 1200 THEN md5(substr(text, 1, 1200) || '…') ELSE md5(text) END AS shown FROM documents")
def comparable_key(t):
    """The key that comparisons use, and the text as they show it (1,200 characters)."""
    return t("documents").select("doc_id", F.md5(X.collapsed(F.col("text"))).alias("key"), F.md5(X.shortened(F.col("text"), 1200)).alias("shown"))


@query()
def figures_subset(t):
    """Figures of a document that the one with the next number lacks, separators aside. Tested against plain loops."""
    return with_next(t, "text").select("doc_id", F.explode(G.supported(F.col("text"), F.coalesce("next_text", F.lit("")))).alias("figure"))


@query()
def diff_strategy(t):
    """Whether a document and the one with the next number are compared by clauses or by text. Tested against plain loops."""
    known = t("documents").select("doc_id", (F.size(O.clauses("text")) > 0).alias("here"))
    pairs = known.join(known.select((F.col("doc_id") - 1).alias("doc_id"), F.col("here").alias("there")), "doc_id")
    return pairs.select("doc_id", F.when(F.col("here") & F.col("there"), "clausulas").otherwise("texto").alias("strategy"))


@query("SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'plazo' ELSE 'monto' END AS tipo, count(*) AS n, CAST(min(l_linenumber) AS BIGINT) AS first FROM lineitem GROUP BY 1, 2")
def persist_analysis(t):
    """Stored findings taken apart by kind."""
    rows = findings(t).select("l_orderkey", F.explode("items").alias("f")).select("l_orderkey", "f.tipo", "f.inicio")
    return rows.groupBy("l_orderkey", "tipo").agg(F.count(F.lit(1)).alias("n"), F.min("inicio").alias("first"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
       s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM embeddings, q WHERE label <> 1 AND len(embedding) = 64)
       SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def vector_guarded(t):
    """Vectors of a stale version (here a label) or of another dimension are left out before the ranking. Queries: ids divisible by 100."""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    fresh = vectors.where((F.col("label") != 1) & (F.size("v") == 64)).drop("label")
    return R.cosine_top(fresh, queries, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, -1 AS j, text AS rest, substr(text, 1, 350) AS head, '' AS piece FROM documents WHERE text <> '' UNION ALL
       SELECT doc_id, j + 1, substr(rest, {CUT} + 1), substr(rest, {CUT} + 1, 350), substr(rest, 1, {CUT}) FROM c WHERE rest <> ''),
       asked AS (SELECT doc_id, unnest([0, 2]) AS j FROM documents)
       SELECT 'F' || doc_id || 'C' || (j + 1) AS cite, piece AS literal, piece IS NOT NULL AS valid FROM asked LEFT JOIN c USING (doc_id, j)""")
def resolve_citations(t):
    """Cited pieces' literal text; a citation of a piece that isn't there has none."""
    pieces = t("documents").where("text is not null").select("doc_id", F.posexplode(O.citable("text")).alias("j", "literal"))
    named = pieces.select(F.concat(F.lit("F"), F.col("doc_id").cast("string"), F.lit("C"), (F.col("j") + 1).cast("string")).alias("cite"), "literal")
    cited = t("documents").select(F.explode(F.array(*(F.concat(F.lit("F"), F.col("doc_id").cast("string"), F.lit(f"C{j}")) for j in (1, 3)))).alias("cite"))
    return cited.join(named, "cite", "left").select("cite", "literal", F.col("literal").isNotNull().alias("valid"))


BY_PROBLEM = f"""{LISTS}, f AS (SELECT query_id // 4 AS c, query_id AS problem, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3),
       fit AS (SELECT f.* FROM f JOIN documents USING (doc_id) WHERE n_chars >= 200), p AS (SELECT *, row_number() OVER (PARTITION BY c, problem ORDER BY score DESC, doc_id) AS position FROM fit),
       chosen AS (SELECT * FROM p WHERE position <= 3), o AS (SELECT c, doc_id, position, problem, row_number() OVER (PARTITION BY c, doc_id ORDER BY position, problem) AS k FROM chosen),
       res AS (SELECT c, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY position, problem) AS place FROM o WHERE k = 1) WHERE place <= 6)"""


@query(f"{BY_PROBLEM} SELECT c AS \"case\", problem, position, doc_id FROM chosen JOIN res USING (c, doc_id)")
def retrieve_by_problem(t):
    """Four questions are a case. Each is searched by both channels, long enough documents fit, the best three are dealt in
    rounds, six to a case; the allotment of the questions."""
    named = lambda df: df.select(F.floor(F.col("query_id") / 4).alias("case"), F.col("query_id").alias("problem"), "doc_id", "rank")
    lexical, semantic = (named(x) for x in two_lists(t))
    wanted = lexical.unionByName(semantic).select("problem", "doc_id").distinct().join(t("documents").where("n_chars >= 200").select("doc_id"), "doc_id")
    return R.by_problem(lexical, semantic, wanted, 3, 6)[1].select("case", "problem", F.col("position").cast("long").alias("position"), "doc_id")


@query(f"""{PAIRS}, w AS (SELECT item_id, doc_id, first, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT item_id, doc_id, first, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM pairs JOIN documents USING (doc_id))),
       c AS (SELECT *, sum(len({TOKENS.format('w', 1).replace('lambda w: length(w)', 'lambda y: length(y)')})) OVER (PARTITION BY item_id, doc_id ORDER BY i) AS seen FROM w),
       h AS (SELECT item_id, doc_id, greatest(1, least(min(i) FILTER (seen >= first), any_value(n) - 14)) AS begun FROM c GROUP BY 1, 2)
       SELECT item_id, doc_id, string_agg(w, ' ' ORDER BY i) AS snippet FROM c JOIN h USING (item_id, doc_id) WHERE i BETWEEN begun AND begun + 39 GROUP BY 1, 2""")
def fts_snippet(t):
    """Of each result the words from the first hit on."""
    found = pairs(t)
    return t("documents").select("doc_id", "text").join(L.sent(found), "doc_id").select("item_id", "doc_id", R.snippet(F.col("text"), F.col("first")).alias("snippet"))
