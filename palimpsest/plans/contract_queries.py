"""Registered queries over contracts written from the orders, two versions each, so that every clause, finding, risk and
change is known from the order's keys and SQL can say what has to come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dictionaries as D
from palimpsest.operators import documents as O
from palimpsest.plans.text_queries import ORACLE_SQL, QUERIES, query  # noqa: F401 - registered beside those

#: One text for both engines. k: the order's key, c: the customer's.
KIND = "CASE k % 4 WHEN 0 THEN 'compraventa' WHEN 1 THEN 'arrendamiento' WHEN 2 THEN 'prestamo' ELSE 'otro' END"
TITLE = "CASE k % 4 WHEN 0 THEN 'CONTRATO DE COMPRAVENTA' WHEN 1 THEN 'CONTRATO DE ARRENDAMIENTO' WHEN 2 THEN 'CONTRATO DE PRESTAMO' ELSE 'NOTA' END"
PARTIES = "CASE k % 4 WHEN 0 THEN 'El vendedor transfiere al comprador la cosa' WHEN 1 THEN 'El arrendador entrega al arrendatario la casa' WHEN 2 THEN 'El prestamista entrega al prestatario la suma' ELSE 'Queda dicho' END"
PRICE, LATER_PRICE = "'Bs. ' || CAST(1000 + c AS STRING)", "'Bs. ' || CAST(1001 + c + CASE WHEN k % 11 = 0 THEN 0 ELSE -1 END AS STRING)"
TERM, LATER_TERM = "CAST(2 + c % 30 AS STRING) || ' meses'", "CAST(2 + c % 30 + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS STRING) || ' meses'"
THIRD = """CASE k % 7 WHEN 0 THEN 'Se trata de cosa ajena' WHEN 1 THEN 'Se puede subarrendar todo' WHEN 2 THEN 'Hay anticretico' WHEN 3 THEN 'El interes es del 3 %'
           WHEN 4 THEN 'El interes se capitaliza' WHEN 5 THEN 'Son derechos hereditarios' ELSE 'Nada mas' END"""
ID = "'C.I. ' || CAST(100000 + c AS STRING)"
FIRST_LINE = "'PRIMERA.- ' || {parties} || CASE WHEN k % 3 = 0 THEN ' por ' || {price} ELSE '' END || '.'"
SECOND_LINE = "'SEGUNDA.- ' || CASE WHEN k % 5 = 0 THEN 'Dura ' || {term} ELSE 'Sin termino' END || '.'"
THIRD_LINE = f"'TERCERA.- ' || {THIRD} || '.'"
FOURTH_LINE = f"'CUARTA.- Firmado el 12/05/2024 con ' || {ID} || '.'"
FIFTH_LINE = "'QUINTA.- Se agrega esto.'"
HEAD, SIGNED = f"{TITLE} || chr(10)", "k % 2 = 0"
FIRST, SECOND = FIRST_LINE.format(parties=PARTIES, price=PRICE), SECOND_LINE.format(term=TERM)
LATER_FIRST, LATER_SECOND = FIRST_LINE.format(parties=PARTIES, price=LATER_PRICE), SECOND_LINE.format(term=LATER_TERM)
VERSION_A = f"{HEAD} || {FIRST} || chr(10) || {SECOND} || chr(10) || {THIRD_LINE} || CASE WHEN {SIGNED} THEN chr(10) || {FOURTH_LINE} ELSE '' END"
VERSION_B = f"""{HEAD} || {LATER_FIRST} || chr(10) || {LATER_SECOND} || CASE WHEN k % 17 = 0 THEN '' ELSE chr(10) || {THIRD_LINE} END
             || CASE WHEN {SIGNED} THEN chr(10) || {FOURTH_LINE} ELSE '' END || CASE WHEN k % 19 = 0 THEN chr(10) || {FIFTH_LINE} ELSE '' END"""
ORDERS = "(SELECT o_orderkey AS k, o_custkey AS c FROM orders)"
LINES = f"""l AS (SELECT k, c, length({HEAD}) AS h, length({FIRST}) + 1 AS n1, length({SECOND}) + 1 AS n2, length({THIRD_LINE}) AS n3, length({FOURTH_LINE}) + 1 AS n4, {SIGNED} AS signed, {VERSION_A} AS t FROM {ORDERS})"""


def contracts(t):
    orders = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return orders.select("k", "c", F.expr(VERSION_A).alias("text"), F.expr(VERSION_B).alias("later"))


@query(f"""WITH {LINES} SELECT k, orden, CAST(inicio AS INTEGER) AS inicio, CAST(fin AS INTEGER) AS fin, ordinal FROM (
       SELECT k, 1 AS orden, h AS inicio, h + n1 AS fin, 'PRIMERA' AS ordinal FROM l UNION ALL SELECT k, 2, h + n1, h + n1 + n2, 'SEGUNDA' FROM l
       UNION ALL SELECT k, 3, h + n1 + n2, CASE WHEN signed THEN h + n1 + n2 + n3 + 1 ELSE length(t) END, 'TERCERA' FROM l UNION ALL SELECT k, 4, h + n1 + n2 + n3 + 1, length(t), 'CUARTA' FROM l WHERE signed)""")
def segment_contracts(t):
    """Clauses with their spans."""
    return contracts(t).select("k", F.explode(O.clauses("text")).alias("c")).select("k", "c.orden", "c.inicio", "c.fin", "c.ordinal")


FOUND = f"""f AS (SELECT k, 'monto_bs' AS tipo, {PRICE} AS texto, 1 AS clausula, t FROM l WHERE k % 3 = 0 UNION ALL SELECT k, 'plazo', {TERM}, 2, t FROM l WHERE k % 5 = 0
       UNION ALL SELECT k, 'fecha', '12/05/2024', 4, t FROM l WHERE signed UNION ALL SELECT k, 'cedula', {ID}, 4, t FROM l WHERE signed)"""


@query(f"WITH {LINES}, {FOUND} SELECT k, tipo, texto, CAST(strpos(t, texto) - 1 AS INTEGER) AS inicio, CAST(strpos(t, texto) - 1 + length(texto) AS INTEGER) AS fin, clausula FROM f")
def extract_contracts(t):
    """Findings with their spans and clauses."""
    return contracts(t).select("k", F.explode(O.findings("text")).alias("f")).select("k", "f.*")


@query(f"WITH {LINES}, {FOUND} SELECT k, tipo, CAST(strpos(t, texto) - 1 AS INTEGER) AS inicio, clausula AS assigned FROM f")
def span_assign(t):
    """Findings joined with the clause whose span holds them."""
    texts = contracts(t)
    found = texts.select("k", F.explode(O.findings("text")).alias("f")).select("k", "f.tipo", "f.inicio")
    clauses = texts.select("k", F.explode(O.clauses("text")).alias("c")).select("k", F.col("c.inicio").alias("b"), F.col("c.fin").alias("e"), F.col("c.orden").alias("orden"))
    return O.assigned(found, clauses, "k", begin="b", end="e")


@query(f"SELECT k, {KIND} AS class FROM {ORDERS}")
def classify_contracts(t):
    """The types of contracts by the whole dictionary."""
    return O.classified(contracts(t), "text", D.TYPES, D.TYPE_THRESHOLD, D.OTHER_TYPE).select("k", "class")


RISKS = (
    ("GEN-SIN-FECHA", "media", "true", "k % 2 <> 0", 0), ("GEN-SIN-CEDULA", "alta", "true", "k % 2 <> 0", 0), ("CV-PRECIO-AUSENTE", "alta", "k % 4 = 0", "k % 3 <> 0", 0), ("CV-COSA-AJENA", "alta", "k % 4 = 0", "k % 7 = 0", 3),
    ("CV-VENTA-HERENCIA", "media", "k % 4 = 0", "k % 7 = 5", 3), ("AR-SIN-PLAZO", "media", "k % 4 = 1", "k % 5 <> 0", 0), ("AR-SUBARRIENDO-SIN-AUTORIZACION", "alta", "k % 4 = 1", "k % 7 = 1", 3), ("AR-ANTICRETICO-SIMULTANEO", "alta", "k % 4 = 1", "k % 7 = 2", 3),
    ("PR-INTERES-PACTADO", "media", "k % 4 = 2", "k % 7 IN (3, 4)", 3), ("PR-INTERES-CAPITALIZADO", "alta", "k % 4 = 2", "k % 7 = 4", 3), ("PR-SIN-PLAZO-DEVOLUCION", "media", "k % 4 = 2", "k % 5 <> 0", 0),
)


@query(" UNION ALL ".join(f"SELECT k, '{code}' AS codigo, '{level}' AS severidad, {f'CAST({clause} AS INTEGER)' if clause else 'CAST(NULL AS INTEGER)'} AS clausula FROM {ORDERS} WHERE {kind} AND {when}" for code, level, kind, when, clause in RISKS))
def risk_contracts(t):
    """Every rule for every type of contract."""
    made = O.classified(contracts(t), "text", D.TYPES, D.TYPE_THRESHOLD, D.OTHER_TYPE).withColumns({"clauses": O.clauses("text"), "findings": O.findings("text")})
    return O.risks(made, "text", "class", "clauses", "findings").select("k", F.explode("risks").alias("r")).select("k", "r.codigo", "r.severidad", "r.clausula")


NEUTRAL = "'El contenido de esta sección fue modificado.'"
CHANGES = (
    ("modificado", "PRIMERA", "k % 3 = 0 AND k % 11 = 0", FIRST, LATER_FIRST, f"'El monto cambió de ' || {PRICE} || ' a ' || {LATER_PRICE} || '.'", "1"),
    ("modificado", "SEGUNDA", "k % 5 = 0 AND k % 13 = 0", SECOND, LATER_SECOND, f"'El plazo cambió de ' || {TERM} || ' a ' || {LATER_TERM} || '.'", "2"),
    ("eliminado", "TERCERA", "k % 17 = 0", THIRD_LINE, "NULL", "'Se eliminó la cláusula tercera.'", "3"),
    ("agregado", "QUINTA", "k % 19 = 0", "NULL", FIFTH_LINE, "'Se agregó la cláusula quinta.'", "3 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 0 ELSE 1 END"),
)


@query(" UNION ALL ".join(f"SELECT k, '{kind}' AS tipo, 'Cláusula {name}' AS ubicacion, {old} AS anterior, {new} AS nuevo, {why} AS explicacion, CAST({number} AS INTEGER) AS clausula FROM {ORDERS} WHERE {when}" for kind, name, when, old, new, why, number in CHANGES))
def diff_clauses(t):
    """Changes between two versions by clauses, with what changed in words."""
    return contracts(t).select("k", F.explode(O.compared("text", "later")).alias("d")).select("k", "d.*")


@query(f"""SELECT k, kind, count(*) AS n, CAST(sum(missing) AS BIGINT) AS missing FROM (
       SELECT k, 'titulo' AS kind, 0 AS missing FROM {ORDERS} UNION ALL SELECT k, 'clausula', 0 FROM {ORDERS} UNION ALL SELECT k, 'dato', CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END FROM {ORDERS}
       UNION ALL SELECT k, 'seccion', 0 FROM {ORDERS} UNION ALL SELECT k, 'parrafo', CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END FROM {ORDERS} UNION ALL SELECT k, 'firma', 0 FROM {ORDERS} WHERE k % 2 = 0) GROUP BY 1, 2""")
def draft_line_classes(t):
    """Kinds of a draft's lines and how many of their parts are markers of missing values."""
    text = "'BORRADOR' || chr(10) || chr(10) || 'Parte: ' || CASE WHEN k % 3 = 0 THEN '[FALTA: nombre]' ELSE CAST(c AS STRING) END || chr(10) || 'PRIMERA.- Objeto del acto' || chr(10) || 'DATOS DE LAS PARTES' || chr(10) || 'Se entrega ' || CASE WHEN k % 5 = 0 THEN '[FALTA: cosa] hoy' ELSE 'todo hoy' END || CASE WHEN k % 2 = 0 THEN chr(10) || '_____' ELSE '' END"
    orders = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).select("k", F.expr(text).alias("draft"))
    lines = orders.select("k", F.explode(O.draft_lines(F.col("draft"))).alias("x")).select("k", "x.kind", F.size(F.filter("x.pending", lambda p: p["missing"])).cast("long").alias("m"))
    return lines.groupBy("k", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("missing"))
