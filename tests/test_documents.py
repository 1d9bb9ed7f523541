"""Segmentation, extraction, classification, risk rules and comparison on legal texts."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dictionaries as D
from palimpsest.functions import text as X
from palimpsest.operators import corpus as K
from palimpsest.operators import documents as O
from palimpsest.operators import grounding as G
from palimpsest.operators import retrieval as R
from palimpsest.operators import relational as rel

LEASE = """Conste por el presente documento que suscriben Juan y Ana, C.I. 1234567 L.P.

CLÁUSULA PRIMERA.- El canon es de Bs. 1.500,00 por mes.
SEGUNDA.- El plazo es de doce (12) meses desde el 15/03/2024.
CLAUSULA 3 Se permite el subarriendo del inmueble.
"""


def test_clauses():
    found = O.clauses_of(LEASE)
    assert [c[2] for c in found] == ["PRIMERA", "SEGUNDA", "3"]
    assert all(LEASE[a[4] : a[5]].startswith(a[1]) for a in found)
    assert [c[5] for c in found[:-1]] == [c[4] for c in found[1:]]
    assert O.clauses_of("sin encabezados") == [] and O.clauses_of("") == []


def test_findings():
    found = O.findings_of(LEASE)
    assert [(f[0], f[4]) for f in found] == [("cedula", None), ("monto_bs", 1), ("plazo", 2), ("fecha", 2)]
    assert all(LEASE[f[2] : f[3]] == f[1] for f in found)
    assert all(a[3] <= b[2] for a, b in zip(found, found[1:]))
    assert O.parties_of(LEASE).startswith("Conste") and "\n\n" not in O.parties_of(LEASE)
    assert O.parties_of("entre otras cosas") is None


def risks(spark, text, kind):
    df = spark.createDataFrame([(text, kind)], "text string, kind string").withColumns({"c": O.clauses("text"), "f": O.findings("text")})
    return {r["codigo"]: r for r in O.risks(df, "text", "kind", "c", "f").first()["risks"]}


def test_risks(spark):
    found = risks(spark, LEASE, "arrendamiento")
    assert list(found) == ["AR-SUBARRIENDO-SIN-AUTORIZACION"]
    assert found["AR-SUBARRIENDO-SIN-AUTORIZACION"]["evidencia"] == "subarriendo" and found["AR-SUBARRIENDO-SIN-AUTORIZACION"]["clausula"] == 3
    assert not risks(spark, LEASE.replace("Se permite", "Queda prohibido"), "arrendamiento")
    assert set(risks(spark, "nada", "compraventa")) == {"GEN-SIN-CEDULA", "CV-PRECIO-AUSENTE", "GEN-SIN-CLAUSULAS", "GEN-SIN-FECHA"}
    loan = risks(spark, LEASE + "interés del 3,5 % que se capitalizará", "prestamo")
    assert set(loan) == {"PR-INTERES-CAPITALIZADO", "PR-INTERES-PACTADO"} and loan["PR-INTERES-PACTADO"]["evidencia"] == "3,5 %"
    assert loan["PR-INTERES-CAPITALIZADO"]["evidencia"] == "interés del 3,5 % que se capitalizará"


@pytest.mark.parametrize(
    ("text", "area"),
    [("Mi papá falleció sin testamento, ¿y la herencia?", "sucesiones"), ("usucapión del lote", "derechos_reales"), ("me chocaron el auto, accidente con lesiones", "responsabilidad_civil"),
     ("el inquilino no paga el alquiler", "contratos"), ("hola", None), ("", None), ("compras y ventas", "contratos")],
)
def test_areas(spark, text, area):
    df = spark.createDataFrame([(text,)], "t string")
    assert O.classified(df, "t", D.AREAS, D.AREA_THRESHOLD).first()["class"] == area


def test_types_and_intents(spark):
    df = spark.createDataFrame([("contrato de arrendamiento: el arrendador entrega",), ("una carta",), (None,)], "t string")
    assert [r["class"] for r in O.classified(df, "t", D.TYPES, D.TYPE_THRESHOLD, D.OTHER_TYPE).collect()] == ["arrendamiento", "otro", "otro"]
    asks = ["Analizá este contrato", "¿Me conviene analizarlo?", "guardalo", "¿Qué dice la ley sobre el contrato?", "¿Qué dice el Código Civil?", "¿cuánto es?"]
    got = spark.createDataFrame([(a,) for a in asks], "t string").select(O.intent(F.col("t"), F.lit(True))).collect()
    assert [r[0] for r in got] == ["analizar_documento", "consulta_documento", "guardar_documento", "consulta_documento_normativa", "consulta_general", "consulta_documento"]


def test_changes():
    new = LEASE.replace("1.500,00", "1.600,00").replace("CLAUSULA 3 Se permite el subarriendo del inmueble.\n", "CUARTA.- Nueva\n")
    told = O.changes(LEASE, new)
    assert [c[:2] for c in told] == [("modificado", "Cláusula PRIMERA"), ("eliminado", "Cláusula 3"), ("agregado", "Cláusula CUARTA")]
    assert [c[4] for c in told] == ["El monto cambió de Bs. 1.500,00 a Bs. 1.600,00.", "Se eliminó la cláusula 3.", "Se agregó la cláusula cuarta."] and [c[5] for c in told] == [1, 3, 3]
    assert [c[:2] for c in O.changes("PRIMERA.- El precio es 100 Bs.", "PRIMERA.- El precio es 900 Bs.")] == [("modificado", "Cláusula PRIMERA")]  # a clause of one line
    body = "PRIMERA.-\nuno\nSEGUNDA.-\ndos\n"
    assert [c[:2] for c in O.changes(body, body.replace("dos", "tres"))] == [("modificado", "Cláusula SEGUNDA")]
    assert O.changes(body, body.replace("uno", "  uno ")) == []
    assert [c[:2] for c in O.changes("a\nb", "a\nc\nd")] == [("modificado", "Párrafo 2"), ("agregado", "Párrafo 3")]
    assert [c[:4] for c in O.changes("uno\nx\n\ndos", "cero\n\nuno\nx\n\ntres")] == [("agregado", "Párrafo 1", None, "cero"), ("modificado", "Párrafo 3", "dos", "tres")]  # paragraphs where there are two, numbers of the new version
    assert O.changes("x" * 1300, "y")[0][2] == "x" * 1200 + "…"
    assert O.explanation("Bs 1 y Bs 2", "Bs 1") == O.explanation("a", "b") == "El contenido de esta sección fue modificado."
    assert O.explanation("dura dos meses desde 01/02/2024", "dura tres meses desde 01/03/2024") == "El plazo cambió de dos meses a tres meses."


def test_pieces():
    text = "Una frase. " * 100 + "x" * 800
    cut = O.pieces_of(text)
    assert "".join(cut) == text and max(map(len, cut)) <= 350


def test_text_functions(spark):
    row = spark.createDataFrame([("Ñandú  ÁRBOL_2 año ß",)], "t string").select(X.fold(F.col("t")), X.words(F.col("t")), X.slug(F.col("t")), X.slug(F.lit("¡¿")), X.collapsed(F.lit(" a \n b "))).first()
    assert list(row) == ["nandu  arbol_2 ano ß", ["nandu", "arbol_2", "ano"], "nandu_arbol_2_ano", "documento", "a b"]


def test_grounding(spark):
    one = spark.range(1)
    got = one.select(G.supported(F.lit("pagó 1.500,00 y 7"), F.lit("Bs 1,500.00")), G.literal(F.lit("C.I. 12-34"), F.lit("ci 1234")), G.quoted(F.lit("Uno  dos\ntres"), F.lit("uno DOS")), G.derived_cap(F.lit("180000"), F.lit("10"))).first()
    assert got[0] == ["7"] and got[1] and got[2] and str(got[3]) == "18000.00"


def test_fusion(spark):
    rows = [(1, "a", "x", 1), (1, "a", "y", 2), (1, "a", "x", 5), (1, "b", "y", 2)]
    got = {r["doc_id"]: r["score"] for r in R.fuse(spark.createDataFrame(rows, "query_id int, list string, doc_id string, rank int")).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(2 / 62)}
    with pytest.raises(ValueError):
        R.fuse(spark.createDataFrame(rows, "query_id int, list string, doc_id string, rank int"), 0)


def test_versions(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "k int, version int, content string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, content string")
    got = sorted(map(tuple, rel.versioned(old, new, ["k"], "content").collect()))
    assert got == [(1, "kept", 1, "a", True), (2, "changed", 1, "b", False), (2, "changed", 2, "B", True), (3, "kept", 2, "c", True), (4, "inserted", 1, "d", True)]
    again = rel.versioned(old, old.select("k", "content"), ["k"], "content")
    assert {r["change"] for r in again.collect()} == {"kept"}


def test_risk_rules_of_all_documents(spark, tmp_path):
    """Texts with figures are judged too, by the rules of their type."""
    from palimpsest.plans.text_queries import QUERIES

    loan = "CONTRATO DE PRESTAMO. El prestamista entrega al prestatario Bs 1.000 el 01/02/2024 en mutuo; el interes se capitaliza."
    texts = {1: loan, 2: "una carta", 3: "contrato de arrendamiento: el arrendador entrega\n" + LEASE, 4: "una carta de 12 hojas"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in QUERIES["risk_rules_all"](spark, str(tmp_path)).collect():
        got.setdefault((r["doc_id"], r["kind"]), set()).add(r["codigo"])
    assert set(got) == {(1, "prestamo"), (2, "otro"), (3, "arrendamiento"), (4, "otro")}
    assert "PR-INTERES-CAPITALIZADO" in got[1, "prestamo"] and "GEN-SIN-FECHA" not in got[1, "prestamo"]
    assert got[2, "otro"] == got[4, "otro"] == {"GEN-SIN-CLAUSULAS", "GEN-SIN-FECHA", "GEN-SIN-CEDULA"}
    assert got[3, "arrendamiento"] == {"AR-SUBARRIENDO-SIN-AUTORIZACION"}


def test_sequences_of_articles(spark):
    rnd, told = random.Random(3), {}
    for source in range(200):
        told[source] = [rnd.randint(-1, 11) for _ in range(rnd.randint(1, 14))]
    told |= {900: list(range(1, 10)), 901: [1, 2, 5, 6, 7, 8, 9], 902: [12], 903: [-2, 0]}
    rows = [(s, n, "clash") for s, ns in told.items() for n in ns] + [(None, 1, ""), (905, None, "")]
    df = spark.createDataFrame(rows, "source long, number int, times string")
    want = set()
    for s, ns in told.items():
        lacking = [n for n in range(1, 10) if n not in ns]
        for n in lacking:
            if n - 1 not in lacking:
                want.add((s, "missing", n, next(m for m in range(n, 11) if m + 1 not in lacking)))
        want |= {(s, "repeated", n, n) for n in ns if ns.count(n) > 1} | {(s, "beyond", n, n) for n in ns if not 1 <= n <= 9}
    got = [tuple(r) for r in K.sequence_faults(df, 9).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (901, "missing", 3, 4) in want
    profile = dataclasses.replace(K.PROFILES["codigo_civil"], expected=9)
    assert {r["source"] for r in K.whole_sources(df, profile).collect()} == {s for s in told if sorted(told[s]) == list(range(1, 10))}
    assert K.sequence_faults(df.where("false"), 9).isEmpty()


def test_word_edges_of_folded_texts_are_plain(spark):
    """A sharp s is no part of a word there, as in SQL; Java's own edges took it for one."""
    texts = ["undßgeber", "ßder", "der", "undes.", "runde", "hunder", None, "_und"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: (r["class"], r["class_score"]) for r in O.classified(df, "text", {"german": (("der", 1.0), ("und", 1.5))}, 1.0).collect()}
    none = (None, 0.0)
    assert [got[i] for i in range(len(texts))] == [("german", 1.5), ("german", 1.0), ("german", 1.0), ("german", 1.5), none, none, none, none]
    assert X.plain_edges(r"\bder(?:es|s)?\b") == r"d(?<!\wd)er(?:es|s)?" + X.EDGE and X.plain_edges(r"\bs?ol") == X.EDGE + "s?ol"
    assert df.where(X.occurs(F.col("text"), r"\bde", "x")).count() == 2


def test_cosines_in_blocks(spark, monkeypatch):
    """Equal vectors are ordered by id wherever they stand; other sizes, nulls and zeros don't score; blocks give the same."""
    rng = random.Random(11)
    made = [[rng.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(3)] for _ in range(40)]
    vectors = [(f"v{i:03}", made[i % 40]) for i in range(300)] + [("w", [1.0]), ("x", None), ("y", [1.0, None, 2.0]), ("z", [0.0] * 3)]
    asked = [(i, made[i]) for i in range(12) if any(made[i])] + [(99, [2.0]), (98, None)]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = set()
    for n, q in asked:
        same = [(-round(sum(x * y for x, y in zip(v, q)) / (norm(v) * norm(q)), 9), i) for i, v in vectors if q and v and len(v) == len(q) and None not in v and norm(v)]
        want |= {(n, i, -s, r) for r, (s, i) in enumerate(sorted(same)[:7], 1)}
    frames = spark.createDataFrame(vectors, "id string, v array<float>"), spark.createDataFrame(asked, "query_id int, q array<float>")
    for numbers, rows in ((4_000_000, 1024), (9, 5)):
        monkeypatch.setattr(R, "SENT_NUMBERS", numbers)
        monkeypatch.setattr(R, "ROWS", rows)
        assert {(r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in R.cosine_top(*frames, 7).collect()} == want
    plan = R.cosine_top(*frames, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
