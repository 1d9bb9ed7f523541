"""Cases, forms, drafts and retrieval inside one document."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import dictionaries as D
from palimpsest.functions import text as X
from palimpsest.operators import cases as C


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_questions_and_facts(spark):
    told = "Contraté una obra. ¿Qué puedo hacer? Quiero saber si debo pagar. Hay filtración.\n1. ¿Hay mora?\n 2) Otra cosa...\nx 3. no\nHay filtración."
    asked, facts = one(spark, C.numbered_questions(F.lit(told)), C.literal_facts(F.lit(told)))
    assert asked == ["¿Hay mora?", "Otra cosa"]
    assert facts[:2] == ["Contraté una obra.", "Hay filtración."] and facts.count("Hay filtración.") == 1
    assert one(spark, C.literal_facts(F.lit("\n".join(f"Hecho {i}." for i in range(40))))) == ([f"Hecho {i}." for i in range(24)],)
    assert one(spark, C.literal_facts(F.lit("")), C.literal_facts(F.lit(None).cast("string"))) == ([], None)


def test_themes(spark):
    q = lambda t: C.theme(F.lit(t))
    assert one(spark, q("¿Hay mora del deudor?"), q("vicios de la obra"), q("hola"), C.document_intent(F.lit("¿Quiénes firman?")), C.document_intent(F.lit("¿Cuánto es el canon?"))) == ("mora", "vicios", None, "partes", "monto")
    fits = lambda a, b: C.heading_fits(F.lit(a), F.lit(b))
    assert one(spark, fits("¿Hay mora?", "Constitución en mora"), fits("¿Hay mora?", "Venta"), fits("herencia familiar urgente", "de la herencia familiar"), fits("contrato civil", "contrato civil")) == (True, False, True, False)
    assert one(spark, C.focus(F.lit("Responsabilidad del deudor"), F.lit("el contrato")), C.focus(F.lit("Requerimiento"), F.lit("nada"))) == (4, -1)
    assert one(spark, C.all_of(X.fold(F.lit("Hubo daños y falta de pago")), D.PROBLEMS)) == (["pago", "danos"],)


def test_budget(spark):
    rnd = random.Random(1)
    for _ in range(5):
        sizes = [rnd.randrange(1, 60) for _ in range(12)]
        kept, used = [], 0
        for i, n in enumerate(sizes):
            if len(kept) < 4 and used + n <= 100:
                kept.append(i)
                used += n
        df = spark.createDataFrame([(list(enumerate(sizes)),)], "c array<struct<i:int,n:int>>")
        assert [r["i"] for r in df.select(C.budgeted(F.col("c"), 4, 100).alias("k")).first()["k"]] == kept


def test_scope_and_fields(spark):
    s = lambda a, e: C.in_scope(F.lit(a), F.lit(e))
    assert one(spark, s("El contrato vence hoy", "el plazo vence"), s("El contrato vence", "el  contrato  vence. El contrato vence."), s("todas las partes pagan", "una parte paga"), s("", "")) == (False, True, False, True)
    m = lambda a, b: C.merged_field(F.lit(a).cast("string"), F.lit(b).cast("string"))
    assert one(spark, m("La  Paz", "la paz"), m("x", "y"), m(None, "y"), m("x", " - "), m("x", None)) == ("igual", "conflicto", "detectado", "descartado", "pendiente")


def test_review(spark):
    cases = [
        ("comprador_nombre", "Ana 2", "nombre_con_numeros"), ("comprador_nombre", "Ana", "nombre_incompleto"), ("comprador_nombre", "Ana Ríos", None),
        ("vendedor_ci", "123", "documento_corto"), ("vendedor_ci", "1" * 13, "documento_largo"), ("vendedor_ci", "1234567 LP", None),
        ("fecha", "hoy", "fecha_relativa"), ("fecha", "pronto", "fecha_incompleta"), ("fecha", "3 de mayo", "fecha_sin_anio"), ("fecha", "3 de mayo de 2024", None), ("fecha", "fecha de hoy", "fecha_con_etiqueta"),
        ("lugar", "SCZ", "lugar_sigla"), ("lugar", "SANTA CRUZ", None), ("lugar", "La Paz", None), ("lugar", "lugar de suscripción: Sucre", "lugar_con_etiqueta"),
        ("monto", "mucho", "monto_sin_numero"), ("monto", "500", "monto_sin_moneda"), ("precio", "Bs. 500", None), ("plazo", "largo", "plazo_sin_unidad"), ("plazo", "doce meses", None),
        ("otro", "--", "ilegible"), ("otro", "x" * 401, "largo"), ("otro", "", None), ("otro", None, None),
    ]
    got = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, k string, v string").select("i", C.reviewed(F.col("k"), F.col("v"))["codigo"].alias("c")).orderBy("i").collect()
    assert [(cases[r["i"]][:2], r["c"]) for r in got] == [((k, v), want) for k, v, want in cases]


def test_drafts(spark):
    text = one(spark, C.draft(F.lit("T"), {"a": F.lit("1"), "b": F.lit(None).cast("string"), "c": F.lit(" ")}))[0]
    assert text == "T\na: 1\nb: [FALTA: b]\nc: [FALTA: c]" and one(spark, C.pending(F.lit(text)), C.pending(F.lit("x"))) == (["b", "c"], [])


def test_account_of_a_building_contract(spark):
    """The facts of an account with amounts, shares, dates and a further term, and the ceiling that follows from them."""
    told = (
        "El 10 de enero de 2026 contraté a una empresa para remodelar por Bs 180.000 en total.\nPagué un anticipo de Bs 72.000.\nQuedó un saldo de Bs 108.000.\n"
        "La cláusula penal es de 0,5% por día de retraso.\nLa penalidad tiene un máximo del 10%.\nDebía entregar hasta el 5 de mayo de 2026.\n"
        "Le di diez días adicionales.\nOtra empresa cobró Bs 28.000 para terminar y reparar.\n1. ¿Hay mora?"
    )
    facts, cap = one(spark, C.case_facts(F.lit(told)), C.capped(C.case_facts(F.lit(told))))
    assert {f["label"]: f["value"] for f in facts} == {
        "precio_total": "180000", "anticipo": "72000", "saldo_pendiente": "108000", "gasto_adicional": "28000", "penalidad_diaria": "0.5", "tope_contractual": "10",
        "fecha_contrato": "10 de enero de 2026", "fecha_entrega_pactada": "5 de mayo de 2026", "plazo_adicional": "diez días adicionales",
    }
    assert str(cap) == "18000.00" and all(f["evidence"] in told for f in facts)
    assert one(spark, C.case_facts(F.lit("")), C.capped(C.case_facts(F.lit("nada")))) == ([], None)


def test_spans(spark):
    import re

    rnd = random.Random(3)
    for pattern in (r"\d+", r"(?i)a+b", "é[xy]"):
        texts = ["", "no"] + ["".join(rnd.choice("aAbé xy12\n") for _ in range(60)) for _ in range(20)]
        got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.spans(F.col("t"), pattern).alias("s")).collect()
        assert {r["i"]: [tuple(x) for x in r["s"]] for r in got} == {i: [(m.start(), m.group()) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_signals_of_what_is_asked(spark):
    asked = F.array(F.lit("plazo"))
    score = lambda text, intent: C.chunk_score(asked, F.lit("plazo"), F.lit(text), F.lit(intent))
    got = one(spark, score("El plazo es de doce meses, con vencimiento", "plazo"), score("Nada dice", "plazo"), score("El plazo", None))
    assert [round(x, 6) for x in got] == [1 + 0.9 + 0.25, 0.0, 1.0]


def test_what_a_fact_is_made_of_is_written_once(spark):
    """Of higher-order functions whatever a lambda refers to is made anew for each element, so it must not be written into them."""
    for column in (C.case_facts(F.col("t")), C.capped(C.case_facts(F.col("t")))):
        df = spark.createDataFrame([("El precio es Bs 180.000. El tope es de 10%.",)], "t string").select(column.alias("x"))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(C.D.NEAR_AMOUNT[1][1]) <= 2 and plan.count("quisiera saber") == 1
    assert df.first()["x"] == 18000


def test_work_on_small_rows_is_dealt(spark):
    from palimpsest.plans.catalog_queries import QUERIES

    for name in ("case_facts", "derived_cap", "label_figures"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
