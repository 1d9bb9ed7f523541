"""Cases, forms, drafts and retrieval inside one document, as Columns: nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import dictionaries as D
from palimpsest.functions.text import any_of, bound, fold, occurs, spans, words

MARKER = "[FALTA: {}]"


def first_of(plain: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first rule (name, pattern) that occurs; null if none does."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(occurs(plain, pattern), name).otherwise(out)
    return out


def all_of(plain: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The names of all rules that occur, in the rules' order."""
    return F.filter(F.array(*(F.when(occurs(plain, p), F.lit(n)) for n, p in rules)), lambda x: x.isNotNull())


def document_intent(question: Column) -> Column:
    return first_of(fold(question), D.DOCUMENT_INTENTS)


def theme(question: Column) -> Column:
    return first_of(fold(question), tuple((n, p) for n, p, _ in D.THEMES))


def long_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit("([a-z]{5,})"), F.lit(1)))


def heading_fits(question: Column, heading: Column) -> Column:
    """Whether a heading answers a question: by the pattern of the question's theme, or else by two long words of both."""
    return fits_family(theme(question), question, heading)


def fits_family(family: Column, question: Column, heading: Column) -> Column:
    """heading_fits() of a question whose theme is known; any other name is none."""
    plain = fold(heading)
    out = F.size(F.array_intersect(F.array_except(long_words(question), F.array(*map(F.lit, D.WEAK_WORDS))), long_words(heading))) >= 2
    for name, _, pattern in D.THEMES:
        out = F.when(family == name, occurs(plain, pattern)).otherwise(out)
    return out


def fitting(questions: DataFrame, headings: DataFrame, question: str, heading: str, key: str) -> DataFrame:
    """Rows (question's columns, family, key) of the questions and headings for which heading_fits() holds, found by an index
    from families and long words to headings, so pairs that share neither never meet. key: headings' own column."""
    weak = F.array(*map(F.lit, D.WEAK_WORDS))
    asked = questions.withColumns({"__q": F.monotonically_increasing_id(), "family": theme(F.col(question))})
    told = headings.select(key, fold(F.col(heading)).alias("__plain"), F.array_distinct(long_words(F.col(heading))).alias("__words"))
    by_family = told.select(key, F.explode(all_of(F.col("__plain"), tuple((n, p) for n, _, p in D.THEMES))).alias("family"))
    themed = asked.where("family IS NOT NULL").join(by_family, "family")
    words = asked.where("family IS NULL").withColumn("__word", F.explode(F.array_distinct(F.array_except(long_words(F.col(question)), weak))))
    shared = words.join(told.select(key, F.explode("__words").alias("__word")), "__word").groupBy("__q", *questions.columns, "family", key).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    columns = [*questions.columns, "family", key]
    return themed.select(*columns).unionByName(shared.select(*columns))


def focus(heading: Column, body: Column) -> Column:
    """How general a rule on failure and its consequence is: whole numbers, more is better."""
    h, b = fold(heading), fold(body)
    one = lambda cond, weight: F.when(cond, weight).otherwise(0)
    has = lambda c, w: F.contains(c, F.lit(w))
    return one(has(h, "responsabilidad") & has(h, "deudor"), 3) + one(has(h, "resarcimiento") & ~has(h, "pecuniari"), 2) + one(has(b, "contrato"), 1) - one(has(h, "requerimiento"), 1)


def numbered_questions(text: Column) -> Column:
    """What follows `1.` or `1)` at the start of a line."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*\d+[.)][ \t]+([^\n]+)"), F.lit(1)), lambda q: F.regexp_replace(F.trim(q), r"\.+$", ""))


def literal_facts(text: Column, most: int = 24) -> Column:
    """Sentences and lines that state something: no questions and no requests, each once, the first `most`."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿])|\n+"), lambda s: F.trim(s))
    states = lambda s: (s != "") & ~F.startswith(s, F.lit("¿")) & ~F.rlike(fold(s), F.lit("^(?:" + "|".join(D.REQUESTS) + ")"))
    return F.slice(F.array_distinct(F.filter(parts, states)), 1, most)


def folded_chunk_score(asked: Column, phrase: Column, told: Column, chunk: Column) -> Column:
    """chunk_score() without an intent, of a phrase and a chunk that are folded already; told: the chunk's words."""
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, told)), F.size(asked)), F.lit(0.0))
    return share + F.when((F.size(asked) > 0) & (F.length(phrase) >= 12) & F.contains(chunk, phrase), 1.0).otherwise(0.0)


def chunk_score(asked: Column, phrase: Column, chunk: Column, intent: Column | None = None, label: Column | None = None) -> Column:
    """Share of the asked words that a chunk has, and 1 more if it has the whole phrase of 12 characters or more. intent: what
    is asked about the document: 0.3 for each of up to three of its signals, 0.25 if the chunk's label or first 100
    characters have one of the first three."""
    plain = fold(chunk)
    score = folded_chunk_score(asked, fold(phrase), words(chunk), plain)
    if intent is not None:
        head = fold(F.concat_ws(" ", label if label is not None else F.lit(""), F.substring(chunk, 1, 100)))
        bonus = F.lit(0.0)
        for name, signals in D.SIGNALS.items():
            there = reduce(lambda a, b: a + b, (F.when(F.rlike(plain, F.lit(rf"\b{w}\b")), 1).otherwise(0) for w in signals))
            leads = reduce(lambda a, b: a | b, (F.contains(head, F.lit(w)) for w in signals[:3]))
            bonus = F.when(intent == name, F.least(there, F.lit(3)) * 0.3 + F.when(leads, 0.25).otherwise(0.0)).otherwise(bonus)
        score = score + bonus
    return F.when(F.size(asked) == 0, 0.0).otherwise(score)


def packed(items: Column, base: Column, budget: int, most: int) -> Column:
    """Of the first `most` items (JSON texts, best first) those that fit beside base (a JSON object with an empty list)
    within budget characters: one that is too long for what is left is passed over."""

    def step(a: Column, item: Column) -> Column:
        used = a["used"] + F.length(item) + F.when(F.size(a["kept"]) > 0, 1).otherwise(0)  # a comma between items
        return F.when(used <= budget, F.struct(F.concat(a["kept"], F.array(item)).alias("kept"), used.alias("used"))).otherwise(a)

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.length(base).alias("used"))
    return F.aggregate(F.slice(items, 1, most), start, step, lambda a: a["kept"])


def narrative(text: Column) -> Column:
    """Whether a message tells what happened to someone, rather than asks about a hypothesis."""
    plain = fold(text)
    return ~F.rlike(plain, F.lit(D.HYPOTHESIS)) & F.rlike(plain, F.lit(D.NARRATIVE))


def _near(sentence: Column, at: Column, text: Column, before: int, behind: int) -> Column:
    """What stands around a match, folded."""
    first = F.greatest(F.lit(0), at - before)
    return fold(F.substring(sentence, first + 1, at - first + F.length(text) + behind))


def case_facts(text: Column) -> Column:
    """array<struct<label, value, evidence>>: amounts, shares, dates and further terms of an account by what stands near them
    in their sentence. Of a figure's labels the last one told counts, of a date's and a term's the first."""
    fact = lambda label, value, sentence: F.struct(label.alias("label"), value.alias("value"), sentence.alias("evidence"))

    def amount(s: Column, m: Column) -> Column:
        def named(b: Column) -> Column:
            label = F.lit(None).cast("string")
            for name, pattern, close in reversed(D.NEAR_AMOUNT):
                label = F.when(F.rlike(b["near"] if close else s["plain"], F.lit(pattern)), name).otherwise(label)
            return label

        value = F.replace(F.replace(F.regexp_extract(m["text"], r"[\d.]+(?:,\d+)?$", 0), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return fact(bound(F.struct(_near(s["text"], m["at"], m["text"], 45, 45).alias("near")), named), value, s["text"])

    def share(s: Column, m: Column) -> Column:
        label = F.when(F.rlike(_near(s["text"], m["at"], m["text"], 35, 45), F.lit(D.NEAR_PERCENT[0][1])), D.NEAR_PERCENT[0][0]).otherwise(D.NEAR_PERCENT[1][0])
        return fact(label, F.replace(F.regexp_extract(m["text"], r"^\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")), s["text"])

    def day(s: Column, m: Column) -> Column:
        def named(near: Column) -> Column:
            label = F.lit(None).cast("string")
            for name, pattern in reversed(D.NEAR_DATE):
                label = F.when(F.rlike(near, F.lit(pattern)), name).otherwise(label)
            return label

        return fact(bound(_near(s["text"], m["at"], m["text"], 55, 75), named), m["text"], s["text"])

    term = lambda s, m: fact(F.lit("plazo_adicional"), m["text"], s["text"])
    once = lambda found: bound(found, lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, F.lit(1), i), lambda y: y["label"] == x["label"])))

    def told(sentences: Column) -> Column:
        each = lambda pattern, of: F.flatten(F.transform(sentences, lambda s: F.filter(F.transform(spans(s["text"], pattern), lambda m: of(s, m)), lambda x: x["label"].isNotNull())))
        last, first = F.concat(each(D.CASE_AMOUNT, amount), each(D.CASE_PERCENT, share)), F.concat(each(D.CASE_DATE, day), each(D.CASE_TERM, term))
        return F.concat(F.reverse(once(F.reverse(last))), once(first))

    return bound(F.transform(literal_facts(text), lambda s: F.struct(s.alias("text"), fold(s).alias("plain"))), told)


def capped(facts: Column) -> Column:
    """The contract's price times its ceiling in per cent, to two places, half to even; null where one is missing."""

    def made(xs: Column) -> Column:
        value = lambda name: F.get(F.filter(xs, lambda x: x["label"] == name), F.lit(0))["value"].try_cast("decimal(24,6)")
        return F.bround(value("precio_total") * value("tope_contractual").cast("decimal(9,4)") / F.lit(100), 2).cast("decimal(38,2)")

    return bound(facts, made)


def searches(text: Column) -> Column:
    """array<struct<problem, search, words, requires, focus>>: the searches behind the problems that an account has."""
    plain, known = fold(text), dict(D.PROBLEMS)
    one = lambda p, k, w, r, f: F.when(F.rlike(plain, F.lit(known[p])), F.struct(F.lit(p).alias("problem"), F.lit(k).alias("search"), F.lit(w).alias("words"), F.array(*map(F.lit, r)).alias("requires"), F.lit(f).alias("focus")))
    return F.filter(F.array(*(one(*x) for x in D.SEARCHES)), lambda x: x.isNotNull())


def answers(requires: Column, focus: Column, heading: Column, body: Column) -> tuple[Column, Column]:
    """Whether a source has all that a search requires, and 1 if its heading has the search's focus, else 0."""
    whole = fold(F.concat_ws(" ", heading, body))
    return F.forall(requires, lambda p: F.rlike(whole, p)), F.rlike(fold(heading), focus).cast("int")


def help_intent(question: Column) -> Column:
    return first_of(fold(question), D.HELP_INTENTS)


def five_roots(c: Column) -> Column:
    """First five letters of words of five letters or more, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(fold(c), F.lit("([a-z]{5,})"), F.lit(1)), lambda w: F.substring(w, 1, 5)))


def help_element(question: Column, elements: dict[str, str]) -> Column:
    """The element (name: description) that shares most five-letter roots with a question, the first of equals; null without any."""
    asked = F.array_except(five_roots(question), F.array(*map(F.lit, D.HELP_STOP_ROOTS)))
    scored = [F.struct(F.size(F.array_intersect(asked, five_roots(F.lit(f"{k.replace('_', ' ')} {text}")))).alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("name")) for i, (k, text) in enumerate(elements.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"])


def help_rule(question: Column, screen: Column, frequent: Column | None = None) -> Column:
    """struct<kind, rule, target> of the first rule that answers a question about the application: legal questions go to the
    assistant, others elsewhere are out of scope, then intents, then what other screens are for. frequent: map of folded
    questions to targets, tried last. Null: no rule answers."""
    plain = fold(question)
    has = lambda p: F.rlike(plain, F.lit(p))
    rule = lambda kind, name, target=None: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("rule"), F.lit(target).cast("string").alias("target"))
    intent = help_intent(question)
    known = F.lit(None).cast("string") if frequent is None else frequent[F.trim(F.regexp_replace(plain, "[¿?]", ""))]
    return (
        F.when(has(D.LEGAL_QUESTION), rule("redirigir_juridico", "consulta_juridica", "asistente"))
        .when(has(D.ELSEWHERE), rule("fuera_alcance", "ajena"))
        .when(has(D.COURT) & has(D.SEND), rule("ayuda", "funcion_inexistente"))
        .when(intent.isin("donde_estoy", "capacidades_pantalla", "explicar_pantalla", "siguiente_paso"), F.struct(F.lit("ayuda").alias("kind"), intent.alias("rule"), F.lit(None).cast("string").alias("target")))
        .when((screen != "generar") & has("gener") & has(r"\bdocumento\w*\b"), rule("ayuda", "otra_pantalla", "generar"))
        .when((screen != "reportes") & has("excel") & has("report"), rule("ayuda", "otra_pantalla", "reportes"))
        .when((screen != "comparaciones") & has(r"\bcompar\w*\b") & has(r"\b(?:documento|contrato)\w*\b"), rule("ayuda", "otra_pantalla", "comparaciones"))
        .when((screen != "historial") & has("donde veo") & has("documento"), rule("ayuda", "otra_pantalla", "historial"))
        .when(intent.isNotNull(), F.struct(F.lit("ayuda").alias("kind"), intent.alias("rule"), F.lit(None).cast("string").alias("target")))
        .when(known.isNotNull(), F.struct(F.lit("ayuda").alias("kind"), F.lit("pregunta_frecuente").alias("rule"), F.when(known != screen, known).alias("target")))
    )


def budgeted(chunks: Column, most: int = 6, budget: int = 6000) -> Column:
    """Of chunks (structs with their length n, best first) those that fit: one too long for what is left is passed over."""

    def step(a: Column, c: Column) -> Column:
        used = a["used"] + c["n"]
        return F.when((F.size(a["kept"]) < most) & (used <= budget), F.struct(F.concat(a["kept"], F.array(c)).alias("kept"), used.alias("used"))).otherwise(a)

    return F.aggregate(chunks, F.struct(F.filter(chunks, lambda c: F.lit(False)).alias("kept"), F.lit(0).alias("used")), step, lambda a: a["kept"])


def in_scope(answer: Column, evidence: Column) -> Column:
    """False where an answer speaks of the whole contract's beginning or end, or of all parties, and its evidence doesn't."""
    a, e = fold(answer), fold(evidence)
    wider = F.lit(False)
    for pattern in D.WIDER_CLAIMS:
        wider = wider | (occurs(a, pattern) & ~occurs(e, pattern))
    return ~wider


def merged_field(stored: Column, found: Column) -> Column:
    """What becomes of a form's field after extraction: detectado, igual, conflicto, descartado (nothing legible) or pendiente."""
    same = F.regexp_replace(fold(stored), r"\s+", " ") == F.regexp_replace(fold(found), r"\s+", " ")
    return (
        F.when(found.isNull(), "pendiente")
        .when(~F.rlike(fold(found), F.lit("[a-z0-9]")), "descartado")
        .when(stored.isNull(), "detectado")
        .when(same, "igual")
        .otherwise("conflicto")
    )


def reviewed(key: Column, value: Column) -> Column:
    """struct<nivel, codigo> of what is wrong with a form's field, or null. `error` is surely unusable, `aviso` doubtful;
    an empty field is no problem."""
    v = F.trim(value)
    plain = fold(v)
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    has = lambda *patterns: any_of(plain, patterns)
    number, month = has("[0-9]", D.NUMBER_WORDS), has("|".join(D.MONTHS))
    error = lambda code: F.struct(F.lit("error").alias("nivel"), F.lit(code).alias("codigo"))
    warn = lambda code: F.struct(F.lit("aviso").alias("nivel"), F.lit(code).alias("codigo"))
    tokens = F.regexp_extract_all(v, F.lit(r"(\p{L}+)"), F.lit(1))
    initials = F.exists(tokens, lambda w: F.length(w).between(2, 5) & (w == F.upper(w)) & ~F.lower(w).isin(*D.SHORT_WORDS))
    dated = F.rlike(plain, F.lit(r"\b[0-9]{4}\b")) | F.rlike(plain, F.lit("[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"))
    rules: list[tuple[Column, Column]] = [
        (~has("[a-z0-9]"), error("ilegible")),
        (F.length(v) > 400, warn("largo")),
        (F.endswith(key, F.lit("_nombre")) & has("[0-9]"), error("nombre_con_numeros")),
        (F.endswith(key, F.lit("_nombre")) & (F.size(tokens) < 2), error("nombre_incompleto")),
        (F.endswith(key, F.lit("_ci")) & (digits < 5), error("documento_corto")),
        (F.endswith(key, F.lit("_ci")) & (digits > 12), error("documento_largo")),
        ((key == "fecha") & has("^fecha", "fecha de suscripcion"), error("fecha_con_etiqueta")),
        ((key == "fecha") & has(D.RELATIVE_DATES), error("fecha_relativa")),
        ((key == "fecha") & ~has("[0-9]") & ~month, error("fecha_incompleta")),
        ((key == "fecha") & ~dated, warn("fecha_sin_anio")),
        ((key == "lugar") & has(r"^lugar\b", "lugar de suscripcion"), warn("lugar_con_etiqueta")),
        ((key == "lugar") & initials & (F.rlike(v, F.lit(r"\p{Ll}")) | (F.size(tokens) == 1)), warn("lugar_sigla")),
        (key.isin(*D.AMOUNT_FIELDS) & ~number, error("monto_sin_numero")),
        (key.isin(*D.AMOUNT_FIELDS) & ~has(D.CURRENCY), warn("monto_sin_moneda")),
        (key.isin(*D.TERM_FIELDS) & ~number & ~has(D.TIME_UNITS) & ~month, error("plazo_sin_unidad")),
    ]
    verdict = reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(None).cast("struct<nivel:string,codigo:string>"))
    return F.when(F.coalesce(v, F.lit("")) != "", verdict)


def draft(title: Column, fields: dict[str, Column]) -> Column:
    """A draft's text: its title and a line `label: value` for each field, a marker where a value is missing."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.when(F.trim(c) != "", c), F.lit(MARKER.format(label)))) for label, c in fields.items()]
    return F.concat_ws("\n", title, *lines)


def pending(text: Column) -> Column:
    """The labels that a draft still lacks, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[FALTA: ([^\]]+)\]"), F.lit(1))
