"""Checks that answers rest on their sources: quotations, figures, references, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import dictionaries as D
from palimpsest.functions.text import any_of, bound, collapsed, fold, spans, words


def quoted(source: Column, quote: Column) -> Column:
    """Whether a quotation occurs literally, but for case and white space. An empty quotation doesn't count."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return F.contains(plain(source), plain(quote)) & (F.trim(quote) != "")


def figures(text: Column) -> Column:
    """The digit runs of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)))


def canonical(number: Column) -> Column:
    """A number's text without thousands separators and with a decimal point: 1.500,00 and 1,500.00 become 1500.00."""
    bare = F.regexp_replace(number, r"(?<=\d)[.,](?=\d{3}(?:\D|$))", "")
    return F.regexp_replace(bare, ",", ".")


def supported(text: Column, evidence: Column) -> Column:
    """Figures of text that evidence lacks."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1)), lambda x: F.regexp_replace(canonical(x), r"\.0+$", ""))
    return F.array_except(numbers(text), numbers(evidence))


#: White space of all scripts, for a class of characters in the regular expressions of both engines.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ENDS, SEPARATORS = f"^[{WHITE}]+|[{WHITE}]+$", f"[{WHITE}.,-]"
#: A value's pieces: words of two characters or more, and single digits.
PIECES = r"[\p{L}\p{N}_%]{2,}|[\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def literal(value: Column, text: Column, evidence: Column | None = None) -> Column:
    """Whether a value stands in a text: folded, or folded without white space, full stops, commas and hyphens. A value of
    fewer than three characters may do so by chance and needs evidence besides. One that doesn't stand there holds if all
    its pieces do and there is evidence, for words may be in another order. evidence: the fragment that the value was taken
    from, which has to have three characters or more and to stand in the text itself. Blank values don't hold."""
    bare = lambda c: F.regexp_replace(c, ENDS, "")
    compact = lambda c: F.regexp_replace(c, SEPARATORS, "")
    evidence = bare(F.coalesce(evidence if evidence is not None else F.lit(""), F.lit("")))

    def held(b: Column) -> Column:
        stands = lambda x: (x != "") & (F.contains(b["plain"], x) | ((compact(x) != "") & F.contains(b["compact"], compact(x))))
        proven = (F.length(evidence) >= 3) & stands(bare(fold(evidence)))
        pieces = F.forall(F.regexp_extract_all(b["value"], F.lit(PIECES), F.lit(0)), stands)
        return (b["value"] != "") & F.when(stands(b["value"]), (F.length(b["value"]) >= 3) | proven).otherwise(proven & pieces)

    texts = lambda plain: F.struct(plain.alias("plain"), compact(plain).alias("compact"), bare(fold(value)).alias("value"))
    return F.when(value.isNotNull() & text.isNotNull(), bound(bound(fold(text), texts), held))


def derived_cap(price: Column, percent: Column) -> Column:
    """price * percent / 100 to two places, half to even, exactly."""
    return F.bround(price.cast("decimal(24,6)") * percent.cast("decimal(9,4)") / F.lit(100), 2).cast("decimal(38,2)")


def vector_checks(v: Column, dimension: int) -> list[Column]:
    """right_size, finite, unit."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return [(F.size(v) == dimension).alias("right_size"), finite.alias("finite"), (F.abs(norm - 1) < 0.001).alias("unit")]


def first_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """The match of any of the patterns that begins first, of equals that of the first pattern; null if none occurs."""
    hit = lambda p, k: F.when(F.regexp_instr(text, F.lit(p)) > 0, F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(k).alias("k"), F.regexp_extract(text, p, 0).alias("text")))
    return F.array_min(F.filter(F.array(*(hit(p, k) for k, p in enumerate(patterns))), lambda x: x.isNotNull()))["text"]


def external_authority(text: Column) -> Column:
    """The first authority outside the sources that a text names: a law, decree, ruling or constitution by name or number."""
    return first_of(text, D.AUTHORITIES)


def cited_articles(text: Column) -> Column:
    """Numbers of the articles that a text refers to, enumerations whole, each once."""
    lists = F.regexp_extract_all(text, F.lit(D.ARTICLES), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)))))


def foreign_articles(answers: DataFrame, sources: DataFrame, key: str, text_col: str, number_col: str) -> DataFrame:
    """Rows (key, number) of articles that an answer refers to and its sources don't have. sources: rows (key, number_col)."""
    cited = answers.select(key, F.explode(cited_articles(F.col(text_col))).alias("number"))
    there = sources.select(key, F.col(number_col).cast("string").alias("number")).distinct()
    return cited.join(there, [key, "number"], "left_anti")


def numbers(text: Column) -> Column:
    """A text's numbers in canonical form, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({D.NUMBERS})"), F.lit(1)), canonical)


def decimals(text: Column, pattern: str) -> Column:
    """The amounts or shares of a text that a pattern finds, as decimals, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), F.lit(1)), lambda x: canonical(F.regexp_extract(x, r"\d+(?:[.,]\d+)*", 0)).try_cast("decimal(24,6)"))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def derived_figures(evidence: Column) -> Column:
    """What each share of the evidence makes of each of its amounts, to two places, half to even: the only figures that
    may be new. Shares over 100 and amounts of nothing don't count."""
    amounts = F.filter(decimals(evidence, D.AMOUNT), lambda x: x > 0)
    shares = F.filter(decimals(evidence, D.PERCENT), lambda x: (x > 0) & (x <= 100))
    return F.array_distinct(F.flatten(F.transform(amounts, lambda a: F.transform(shares, lambda s: derived_cap(a, s)))))


def unsupported(text: Column, evidence: Column, derived: bool = False) -> Column:
    """Figures of a text, references to articles aside, that its evidence has not; derived: nor gives by a share of an amount."""
    rest = F.array_except(numbers(F.regexp_replace(text, D.ARTICLES, " ")), numbers(evidence))
    if not derived:
        return rest
    given = derived_figures(evidence)
    return F.filter(rest, lambda n: ~F.coalesce(F.array_contains(given, F.bround(n.try_cast("decimal(24,6)"), 2).cast("decimal(38,2)")), F.lit(False)))


def foreign_codes(text: Column, sources: Column) -> Column:
    """Names of codes in a text that none of the sources' codes (an array) holds, folded and without their country."""
    named = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p.replace("(?i)", "(?i)(", 1) + ")" if p.startswith("(?i)") else f"({p})"), F.lit(1)) for p in D.CODES)))
    plain = F.transform(named, lambda x: F.regexp_replace(F.regexp_replace(fold(x), r"\s+", " "), " boliviano$", ""))
    return F.array_distinct(F.filter(plain, lambda x: ~F.exists(sources, lambda s: F.contains(fold(s), x))))


def prose_fault(text: Column, articles: Column, codes: Column, evidence: Column, derived: bool = False) -> Column:
    """The first reason for which an answer's prose doesn't rest on its sources, or null. articles: their numbers (array
    of strings), codes: the names of their codes, evidence: their texts and the account."""
    foreign = F.array_except(cited_articles(text), articles)
    return (
        F.when(any_of(text, D.AUTHORITIES), "norma_externa_en_prosa")
        .when(F.size(foreign) > 0, "articulo_fuera_de_fuentes")
        .when(F.rlike(text, F.lit(D.INTERNAL_MARK)), "identificador_interno_en_prosa")
        .when(F.rlike(text, F.lit(D.STATUS_CLAIM)), "vigencia_o_razonamiento_en_prosa")
        .when(F.size(foreign_codes(text, codes)) > 0, "codigo_fuera_de_fuentes")
        .when(F.size(unsupported(text, evidence, derived)) > 0, "cifra_fuera_de_fuentes")
    )


def mislabelled(text: Column, facts: Column) -> Column:
    """array<struct<label, figure>> of figures that stand beside a label whose fact has another value. facts: map<label, decimal>.

    A figure owns the text up to the figures before and behind it, and of that the 55 characters before and 28 behind,
    within its sentence. The label that ends nearest before it counts, else the one that begins first behind it.
    """

    def of(pattern: str, labels: tuple) -> Column:
        def judged(between: Column, figure: Column, k: Column) -> Column:
            left, right = F.get(between, k), F.get(between, k + 1)
            before = F.element_at(F.split(fold(F.substring(left, F.greatest(F.lit(1), F.length(left) - 54), F.lit(55))), "[.;]"), -1)
            behind = F.element_at(F.split(fold(F.substring(right, F.lit(1), F.lit(28))), "[.;]"), 1)
            known = lambda name: facts[name].isNotNull()

            def nearest(near: Column) -> Column:
                end = lambda p: F.length(F.regexp_extract(near["before"], f"(?s)^.*(?:{p})", 0))
                previous = F.array_max(F.array(*(F.when(known(n) & F.rlike(near["before"], F.lit(b)), F.struct(end(b).alias("at"), F.lit(n).alias("label"))) for n, b, _ in labels)))
                following = F.array_min(F.filter(F.array(*(F.when(known(n) & F.rlike(near["behind"], F.lit(a)), F.struct(F.regexp_instr(near["behind"], F.lit(a)).alias("at"), F.lit(n).alias("label"))) for n, _, a in labels if a)), lambda x: x.isNotNull()))
                return F.struct(F.coalesce(previous["label"], following["label"]).alias("label"), canonical(F.regexp_extract(figure, r"\d+(?:[.,]\d+)*", 0)).try_cast("decimal(24,6)").alias("value"))

            wrong = lambda x: F.when(x["label"].isNotNull() & x["value"].isNotNull() & (x["value"] != facts[x["label"]]), F.struct(x["label"].alias("label"), figure.alias("figure")))
            return bound(bound(F.struct(before.alias("before"), behind.alias("behind")), nearest), wrong)

        found = F.regexp_extract_all(text, F.lit(f"(?i)({pattern.removeprefix('(?i)')})"), F.lit(1))
        each = bound(F.split(text, pattern, -1), lambda between: F.transform(found, lambda figure, k: judged(between, figure, k)))
        return F.filter(each, lambda x: x.isNotNull())

    return F.concat(of(D.AMOUNT, D.AMOUNT_LABELS), of(D.PERCENT, D.PERCENT_LABELS))


def misdated(text: Column, account: Column, facts: Column) -> Column:
    """array<struct<fault, label, figure>> of a text's dates and terms, in this order, that don't hold: dates that the account
    hasn't, dates beside the label of a fact with another date, terms in digits (of days, months, years) that the account
    hasn't. facts: map<label, date in words>. Null for a null text or account.

    The label nearest to a date counts, of those among the 65 characters before and 55 behind it within its sentence; of two
    as near, the first by name. Texts are compared folded, white space as one space.
    """

    def cut(told: Column, d: Column) -> Column:
        """A date with what stands before and behind it."""
        end = d["at"] + F.length(d["text"])
        before = F.element_at(F.split(F.substring(told, F.greatest(d["at"] - 64, F.lit(1)), F.least(d["at"], F.lit(65))), "[.;]"), -1)
        behind = F.element_at(F.split(F.substring(told, end + 1, F.lit(55)), "[.;]"), 1)
        return F.struct(d["text"].alias("text"), before.alias("before"), behind.alias("behind"))

    def nearest(d: Column) -> Column:
        near = []
        for label, pattern in D.DATE_LABELS:
            upto, at = F.length(F.regexp_extract(d["before"], f"(?s)^.*(?:{pattern})", 0)), F.regexp_instr(d["behind"], F.lit(pattern))
            there = facts[label].isNotNull()
            near.append(F.when(there & (upto > 0), F.struct((F.length(d["before"]) - upto).alias("far"), F.lit(label).alias("label"))))
            near.append(F.when(there & (at > 0), F.struct((at - 1).alias("far"), F.lit(label).alias("label"))))
        return F.struct(d["text"].alias("text"), F.array_min(F.array(*near))["label"].alias("label"))

    def judged(known: Column, d: Column) -> Column:
        wrong = lambda name, label: F.struct(F.lit(name).alias("fault"), label.alias("label"), d["text"].alias("figure"))
        other = collapsed(fold(facts[d["label"]])) != d["text"]
        return F.when(~F.contains(known, d["text"]), wrong("fecha_no_verificada", F.lit(None).cast("string"))).when(other, wrong("fecha_con_evento_equivocado", d["label"]))

    def faults(b: Column) -> Column:
        dates = F.transform(F.transform(spans(b["told"], D.CASE_DATE), lambda d: cut(b["told"], d)), nearest)
        wrong = F.filter(F.transform(dates, lambda d: judged(b["known"], d)), lambda x: x.isNotNull())
        terms = lambda c: F.regexp_extract_all(c, F.lit(D.TERM), F.lit(1))
        new = F.filter(terms(b["told"]), lambda x: ~F.array_contains(terms(b["known"]), x))
        return F.concat(wrong, F.transform(new, lambda x: F.struct(F.lit("duracion_no_verificada").alias("fault"), F.lit(None).cast("string").alias("label"), x.alias("figure"))))

    # an array of one, so that both texts are folded once
    bound = F.array(F.struct(collapsed(fold(text)).alias("told"), collapsed(fold(account)).alias("known")))
    return F.get(F.transform(bound, faults), F.lit(0))


def pruned_context(items: DataFrame, account_col: str, evidence_col: str, name_col: str, kind_col: str) -> DataFrame:
    """items with reason: null for what an account holds literally, else why it goes. kind: hechos, actores or relaciones;
    an actor's name has to stand in the account as well as its evidence."""
    holds = lambda c: F.coalesce(_holds(F.col(account_col), F.col(c)), F.lit(False))
    blank = F.trim(F.coalesce(evidence_col, F.lit(""))) == ""
    reason = (
        F.when((F.col(kind_col) == "hechos") & (blank | ~holds(evidence_col)), "hecho_no_literal")
        .when((F.col(kind_col) == "actores") & ~holds(evidence_col), "evidencia_de_actor_no_literal")
        .when((F.col(kind_col) == "actores") & (F.coalesce(name_col, F.lit("")) != "") & ~holds(name_col), "nombre_inventado")
        .when((F.col(kind_col) == "relaciones") & ~holds(evidence_col), "evidencia_de_relacion_no_literal")
    )
    return items.withColumn("reason", reason)


def _holds(source: Column, part: Column) -> Column:
    """Whether part stands in source, but for case and white space."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.contains(plain(source), plain(part))


observed = _holds


def contradicted(limitation: Column, account: Column) -> Column:
    """Whether a limitation says nothing, or says that something is missing whose every word the account has."""
    claim = F.regexp_instr(limitation, F.lit(D.MISSING_CLAIM))
    rest = F.substring(limitation, claim + F.length(F.regexp_extract(limitation, D.MISSING_CLAIM, 0)), F.length(limitation))
    asked = F.array_except(words(rest), F.array(*map(F.lit, D.EMPTY_WORDS)))
    empty = F.rlike(limitation, F.lit(D.EMPTY_CLAIM))
    return empty | ((claim > 0) & (F.size(asked) > 0) & (F.size(F.array_except(asked, words(account))) == 0))


def coverage(wanted: DataFrame, sections: DataFrame, citations: DataFrame, allowed: DataFrame, case: str, problem: str, source: str) -> DataFrame:
    """Rows (case, problem, source, fault) of an answer in sections: problems without a section, problems with several,
    sections of no problem, rules without a citation, citations of sources that aren't the problem's.

    wanted: (case, problem); sections: (case, problem, has_rule); citations: (case, problem, source); allowed: (case,
    problem, source). Anti joins and one count; nothing is gathered.
    """
    none = F.lit(None).cast(citations.schema[source].dataType)
    fault = lambda df, name: df.select(case, problem, none.alias(source), F.lit(name).alias("fault"))
    keys = [case, problem]
    counted = sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("has_rule").alias("has_rule"))
    found = fault(wanted.join(counted, keys, "left_anti"), "pregunta_omitida")
    found = found.unionByName(fault(counted.where("n > 1"), "apartado_duplicado"))
    found = found.unionByName(fault(counted.join(wanted, keys, "left_anti"), "problema_inexistente"))
    found = found.unionByName(fault(counted.where("has_rule").join(citations, keys, "left_anti"), "regla_sin_cita"))
    foreign = citations.join(allowed, [case, problem, source], "left_anti")
    return found.unionByName(foreign.select(case, problem, source, F.lit("fuente_de_otro_problema").alias("fault")))


def unreserved(family: Column, text: Column) -> Column:
    """The fault of a conclusion that claims too much for its theme without a reservation, or null."""
    plain, out = fold(text), F.lit(None).cast("string")
    for theme, claim, reservation, fault in D.RESERVED:
        out = F.when((family == theme) & F.rlike(plain, F.lit(claim)) & ~F.rlike(plain, F.lit(reservation)), fault).otherwise(out)
    return out


def admits_no_source(text: Column) -> Column:
    return F.rlike(fold(text), F.lit(D.NO_SOURCE))


def fact_fault(text: Column, facts: Column, declared: Column) -> Column:
    """Why a draft's markers {{role:id}} don't hold, or null. facts: map<id, role>; declared: the ids that it says it uses.
    Figures and terms may stand there as markers alone, but for references to articles."""
    markers = F.regexp_extract_all(text, F.lit(f"({D.FACT_MARKER})"), F.lit(1))
    id_of, role_of = (lambda m: F.regexp_extract(m, D.FACT_MARKER, 2)), (lambda m: F.regexp_extract(m, D.FACT_MARKER, 1))
    judged = lambda x: F.when(x["known"].isNull(), "hecho_id_inexistente").when(x["known"] != x["role"], "rol_de_hecho_incorrecto").when(~F.array_contains(declared, x["id"]), "hecho_no_declarado")
    fault = lambda m: bound(F.struct(id_of(m).alias("id"), role_of(m).alias("role"), facts[id_of(m)].alias("known")), judged)
    first = F.get(F.filter(F.transform(markers, fault), lambda x: x.isNotNull()), F.lit(0))
    unmarked = lambda rest: (
        F.when(F.contains(rest, F.lit("{{")) | F.contains(rest, F.lit("}}")), "marcador_de_hecho_invalido")
        .when(F.rlike(F.regexp_replace(rest, D.ARTICLES, " "), F.lit(D.NUMBERS)), "cifra_sin_hecho_id")
        .when(F.rlike(rest, F.lit(D.WRITTEN_TERM)), "duracion_sin_hecho_id")
    )
    return F.coalesce(first, bound(F.regexp_replace(text, D.FACT_MARKER, " "), unmarked))


def facts_filled(text: Column, facts: Column) -> Column:
    """A draft with its markers replaced. facts: array<struct<id, role, shown>>."""
    put = lambda a, f: F.replace(a, F.concat(F.lit("{{"), f["role"], F.lit(":"), f["id"], F.lit("}}")), f["shown"])
    return F.aggregate(facts, text, put)


def shown_amount(value: Column) -> Column:
    """Bs 1.234.567,50: points between thousands, a comma and two places, half to even, unless the amount is whole."""
    places = lambda n: F.translate(F.format_number(value, n), ",.", ".,")
    return F.concat(F.lit("Bs "), F.when(value % 1 == 0, places(0)).otherwise(places(2)))


def shown(value: Column, unit: Column) -> Column:
    """A fact's value (text) as readers see it, by its unit: a date (from ISO form) in words, days, a share with a comma, an
    amount of bolivianos; anything else as it stands. Null where a date or an amount can't be read."""
    date = value.try_cast("date")
    worded = F.concat_ws(" de ", F.day(date).cast("string"), F.element_at(F.array(*map(F.lit, D.SHOWN_MONTHS)), F.month(date)), F.year(date).cast("string"))
    return (
        F.when(unit == "fecha", F.when(date.isNotNull(), worded))
        .when(unit == "días", F.concat(value, F.lit(" días")))
        .when(unit == "%", F.concat(F.replace(value, F.lit("."), F.lit(",")), F.lit("%")))
        .when(unit == "BOB", shown_amount(value.try_cast("decimal(24,6)")))
        .otherwise(value)
    )


def template_fault(text: Column, facts: Column, declared: Column, articles: Column, codes: Column, evidence: Column) -> Column:
    """Why a draft with markers of facts doesn't hold: fact_fault()'s reason, else prose_fault()'s over what stands beside the
    markers, or null. declared: null where a draft declares nothing."""
    rest = F.array(F.regexp_replace(text, D.FACT_MARKER, " "))  # an array of one, so that markers go once
    return F.coalesce(fact_fault(text, facts, declared), F.get(F.transform(rest, lambda r: prose_fault(r, articles, codes, evidence)), F.lit(0)))


#: Names: words with a capital that don't open a sentence, or do and are followed by another one.
_CAPITAL = r"[A-ZÁÉÍÓÚÑ][\wáéíóúñ]{2,}"
_NAMES = rf"(?:(?<=[^\s.:;!?¿¡)\-–—•\"«(*][ \t]{{1,8}})\b{_CAPITAL}\b|(?<![\p{{L}}\d]){_CAPITAL}\b(?=[ \t]+[A-ZÁÉÍÓÚÑ]))"


def unsupported_names(text: Column, evidence: Column, known: tuple[str, ...] = ()) -> Column:
    """Capitalised words of a text that neither its evidence nor a fixed vocabulary (folded) has, each once."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_NAMES})"), F.lit(1)))
    plain = fold(evidence)
    return F.filter(found, lambda w: ~F.contains(plain, fold(w)) & ~fold(w).isin(*(known or ("",))))


def without_foreign(text: Column, articles: Column, codes: Column) -> Column:
    """A text without the sentences that name authorities, articles or codes outside the sources; paragraphs stay."""
    foreign = lambda s: any_of(s, D.AUTHORITIES) | (F.size(F.array_except(cited_articles(s), articles)) > 0) | (F.size(foreign_codes(s, codes)) > 0)
    kept = lambda p: F.array_join(F.transform(F.filter(F.split(p, r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿])"), lambda s: ~foreign(s)), lambda s: F.trim(s)), " ")
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), kept), lambda p: F.trim(p) != "")
    return F.array_join(paragraphs, "\n\n")


def ungroundable(request: Column) -> Column:
    """Whether a request asks for what no source can ground."""
    return F.rlike(fold(request), F.lit(D.UNGROUNDABLE))


def time_sentence(question: Column, text: Column) -> Column:
    """The first sentence of at most 260 characters with a figure that says when something begins or ends, as asked."""
    asked = fold(question)
    sentences = F.split(text, r"(?<=[.;])\s+|\n+")
    first = lambda cue: F.get(F.filter(sentences, lambda s: F.rlike(fold(s), F.lit(cue)) & F.rlike(s, F.lit(r"\d")) & (F.length(s) <= 260)), F.lit(0))
    return F.trim(F.when(F.rlike(asked, F.lit(D.BEGINS[0])), first(D.BEGINS[1])).when(F.rlike(asked, F.lit(D.ENDS[0])), first(D.ENDS[1])))

