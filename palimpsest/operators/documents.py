"""Document analytics: segmentation, extraction, classification, risk rules, comparison.

What needs no offsets stays in expressions; offsets come from Arrow functions over batches of texts.
"""

import bisect
import difflib
import re
from functools import reduce
from operator import add, and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import dictionaries as D
from palimpsest.functions.text import fold, occurs, term_pattern
from palimpsest.operators.relational import made_once

CLAUSE = "array<struct<orden:int,encabezado:string,ordinal:string,texto:string,inicio:int,fin:int>>"
FINDING = "array<struct<tipo:string,texto:string,inicio:int,fin:int,clausula:int>>"
CHANGE = "array<struct<tipo:string,ubicacion:string,anterior:string,nuevo:string,explicacion:string,clausula:int>>"
SHOWN = 1200  # characters of a text that a change shows

_accent = str.maketrans("áéíóúüñàèìòù", "aeiouunaeiou")
_ordinal = "|".join(D.ORDINALS)
_heading = re.compile(rf"^[ \t]*(?:clausula[ \t]+(?P<named>[a-z]+|\d+)|(?P<bare>{_ordinal}|decimo[ \t]*[a-z]*)[ \t]*[.:-]+|articulo[ \t]+(?P<article>\d+))[^\n]*", re.M)
_entities = [(kind, re.compile(p, re.I)) for kind, patterns in D.ENTITIES.items() for p in patterns]
_parties = re.compile(D.PARTIES, re.I)


def _plain(text: str) -> str:
    """Folded with the same length, so that offsets hold in the original."""
    return text.lower().translate(_accent)


def clauses_of(text: str) -> list[tuple]:
    """(orden, encabezado, ordinal, texto, inicio, fin); a clause goes up to the next heading."""
    folded = _plain(text)
    if len(folded) != len(text):  # a letter whose lower case is longer: fold one by one
        folded = "".join(c.lower().translate(_accent) if len(c.lower()) == 1 else c for c in text)
    heads = list(_heading.finditer(folded))
    out = []
    for n, m in enumerate(heads):
        end = heads[n + 1].start() if n + 1 < len(heads) else len(text)
        body = m.end() + (text[m.end() : m.end() + 1] == "\n")
        out.append((n + 1, text[m.start() : m.end()].strip(), (m["named"] or m["bare"] or m["article"]).upper().strip(), text[body:end], m.start(), end))
    return out


def findings_of(text: str, clauses: list[tuple] | None = None) -> list[tuple]:
    """(tipo, texto, inicio, fin, clausula) without overlaps: from left to right, of those that start together the longest."""
    clauses = clauses_of(text) if clauses is None else clauses
    found = sorted(((m.start(), -m.end(), kind) for kind, p in _entities for m in p.finditer(text)), key=lambda x: x[:2])
    begins = [c[4] for c in clauses]
    out, free = [], 0
    for start, neg_end, kind in found:
        if start >= free:
            free = -neg_end
            at = bisect.bisect_right(begins, start) - 1  # clauses follow one another without a gap
            out.append((kind, text[start:free], start, free, clauses[at][0] if at >= 0 and start < clauses[at][5] else None))
    return out


def parties_of(text: str) -> str | None:
    """The paragraph from the parties' opening words to a blank line or the first clause."""
    m = _parties.search(text)
    if not m:
        return None
    ends = [e for e in (text.find("\n\n", m.start()), next((c[4] for c in clauses_of(text)), -1)) if e > m.start()]
    return text[m.start() : min(ends, default=len(text))].strip()


def _each(of, kind: str, empty: object):
    """A Column function from a text function; types are parsed when it is called, on the driver."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([of(t) if t else empty for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return lambda c: F.pandas_udf(run, kind)(c)


clauses = _each(clauses_of, CLAUSE, [])
findings = _each(findings_of, FINDING, [])
parties = _each(parties_of, "string", None)


def counted(text: Column, kind: str) -> Column:
    """How often a kind of finding occurs, without offsets, in the JVM."""
    total = F.lit(0)
    for p in D.ENTITIES[kind]:
        total = total + F.regexp_count(text, F.lit("(?i)" + p))
    return total


def scores(plain: Column, dictionary: dict[str, tuple[tuple[str, float], ...]]) -> dict[str, Column]:
    """Weight of each class in a folded text: a term counts once however often it occurs. A term's first word is looked for
    before its pattern is."""
    has = lambda term: F.contains(plain, F.lit(term.split()[0])) & occurs(plain, term_pattern(term))
    return {name: reduce(add, (F.when(has(term), F.lit(weight)).otherwise(0.0) for term, weight in terms)) for name, terms in dictionary.items()}


def classified(df: DataFrame, text_col: str, dictionary: dict, threshold: float, otherwise: str | None = None) -> DataFrame:
    """Adds class and class_score: the heaviest class, the first of equals; `otherwise` below the threshold. Texts are folded once."""
    folded = made_once(df, {"__plain": fold(F.col(text_col))})
    each = scores(F.col("__plain"), dictionary)
    ordered = F.array(*(F.struct(c.alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (n, c) in enumerate(each.items())))
    made = made_once(folded, {"__best": F.array_max(ordered)})
    best = F.col("__best")
    ok = best["score"] >= threshold
    return made.withColumns({"class": F.when(ok, best["name"]).otherwise(F.lit(otherwise)), "class_score": F.when(ok, best["score"]).otherwise(0.0)}).drop("__plain", "__best")


def intent(text: Column, has_document: Column) -> Column:
    """What a request wants; a question neither saves nor analyses."""
    plain, asks = fold(text), F.contains(text, F.lit("?"))
    law, doc = occurs(plain, *D.LAW), occurs(plain, *D.DOCUMENT)
    return (
        F.when(~has_document, "consulta_general")
        .when(~asks & occurs(plain, *D.ANALYSE), "analizar_documento")
        .when(~asks & occurs(plain, *D.SAVE), "guardar_documento")
        .when(law & doc, "consulta_documento_normativa")
        .when(law, "consulta_general")
        .otherwise("consulta_documento")
    )


SUBLET, INTEREST, CAPITAL = r"\bsubarr[a-z0-9_]*", r"\binteres[a-z0-9_]*", r"\bcapitaliz[a-z0-9_]*"
RATE = r"[0-9]+(?:[.,][0-9]+)?\s*%"
#: What rules look for in a folded text, by the type of document that they hold for.
LOOKED_FOR = {
    "compraventa": {"alien": r"\b(?:cosa ajena|no es propietario)\b", "estate": r"\b(?:venta de herencia|derechos hereditarios)\b"},
    "arrendamiento": {"sublet": SUBLET, "antichresis": r"\banticre(?:si|tic)[a-z0-9_]*"},
    "prestamo": {"rate": RATE, "percent": rf"(?:%|{INTEREST})", "interest": INTEREST, "capital": CAPITAL},
}


def risks(df: DataFrame, text_col: str, type_col: str, clause_col: str, finding_col: str) -> DataFrame:
    """Adds risks: array<struct<rango, inicio, codigo, severidad, articulos, evidencia, clausula>>, gravest first.

    Common rules hold for every document, others for its type. Evidence is cut from the original at the offsets of the
    folded text, which has the same length wherever letters are precomposed. A text is folded once, and each pattern is
    looked for once, in documents of its type alone.
    """
    t, plain, kind = F.col(text_col), F.col("__plain"), F.col(type_col)
    names = [n for found in LOOKED_FOR.values() for n in found]

    def spot(owner: str, pattern: str) -> Column:
        """Place from 0 and length of the first match, null without one and in documents of another type."""
        at = F.when(kind == owner, F.nullif(F.regexp_instr(plain, F.lit(pattern)), F.lit(0)))
        return F.when(at.isNotNull(), F.struct((at - 1).alias("at"), F.length(F.regexp_extract(plain, pattern, 0)).alias("n")))

    spots = {f"__{n}": spot(owner, p) for owner, found in LOOKED_FOR.items() for n, p in found.items()}
    known = made_once(made_once(df, {"__plain": fold(t), "__kinds": F.transform(finding_col, lambda x: x["tipo"])}), spots)
    lacks = lambda *kinds: ~F.arrays_overlap("__kinds", F.array(*map(F.lit, kinds)))
    place = lambda n: F.col(f"__{n}")
    grade = {"alta": 3, "media": 2, "baja": 1}

    def hit(code: str, level: str, articles: tuple[int, ...], when: Column, *found: str) -> Column:
        """Evidence reaches from the first to the last of what is found."""
        first = [place(n)["at"] for n in found] or [F.lit(None).cast("int")]
        ends = [place(n)["at"] + place(n)["n"] for n in found] or [F.lit(None).cast("int")]
        at, upto = (F.least(*first), F.greatest(*ends)) if len(found) > 1 else (first[0], ends[0])
        clause = F.get(F.transform(F.filter(clause_col, lambda c: (c["inicio"] <= at) & (at < c["fin"])), lambda c: c["orden"]), F.lit(0))
        there = [place(n).isNotNull() for n in found]
        told = F.struct(
            F.lit(-grade[level]).alias("rango"), F.coalesce(at, F.lit(-1)).alias("inicio"), F.lit(code).alias("codigo"), F.lit(level).alias("severidad"),
            F.array(*map(F.lit, articles)).alias("articulos"), F.substring(t, at + 1, upto - at).alias("evidencia"), clause.alias("clausula"),
        )
        return F.when(reduce(and_, there, when), told)

    sale, lease, loan = (kind == k for k in LOOKED_FOR)
    begins = place("sublet")["at"]
    near = F.substring(plain, F.greatest(F.lit(1), begins - 59), place("sublet")["n"] + F.least(begins, F.lit(60)) + 60)
    allowed = F.rlike(near, F.lit(r"\bprohib")) | F.rlike(plain, F.lit(r"\b(?:autorizacion expresa|autoriza expresamente)\b"))
    apart = F.abs(place("interest")["at"] - place("capital")["at"])
    all_rules = F.array(
        hit("GEN-SIN-CLAUSULAS", "media", (493,), F.size(clause_col) == 0),
        hit("GEN-SIN-FECHA", "media", (493,), lacks("fecha")),
        hit("GEN-SIN-CEDULA", "alta", (549,), lacks("cedula")),
        hit("CV-PRECIO-AUSENTE", "alta", (613,), sale & lacks("monto_bs", "monto_usd")),
        hit("CV-COSA-AJENA", "alta", (595, 596), sale, "alien"),
        hit("CV-VENTA-HERENCIA", "media", (607,), sale, "estate"),
        hit("AR-SIN-PLAZO", "media", (687,), lease & lacks("plazo")),
        hit("AR-SUBARRIENDO-SIN-AUTORIZACION", "alta", (707,), lease & F.when(place("sublet").isNotNull(), ~allowed), "sublet"),
        hit("AR-ANTICRETICO-SIMULTANEO", "alta", (716,), lease & F.when(place("antichresis").isNotNull(), F.rlike(plain, F.lit(r"\b(?:arrendamient|arriend|alquile|alquila)"))), "antichresis"),
        hit("PR-INTERES-PACTADO", "media", (413,), loan, "rate"),
        hit("PR-INTERES-PACTADO", "media", (413,), loan & place("rate").isNull(), "percent"),
        hit("PR-INTERES-CAPITALIZADO", "alta", (413,), loan & (apart <= 150), "interest", "capital"),
        hit("PR-SIN-PLAZO-DEVOLUCION", "media", (493,), loan & lacks("plazo")),
    )
    return known.withColumn("risks", F.array_sort(F.filter(all_rules, lambda x: x.isNotNull()))).drop("__plain", "__kinds", *(f"__{n}" for n in names))


def _collapsed(text: str) -> str:
    return " ".join(text.split())


def _shown(text: str) -> str:
    text = text.strip()
    return text if len(text) <= SHOWN else text[:SHOWN].rstrip() + "…"


_told = (
    ("El monto cambió de {} a {}.", [p for kind, p in _entities if kind in ("monto_bs", "monto_usd")]),
    ("El plazo cambió de {} a {}.", [p for kind, p in _entities if kind == "plazo"]),
    ("La fecha cambió de {} a {}.", [p for kind, p in _entities if kind == "fecha"]),
)


def explanation(old: str, new: str) -> str:
    """What changed, in words: the first amount, term or date that differs, where both versions have as many of its kind,
    for only then is it sure which became which."""
    for words, patterns in _told:
        before, after = ([x for _, x in sorted((m.start(), m.group()) for p in patterns for m in p.finditer(text))] for text in (old, new))
        if len(before) == len(after) and before != after:
            return words.format(*next(pair for pair in zip(before, after) if pair[0] != pair[1]))
    return "El contenido de esta sección fue modificado."


def _blocks(text: str) -> list[str]:
    """Paragraphs, or the lines of a text that has but one."""
    for separator in (r"\n\s*\n", r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]"):
        found = [x.strip() for x in re.split(separator, text) if x.strip()]
        if len(found) > 1:
            break
    return found


def changes(old: str, new: str) -> list[tuple]:
    """(tipo, ubicacion, anterior, nuevo, explicacion, clausula) between two versions: by clauses where both have them,
    heading and body together, else by paragraphs. Numbers of what is in both are those of the new version."""
    parts = [clauses_of(old), clauses_of(new)]
    by_clause = all(parts)
    if by_clause:
        names = [[f"Cláusula {c[2]}" for c in cs] for cs in parts]
        texts = [["\n".join(x for x in (c[1].strip(), c[3].strip()) if x) for c in cs] for cs in parts]
        keys = [_numbered([c[2] for c in cs]) for cs in parts]
    else:
        texts = [_blocks(old), _blocks(new)]
        names = [[f"Párrafo {n + 1}" for n in range(len(ts))] for ts in texts]
        keys = [[_collapsed(x) for x in ts] for ts in texts]
    number = lambda side, k: parts[side][k][0] if by_clause else None
    out = []

    def changed(i: int, j: int) -> None:
        out.append(("modificado", names[1][j], _shown(texts[0][i]), _shown(texts[1][j]), explanation(texts[0][i], texts[1][j]), number(1, j)))

    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if op == "equal":
            for i, j in zip(range(i1, i2), range(j1, j2)):
                if _collapsed(texts[0][i]) != _collapsed(texts[1][j]):
                    changed(i, j)
            continue
        paired = 0 if by_clause else min(i2 - i1, j2 - j1)  # other ordinals are other clauses
        for k in range(paired):
            changed(i1 + k, j1 + k)
        for i in range(i1 + paired, i2):
            told = f"Se eliminó la {names[0][i].lower()}." if by_clause else "Se eliminó contenido que estaba en el primer documento."
            out.append(("eliminado", names[0][i], _shown(texts[0][i]), None, told, number(0, i)))
        for j in range(j1 + paired, j2):
            told = f"Se agregó la {names[1][j].lower()}." if by_clause else "Se agregó contenido que no estaba en el primer documento."
            out.append(("agregado", names[1][j], None, _shown(texts[1][j]), told, number(1, j)))
    return out


def _numbered(labels: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for x in labels:
        seen[x] = seen.get(x, 0) + 1
        out.append(x if seen[x] == 1 else f"{x} ({seen[x]})")
    return out


def compared(old: Column | str, new: Column | str) -> Column:
    """changes() of two columns."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([changes(x or "", y or "") for x, y in zip(a, b)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, CHANGE)(old, new)


def assigned(findings: DataFrame, clauses: DataFrame, key: str, at: str = "inicio", begin: str = "inicio", end: str = "fin", name: str = "orden") -> DataFrame:
    """Findings with the clause whose span holds their place, the first of several, null outside all: a join on the
    document alone, whose clauses are gathered first, so a row of findings stays one row."""
    spans = clauses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(begin).alias("b"), F.col(end).alias("e"), F.col(name).alias("n")))).alias("__spans"))
    holds = F.filter("__spans", lambda c: (c["b"] <= F.col(at)) & (F.col(at) < c["e"]))
    return findings.join(spans, key, "left").withColumn("assigned", F.get(F.transform(holds, lambda c: c["n"]), F.lit(0))).drop("__spans")


def pieces_of(text: str, most: int = 350) -> list[str]:
    """Pieces of `most` characters at most, cut after a sentence, line or space; joined they are the text."""
    out, rest = [], text
    while len(rest) > most:
        ends = [max(m.end() for m in ms) for p in (r"[.;!?]\s", r"\n", r" ") if (ms := list(re.finditer(p, rest[:most])))]
        at = ends[0] if ends else most
        out.append(rest[:at])
        rest = rest[at:]
    return [*out, rest] if rest else out


citable = _each(pieces_of, "array<string>", [])


#: How a draft's lines look, and the marker of what is missing.
CLAUSE_LINE, SIGNATURE_LINE, MISSING = r"^([A-ZÁÉÍÓÚÑ]+(?:\s+\d+)?)\.-\s+(.+)$", "^_{3,}", r"\[FALTA:\s*[^\]]+\]"


def draft_lines(draft: Column) -> Column:
    """array<struct<kind, text, pending>> of a draft's lines that aren't blank: titulo, firma, clausula, dato, seccion or
    parrafo; pending: array<struct<text, missing>>, the line cut at its markers."""
    lines = F.filter(F.transform(F.split(draft, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    bare = lambda x: F.regexp_replace(x, MISSING, "")
    letters = lambda x: F.regexp_replace(bare(x), r"[^\p{L}]", "")
    heading = lambda x: (F.length(letters(x)) > 0) & (F.length(x) < 60) & (letters(x) == F.upper(letters(x)))
    kind = lambda x, i: (
        F.when(i == 0, "titulo").when(F.rlike(x, F.lit(SIGNATURE_LINE)), "firma").when(F.rlike(x, F.lit(CLAUSE_LINE)), "clausula")
        .when(F.contains(bare(x), F.lit(": ")), "dato").when(heading(x), "seccion").otherwise("parrafo")
    )
    return F.transform(lines, lambda x, i: F.struct(kind(x, i).alias("kind"), x.alias("text"), marked(x).alias("pending")))


def marked(line: Column) -> Column:
    """array<struct<text, missing>>: a line cut at its markers of missing values, so that only these are shown as such."""
    between = F.split(line, MISSING)
    markers = F.regexp_extract_all(line, F.lit(f"({MISSING})"), F.lit(1))
    both = F.zip_with(between, markers, lambda a, b: F.array(F.struct(a.alias("text"), F.lit(False).alias("missing")), F.struct(b.alias("text"), F.lit(True).alias("missing"))))
    return F.filter(F.flatten(both), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def redacted(text: Column) -> Column:
    """E-mail addresses, amounts, identity numbers and pairs of capitalised words replaced by their kind, 300 characters at most."""
    c = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[correo]")
    c = F.regexp_replace(c, r"(Bs|USD|US\$)\.? ?[0-9][0-9.,]*", "[monto]")
    c = F.regexp_replace(c, r"[0-9]{5,}", "[numero]")
    c = F.regexp_replace(c, r"[A-Z][a-z]+ [A-Z][a-z]+", "[nombre]")
    return F.substring(c, 1, 300)
