"""Every registered query beside its SQL, or beside a plain version of itself."""

import re
from collections import Counter

import pytest
from oracle import differences

from palimpsest.functions import dictionaries as D
from palimpsest.operators import documents as O
from palimpsest.plans.catalog_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert differences(spark, SF, QUERIES[name], ORACLE_SQL[name]) == ""


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return Counter(map(tuple, QUERIES[name](spark, SF).collect()))


def plain_clauses(text):
    """(orden, inicio, fin): headings line by line."""
    at, starts = 0, []
    for line in text.split("\n"):
        folded = "".join(c.lower().translate(str.maketrans("áéíóúüñàèìòù", "aeiouunaeiou")) for c in line).strip(" \t")
        named = re.match(r"clausula[ \t]+([a-z]+|\d+)|articulo[ \t]+\d+", folded)
        ordinal = re.match(r"([a-z]+(?:[ \t]*[a-z]+)?)[ \t]*[.:-]", folded)
        bare = ordinal and (ordinal[1] in D.ORDINALS or ordinal[1].startswith("decimo"))
        if named or bare:
            starts.append(at)
        at += len(line) + 1
    return [(n + 1, a, b) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)]))]


def test_segment_clauses(spark, texts):
    want = Counter((d, *c) for d, t in texts.items() for c in (plain_clauses(t or "") or [(None, None, None)]))
    assert rows(spark, "segment_clauses") == want


def test_extract_entities(spark, texts):
    want = Counter()
    patterns = [(k, re.compile(p, re.I)) for k, ps in D.ENTITIES.items() for p in ps]
    for d, t in texts.items():
        at, clauses = 0, plain_clauses(t or "")
        while at < len(t or ""):
            found = [(m.end(), k) for k, p in patterns if (m := p.match(t, at))]
            if not found:
                at += 1
                continue
            end = max(e for e, _ in found)
            kind = next(k for e, k in found if e == end)
            want[d, kind, t[at:end], at, end, next((n for n, a, b in clauses if a <= at < b), None)] += 1
            at = end
    assert rows(spark, "extract_entities") == want


def test_diff_paragraphs(spark, texts):
    """What is left of both versions once the changes are taken out is the same, and every change names a block of its version."""
    squeezed = lambda x: " ".join(x.split())

    def blocks(t):
        for parts in (re.split(r"\n\s*\n", t), t.splitlines()):
            found = [p.strip() for p in parts if p.strip()]
            if len(found) > 1:
                break
        return found

    cut = lambda x: x if len(x) <= 1200 else x[:1200].rstrip() + "…"
    by = {}
    for r in QUERIES["diff_paragraphs"](spark, SF).collect():
        by.setdefault(r["doc_id"], []).append(r)
    for d, t in texts.items():
        if d + 1 not in texts or plain_clauses(t or "") and plain_clauses(texts[d + 1] or ""):
            continue
        old, new = blocks(t or ""), blocks(texts[d + 1] or "")
        told = by.get(d, [])
        gone = Counter(squeezed(r["anterior"]) for r in told if r["anterior"] is not None)
        come = Counter(squeezed(r["nuevo"]) for r in told if r["nuevo"] is not None)
        left = Counter(squeezed(cut(b)) for b in old) - gone
        assert left == Counter(squeezed(cut(b)) for b in new) - come
        for r in told:
            side, shown = (old, r["anterior"]) if r["tipo"] == "eliminado" else (new, r["nuevo"])
            assert cut(side[int(r["ubicacion"].split()[1]) - 1]) == shown


def test_literal_facts(spark, texts):
    want = Counter()
    for d, t in texts.items():
        kept = []
        for s in re.split(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿])|\n+", t or ""):
            s = s.strip(" ")
            if s and not s.startswith("¿") and not re.match("|".join(D.REQUESTS), s.lower()) and s not in kept:
                kept.append(s)
        want.update((d, s) for s in kept[:24])
    assert rows(spark, "literal_facts") == want


def test_figures_subset(spark, texts):
    def numbers(t):
        bare = [re.sub(r"(?<=\d)[.,](?=\d{3}(?:\D|$))", "", x).replace(",", ".") for x in re.findall(r"\d+(?:[.,]\d+)*", t or "")]
        return list(dict.fromkeys(re.sub(r"\.0+$", "", x) for x in bare))

    want = Counter((d, n) for d, t in texts.items() if d + 1 in texts for n in numbers(t) if n not in numbers(texts[d + 1]))
    assert rows(spark, "figures_subset") == want


def test_diff_strategy(spark, texts):
    has = {d: bool(plain_clauses(t or "")) for d, t in texts.items()}
    assert rows(spark, "diff_strategy") == Counter((d, "clausulas" if has[d] and has[d + 1] else "texto") for d in texts if d + 1 in texts)


def test_risk_rules_all(spark, texts):
    """The rules for every document, whatever its type; test_documents.py and risk_contracts have the others."""
    got = {}
    for r in QUERIES["risk_rules_all"](spark, SF).collect():
        got.setdefault(r["doc_id"], set()).add(r["codigo"])
    for d, t in texts.items():
        kinds = {f[0] for f in O.findings_of(t or "")}
        want = {c for c, absent in (("GEN-SIN-CLAUSULAS", not plain_clauses(t or "")), ("GEN-SIN-FECHA", "fecha" not in kinds), ("GEN-SIN-CEDULA", "cedula" not in kinds)) if absent}
        assert {c for c in got.get(d, set()) if c.startswith("GEN-")} == want


def test_every_query_has_a_version_to_hold_it_against():
    tested = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert set(QUERIES) - set(ORACLE_SQL) <= tested
