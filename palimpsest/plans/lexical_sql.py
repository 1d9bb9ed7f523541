"""The lexical search said in DuckDB's SQL, which the registered searches share: stems of the vocabulary, positions, ranks."""

from __future__ import annotations

from palimpsest.functions import stemming as S
from palimpsest.operators.lexical import LAST, MOST

TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^a-z0-9_ß]+'), lambda w: length(w) >= {})"


def any_of(*endings: str) -> str:
    return "|".join(endings)


def region(pattern: str) -> str:
    return f"coalesce(nullif(length(regexp_extract(w, '^(?:{pattern})')), 0), length(w))"


def shorter(base: str, endings: tuple[str, ...], mark: str) -> str:
    """base without the ending, where that begins at the mark or behind it."""
    tail = f"regexp_extract({base}, '(?:{any_of(*endings)})$')"
    return f"CASE WHEN {tail} <> '' AND length({base}) - length({tail}) >= {mark} THEN left({base}, length({base}) - length({tail})) ELSE {base} END"


def stems(words: str) -> str:
    """The table stems (w, lexeme) of a query that gives words (w)."""
    step, before, pronouns = "[^aeiou]*[aeiou]+[^aeiou]", any_of(*S.BEFORE_PRONOUNS), any_of(*S.PRONOUNS)
    standard = any_of(*S.PLAIN, *S.AGENT, *S.ABSTRACT, *S.ACTIVE, "amente", "mente", "ucion", "uciones", "encia", "encias")
    among = lambda endings: "(" + ", ".join(f"'{e}'" for e in endings) + ")"
    rv = ".[^aeiou][^aeiou]*[aeiou]|[aeiou][aeiou]+[^aeiou]|[^aeiou][aeiou]."
    return f"""
        k0 AS (SELECT w, {region(step)} AS r1, {region(step + step)} AS r2, {region(rv)} AS rv FROM (SELECT DISTINCT w FROM ({words}) WHERE w NOT IN {among(S.STOP_WORDS)})),
        k1 AS (SELECT *, regexp_extract(w, '(?:{before})(?:{pronouns})$') AS e, regexp_extract(w, 'uyendo(?:{pronouns})$') AS u FROM k0),
        k2 AS (SELECT w, r1, r2, rv, CASE WHEN e <> '' AND length(w) - length(e) >= rv OR u <> '' AND length(w) - length(u) + 1 >= rv
               THEN regexp_replace(w, '({before}|yendo)(?:{pronouns})$', '\\1') ELSE w END AS s FROM k1),
        k3 AS (SELECT *, regexp_extract(s, '(?:{standard})$') AS e, left(s, length(s) - length(e)) AS b FROM k2),
        k4 AS (SELECT w, r1, r2, rv, e <> '' AND length(b) >= CASE e WHEN 'amente' THEN r1 ELSE r2 END AS done, s, CASE
               WHEN e IN {among(S.AGENT)} THEN {shorter('b', ('ic',), 'r2')}
               WHEN e IN ('ucion', 'uciones') THEN b || 'u' WHEN e IN ('encia', 'encias') THEN b || 'ente'
               WHEN e = 'amente' AND ends_with(b, 'ativ') AND length(b) - 4 >= r2 THEN left(b, length(b) - 4)
               WHEN e = 'amente' THEN {shorter('b', ('iv', 'os', 'ic', 'ad'), 'r2')}
               WHEN e = 'mente' THEN {shorter('b', ('ante', 'able', 'ible'), 'r2')}
               WHEN e IN {among(S.ABSTRACT)} THEN {shorter('b', ('abil', 'ic', 'iv'), 'r2')}
               WHEN e IN {among(S.ACTIVE)} THEN {shorter('b', ('at',), 'r2')} ELSE b END AS t FROM k3),
        k5 AS (SELECT w, rv, done, CASE WHEN done THEN t ELSE s END AS s FROM k4),
        k6 AS (SELECT *, left(s, length(s) - length(e)) AS b FROM (SELECT *, regexp_extract(substr(s, rv + 1), '(?:{any_of(*S.Y_VERBS)})$') AS e FROM k5)),
        k7 AS (SELECT w, rv, done OR e <> '' AND ends_with(b, 'u') AS done, CASE WHEN NOT done AND e <> '' AND ends_with(b, 'u') THEN b ELSE s END AS s FROM k6),
        k8 AS (SELECT *, left(s, length(s) - length(e)) AS b FROM (SELECT *, regexp_extract(substr(s, rv + 1), '(?:{any_of(*S.VERBS, *S.GU_VERBS)})$') AS e FROM k7)),
        k9 AS (SELECT w, rv, CASE WHEN done OR e = '' THEN s WHEN e IN {among(S.GU_VERBS)} AND ends_with(b, 'gu') THEN left(b, length(b) - 1) ELSE b END AS s FROM k8),
        k10 AS (SELECT *, regexp_extract(s, '(?:os|a|o|e)$') AS e, left(s, length(s) - length(e)) AS b FROM k9),
        stems AS MATERIALIZED (SELECT w, CASE WHEN NOT regexp_matches(w, '^[a-z]+$') THEN w WHEN e = '' OR length(b) < rv THEN s
               WHEN e = 'e' AND ends_with(b, 'gu') AND length(b) - 1 >= rv THEN left(b, length(b) - 1) ELSE b END AS lexeme FROM k10)"""


def placed(table: str, key: str, text: str = "text") -> str:
    return f"SELECT {key}, unnest(ws) AS w, least(generate_subscripts(ws, 1), {LAST}) AS pos FROM (SELECT {key}, {TOKENS.format(text, 1)} AS ws FROM {table})"


POST = f"""doc_words AS MATERIALIZED ({placed('documents', 'doc_id')}), item_words AS MATERIALIZED ({placed('benchmark', 'item_id')}),
       {stems('SELECT w FROM doc_words UNION ALL SELECT w FROM item_words')},
       post AS MATERIALIZED (SELECT doc_id, lexeme, least({MOST}, count(DISTINCT pos)) AS n, min(pos) AS first FROM doc_words JOIN stems USING (w) GROUP BY 1, 2)"""
ASK = "ask AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, lexeme FROM item_words JOIN stems USING (w))"
HITS = "hits AS (SELECT query_id, doc_id, sum(n) AS h, min(first) AS first FROM post JOIN ask USING (lexeme) GROUP BY 1, 2)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS rank FROM hits)"
