"""The lexical channel: published stems, positions, cover density, areas, bounded candidates."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import stemming as S
from palimpsest.functions.stemming import STOP_WORDS, stemmed
from palimpsest.operators import lexical as L
from palimpsest.operators import retrieval as R

#: Words and stems from the published description of the Spanish stemmer, folded.
PUBLISHED = (
    "cheque chequ", "chequeo cheque", "cheques chequ", "cheraw cheraw", "chetumal chetumal", "cheyene cheyen", "chica chic", "chicago chicag", "chicana chican",
    "chicharrones chicharron", "chichimecas chichimec", "chicles chicl", "torax torax", "torcer torc", "toreado tor", "torear tor", "toreara tor", "torearlo tor",
    "torero torer", "tormentas torment", "tornados torn", "tornen torn", "torneo torne", "tornillos tornill", "torpedearon torped", "torpeza torpez",
    "torrenciales torrencial", "torreon torreon", "torrescano torrescan",
)
#: One word for each step.
STEPS = (
    "obligaciones oblig", "rapidamente rapid", "activamente activ", "contribuyendo contribu", "paguen pag", "pague pag", "posibilidad posibil", "instituciones institu",
    "referencia referent", "contribuyendolo contribu", "venderselo vend", "a1b2es a1b2es", "año_x año_x",
)


def test_stems_are_the_published_ones(spark):
    pairs = [tuple(p.split()) for p in PUBLISHED + STEPS]
    got = {r["word"]: r["lexeme"] for r in stemmed(spark.createDataFrame([(w,) for w, _ in pairs], "word string")).collect()}
    assert got == dict(pairs)


def test_stop_words_are_folded_and_distinct():
    assert len(set(STOP_WORDS)) == len(STOP_WORDS) and all(w.isascii() and w.isalpha() for w in STOP_WORDS)
    assert {"estuvieran", "hubimos", "fueses", "tenidas", "nuestros", "habiendo", "tuviste"} <= set(STOP_WORDS)


def index(spark, texts, questions, places=False):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asks = spark.createDataFrame(list(enumerate(questions)), "item_id long, text string")
    known = L.vocabulary((docs, F.col("text")), (asks, F.col("text")), stop_words=("de", "la"))
    asked = L.lexemes(asks, "item_id", F.col("text"), known)
    return L.postings(docs, "doc_id", F.col("text"), known, asked, places), asked


def test_positions_count_stop_words_and_are_bounded(spark):
    texts = ["casa de la venta, casas", "venta " * 300, "x " * 16_500 + "venta venta", None, "", "de la"]
    post, _ = index(spark, texts, ["casa venta x"], places=True)
    got = {(r["doc_id"], r["lexeme"]): (r["n"], r["first"], list(r["places"])) for r in post.collect()}
    assert got[0, "cas"] == (2, 1, [1, 5]) and got[0, "vent"] == (1, 4, [4])
    assert got[1, "vent"] == (255, 1, list(range(1, 256)))
    assert got[2, "vent"] == (1, L.LAST, [L.LAST]) and got[2, "x"][:2] == (255, 1)
    assert {d for d, _ in got} == {0, 1, 2}
    plain, _ = index(spark, texts, ["casa venta x"])
    assert {(r["doc_id"], r["lexeme"]): (r["n"], r["first"]) for r in plain.collect()} == {k: v[:2] for k, v in got.items()}


def density_plainly(places: dict[str, list[int]], wanted: list[str]) -> float | None:
    """Least covers by trying all runs."""
    hits = sorted((p, w) for w in wanted for p in places.get(w, []))
    if any(w not in places for w in wanted):
        return None
    whole = [(i, j) for i, j in product(range(len(hits)), repeat=2) if i <= j and {w for _, w in hits[i : j + 1]} == set(wanted)]
    least = [(i, j) for i, j in whole if not any((a, b) != (i, j) and i <= a and b <= j for a, b in whole)]
    return round(sum(0.1 / (1 + (hits[j][0] - hits[i][0]) - (j - i)) for i, j in least), 6)


@pytest.mark.parametrize("seed", range(3))
def test_cover_density_equals_all_runs_tried(spark, seed):
    r = random.Random(seed)
    words = ["sol", "mar", "luz", "pan", "xyz", "de", "rey"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 25))) for _ in range(40)]
    questions = ["sol mar", "sol mar luz", "pan", "sol mar luz pan rey", "de", "mar de"]
    post, asked = index(spark, texts, questions, places=True)
    got = {(x["query_id"], x["doc_id"]): x["score"] for x in L.all_of(post, asked).collect()}
    want = {}
    for q, question in enumerate(questions):
        wanted = [w for w in question.split() if w != "de"]
        for d, text in enumerate(texts):
            places = defaultdict(list)
            for at, w in enumerate(text.split(), 1):
                places[w].append(at)
            if wanted and (rank := density_plainly(places, wanted)) is not None:
                want[q, d] = rank
    assert got == want


def test_any_word_ranks_by_positions(spark):
    post, asked = index(spark, ["sol mar sol", "mar", "luz", "soles"], ["sol mar", "nada"])
    got = [tuple(r)[:2] + (r["score"], r["total"]) for r in L.search(post, asked, 2, with_total=True).orderBy("rank").collect()]
    assert got == [(0, 0, 0.3, 3), (0, 1, 0.1, 3)]  # of documents 1 and 3 that with the smaller id


def skewed(spark, seed=0):
    """A word that nearly all documents have, mostly once, and rare words."""
    r = random.Random(seed)
    texts = [" ".join(["comun"] * (1 if r.random() < 0.95 else r.randint(2, 40)) + [f"raro{r.randint(0, 60)}"] * r.randint(0, 3)) for _ in range(1500)]
    questions = [f"comun raro{i} raro{i + 1}" for i in range(30)] + ["comun", "raro3", "nada"]
    post, asked = index(spark, texts, questions)
    return post.cache(), asked.cache()


def test_bounded_search_gives_the_same_rows_from_fewer_postings(spark):
    post, asked = skewed(spark)
    for limit in (1, 5, 20):
        full = Counter(map(tuple, L.search(post, asked, limit).collect()))
        assert Counter(map(tuple, L.bounded_search(post, asked, limit).collect())) == full
    cuts = L.floors(post, asked, 5)
    above = L.met(post, cuts).where("n > cut").count()
    found = L.candidates(post, cuts)
    lookups = found.join(asked, "query_id").join(post, ["doc_id", "lexeme"]).count()
    assert above + lookups < 0.5 * L.met(post, asked).count()


def test_a_hot_lexeme_is_dealt_over_tasks(spark):
    post, asked = skewed(spark, 1)
    dealt = L.met(post, asked, most=1)
    assert Counter(map(tuple, dealt.select("doc_id", "lexeme", "n", "query_id").collect())) == Counter(map(tuple, L.met(post, asked).select("doc_id", "lexeme", "n", "query_id").collect()))
    salts = post.where("lexeme = 'comun'").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(L.SALTS))).count().agg(F.max("count")).first()[0]
    assert salts <= 1500 / L.SALTS * 2


def test_areas_filter_ranks_and_totals(spark):
    post, asked = index(spark, ["sol sol", "sol", "sol sol sol"], ["sol", "soles", "sol"])
    areas = spark.createDataFrame([(0, "a"), (1, None), (2, "none")], "query_id long, area string")
    docs = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "doc_id long, area string")
    got = [(r["query_id"], r["doc_id"], r["total"]) for r in L.ranked(L.in_area(L.matches(post, asked), areas, docs), 5, True).orderBy("query_id", "rank").collect()]
    assert got == [(0, 0, 2), (0, 1, 2), (1, 2, 3), (1, 0, 3), (1, 1, 3)]


def test_snippets_begin_at_the_first_hit(spark):
    text = "Uno, dos;  tres-cuatro " + " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1,), (4,), (5,), (64,)], "first int")
    got = [r[0] for r in df.select(R.snippet(F.lit(text), F.col("first"), 3, 2)).collect()]
    assert got == ["Uno, dos; tres-cuatro", "tres-cuatro w0 w1", "w0 w1 w2", "w58 w59"]


def test_matches_are_dealt_by_document(spark, monkeypatch):
    """What postings make of many questions is grouped where it is made, by as many tasks as it needs, with the same rows."""
    rng = random.Random(3)
    post = spark.createDataFrame(list({(d, f"l{k}"): (d, f"l{k}", rng.randint(1, 9), rng.randint(1, 99)) for d in range(60) for k in rng.sample(range(12), 5)}.values()), "doc_id long, lexeme string, n long, first int")
    asked = spark.createDataFrame([(q, f"l{k}") for q in range(20) for k in rng.sample(range(12), 3)], "query_id long, lexeme string")
    want = sorted(map(tuple, post.join(asked, "lexeme").groupBy("query_id", "doc_id").agg(F.sum("n"), F.min("first")).collect()))
    pairs = post.join(asked, "lexeme").count()
    for sent in (L.sent, lambda df, most=0: df):
        monkeypatch.setattr(L, "sent", sent)
        monkeypatch.setattr(L, "PAIRS", 1_000_000)
        assert sorted(map(tuple, L.matches(post, asked).collect())) == want
        monkeypatch.setattr(L, "PAIRS", 100)
        got = L.matches(post, asked)
        assert sorted(map(tuple, got.collect())) == want
        plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
        assert f", {-(-pairs // 100)})" in plan.replace(", REPARTITION_BY_NUM", ")") and "hashpartitioning(query_id" not in plan


def test_counted_words(spark, monkeypatch):
    """Words counted where texts are read are those of placed_words(), and no task groups more of them than it should."""
    odd = [
        (1, None), (2, ""), (3, "Él está àÀÉ ñandú STRASSE straße ẞ İstanbul ̀ àb x́̂ cão K Å ΑΣ n a_b 0x1F ý “b”–b"), (4, "a " * 17000 + "b b c"),
        (5, "̀ ́ uno"), (6, "x" * 16382 + " y"), (7, " ".join(f"w{i % 50}" for i in range(16390))), (None, "nada aquí"), (8, "ß1 ő ű Ğ ŵ Ŵ ŀ œ ø ł đ"), (9, "casas casa casita"),
    ]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    placed, counted = L.placed_words(df, "doc_id", F.col("text")), L.counted_words(df, "doc_id", F.col("text"))
    plain = placed.groupBy("doc_id", "word").agg(F.count_if(F.col("pos") < L.LAST).cast("int"), F.max(F.col("pos") == L.LAST), F.min("pos"))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, counted.collect()), key=repr)
    known = L.vocabulary_of(counted)
    monkeypatch.setattr(L, "WORDS", 20)
    post = L.postings_of_counted(counted, known)
    assert sorted(map(tuple, post.collect()), key=repr) == sorted(map(tuple, L.postings_of(placed, known).collect()), key=repr)
    assert post.rdd.getNumPartitions() == -(-counted.count() // 20)


def test_like_asked(spark):
    """No word with an asked stem is left out before the words are stemmed."""
    words = spark.createDataFrame([(f"{a}{b}{c}",) for a in ("", "a", "ag", "cre", "paci", "distrib") for b in ("", *S.PLAIN[:4], *S.AGENT[:3], "ucion", "encia", "amente", "gu", "iva") for c in ("", *S.VERBS[::9], *S.Y_VERBS[:3], *S.GU_VERBS, *S.PRONOUNS[::3], "os") if a + b + c], "word string").distinct()
    stems = S.stemmed(words).localCheckpoint()
    for asked in (stems, stems.where(F.crc32("lexeme") % 5 == 0)):
        left = L.told_by(L.vocabulary_of(L.like_asked(words, asked)), asked).collect()
        assert sorted(map(tuple, left)) == sorted(map(tuple, L.told_by(L.vocabulary_of(words), asked).collect()))


def test_words_are_their_stems_and_endings(spark):
    """Every word is kept beside its own stem, and next to none that merely begins like a short one."""
    heads, mids, tails = ("", "a", "ag", "cre", "aba", "segu", "constru"), ("", *S.WITHIN, "gu", "os"), ("", *S.PRONOUNS, "os", "a", "ue")
    words = spark.createDataFrame([(w,) for w in {a + b + c + d for a in heads for b in mids for c in ("", *S.ENDINGS, "ucion", "uciones", "encia", "encias", "uyendo") for d in tails} if w], "word string")
    stems = S.stemmed(words).where(F.crc32("word") % 4 == 0).localCheckpoint()
    root = F.regexp_replace("lexeme", "(?<=en)te?$", "")
    rest = F.substring(F.col("word"), F.length(root) + 1, F.length("word"))
    assert stems.where(~(F.startswith(F.col("word"), root) & F.rlike(rest, F.lit(S.BEHIND)))).isEmpty()
    r = random.Random(5)
    strangers = [("of" + "".join(r.choice("bcdfghklmprt") for _ in range(r.randint(4, 9))),) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(w for (w,) in strangers[i::10]) + " of ofes ofado agencia agencias") for i in range(10)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "of"), (0, "agent")], "query_id long, lexeme string")
    left = L.like_asked(L.seen_words(docs, F.col("text")), asked).distinct().count()
    assert left <= 10
    got = {tuple(x) for x in L.asked_words(docs, F.col("text"), asked).select("word", "lexeme").collect()}
    assert got == {tuple(x) for x in L.told_by(L.vocabulary_of(L.seen_words(docs, F.col("text"))), asked).select("word", "lexeme").collect()} and ("of", "of") in got


def lists(spark, seed=4, key=int):
    """Documents with areas, questions with areas (one has none, one isn't there), and what is known of their words."""
    r = random.Random(seed)
    words = ["casa", "casas", "ventas", "niño", "NIÑO", "nin\u0303o", "straße", "x1", "de", "“luz”", "mar–sol", "soles"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(120)] + ["casa " * 400, "", None, "a " * 17_000 + "casa casas", "nada"]
    docs = spark.createDataFrame([(key(i), x, r.choice(["a", "b", None])) for i, x in enumerate(texts)], f"doc_id {'long' if key is int else 'string'}, text string, area string")
    asks = spark.createDataFrame([(i, " ".join(r.sample(words, 3))) for i in range(12)], "item_id long, text string")
    areas = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else None) for i in range(11)] + [(99, "a")], "query_id long, area string")
    known = L.vocabulary((docs, F.col("text")), (asks, F.col("text")), stop_words=("de",)).localCheckpoint()
    asked = L.lexemes(asks, "item_id", F.col("text"), known).localCheckpoint()
    return docs, areas, L.told_by(known, asked).localCheckpoint(), asked


@pytest.mark.parametrize("most", (L.SENT, 1))
def test_postings_of_a_document_are_one_row(spark, most):
    """Made where the text is read, with no shuffle; where too many words are known, or ids repeat, by Spark."""
    docs, _, known, asked = lists(spark)
    want = sorted(map(tuple, L.postings(docs, "doc_id", F.col("text"), known, asked).collect()))
    got = L.held(docs, "doc_id", F.col("text"), known, "area", most=most)
    assert sorted(map(tuple, L.posted(got).collect())) == want
    assert got.select("doc_id").distinct().count() == got.count()
    assert {tuple(x) for x in got.select("doc_id", "area").collect()} <= {tuple(x) for x in docs.select("doc_id", "area").collect()}
    assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (most == 1)
    twice = docs.withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    plain = L.postings(twice.withColumn("doc_id", F.col("doc_id")), "doc_id", F.col("text"), known, asked)
    assert {x[:2] for x in map(tuple, L.posted(L.held(twice, "doc_id", F.col("text"), known, most=most)).collect())} == {x[:2] for x in map(tuple, plain.collect())}
    assert sorted(x["word"] for x in L.seen_words(docs, F.col("text")).distinct().collect()) == sorted(x["word"] for x in L.placed_words(docs, "doc_id", F.col("text")).select("word").distinct().collect())


@pytest.mark.parametrize("key", (int, lambda i: f"d{i}"))
@pytest.mark.parametrize("most", (L.SENT, 1))
def test_best_matches_rank_as_all_matches(spark, monkeypatch, key, most):
    """Ranks, places and totals are those of all matches, of which a task tells a question's first alone."""
    docs, areas, known, asked = lists(spark, key=key)
    held = L.held(docs, "doc_id", F.col("text"), known, "area").localCheckpoint()
    found = L.matches(L.posted(held), asked).localCheckpoint()
    for pairs in (1_000_000, 300):
        monkeypatch.setattr(L, "PAIRS", pairs)
        for limit in (1, 4, 200):
            for given in (None, areas):
                every = found if given is None else L.in_area(found, given, docs)
                want = sorted(map(tuple, L.ranked(every, limit, True).collect()))
                best = L.best_matches(held, asked, limit, given, most=most)
                assert want and sorted(map(tuple, L.ranked(best, limit, True).select("query_id", "doc_id", "first", "score", "rank", "total").collect())) == want
    told = L.best_matches(held, asked, 2, most=most)
    if most > 1:
        parts = held.rdd.getNumPartitions() + found.join(L.posted(held).select("doc_id").distinct(), "doc_id").count() * 3 // 300 + 1
        assert told.count() <= 2 * 12 * parts < found.count() and "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    assert not L.best_matches(held, asked.where("lexeme = 'none'"), 2).count()
