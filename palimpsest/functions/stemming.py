"""The published Snowball stemmer for Spanish and its stop words, over folded words, as Columns: nothing leaves the JVM.

Words are folded before they are stemmed, as the text-search configuration does, so endings and stop words with accents
cannot occur and are left out here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published endings, each list in the order of its step.
PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
BEFORE_PRONOUNS = ("ando", "iendo", "ar", "er", "ir")
PLAIN = (
    "anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas",
    "amiento", "amientos", "imiento", "imientos",
)
AGENT = ("adora", "ador", "acion", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
ABSTRACT = ("idad", "idades")
ACTIVE = ("iva", "ivo", "ivas", "ivos")
Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yas", "yes", "yais", "yamos")
GU_VERBS = ("en", "es", "emos")
VERBS = (
    "aremos", "eremos", "iremos", "aba", "ada", "ida", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "aran", "ieran", "asen", "iesen",
    "aron", "ieron", "ado", "ido", "ando", "iendo", "ar", "er", "ir", "as", "abas", "adas", "idas", "aras", "ieras", "ases", "ieses", "ais", "abais", "arais", "ierais",
    "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "imos",
)
#: What a word may have behind its stem, or behind what is left of it: the end of an "ente" that stands for "encia", a vowel,
#: an ending within the ending (or a silent u), the ending, a pronoun.
ENDINGS = PLAIN + AGENT + ABSTRACT + ACTIVE + ("amente", "mente", "cion", "ciones", "cia", "cias") + Y_VERBS + GU_VERBS + VERBS
WITHIN = ("ic", "ativ", "iv", "os", "ad", "ante", "able", "ible", "abil", "at")
BEHIND = "^(?:te?)?(?:ue|os|a|o|e)?u?" + "".join(f"(?:{'|'.join(x)})?" for x in (WITHIN, ENDINGS, PRONOUNS)) + "$"

# The published stop words without accents.
PARTICLES = (
    "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como", "pero", "sus", "le", "ya", "o",
    "este", "porque", "esta", "entre", "cuando", "muy", "sin", "sobre", "me", "hasta", "hay", "donde", "quien", "desde", "todo", "nos", "durante", "todos", "uno", "les",
    "ni", "contra", "otros", "ese", "eso", "ante", "ellos", "e", "esto", "antes", "algunos", "unos", "yo", "otro", "otras", "otra", "tanto", "esa", "estos", "mucho",
    "quienes", "nada", "muchos", "cual", "poco", "ella", "estar", "estas", "algunas", "algo", "nosotros", "mi", "mis", "tu", "te", "ti", "tus", "ellas", "nosotras",
    "vosotros", "vosotras", "os", "esos", "esas",
)
#: Of estar, haber, ser and tener what no rule gives.
IRREGULAR = (
    "estoy", "estamos", "estemos", "estaremos", "estad", "he", "has", "ha", "hemos", "han", "haya", "hayas", "hayamos", "hayan", "habremos",
    "soy", "eres", "es", "somos", "sois", "son", "sea", "seas", "seamos", "sean", "seremos", "era", "eras", "erais", "eran", "siendo", "sido", "fui", "fue",
    "tengo", "tienes", "tiene", "tenemos", "tienen", "tenga", "tengas", "tengamos", "tengan", "tendremos", "tened", "estuve", "estuvo", "hube", "hubo", "tuve", "tuvo",
)
PAST = {"estuv": "ie", "hub": "ie", "fu": "e", "tuv": "ie"}


def stop_words() -> tuple[str, ...]:
    owners = [f"{stem}{end}" for stem in ("tuy", "suy", "nuestr", "vuestr") for end in ("o", "a", "os", "as")]
    imperfect = [f"estaba{end}" for end in ("", "s", "is", "n")]
    participles = [f"{stem}{end}" for stem, gerund in (("esta", ""), ("habi", "e"), ("teni", "e")) for end in (f"{gerund}ndo", "do", "da", "dos", "das")]
    past = [f"{stem}{end}" for stem in PAST for end in ("iste", "imos", "isteis")]
    past += [f"{stem}{mid}{end}" for stem, mid in PAST.items() for end in ("ron", *(f"{x}{person}" for x in ("ra", "se") for person in ("", "s", "is", "n")))]
    return (*PARTICLES, *IRREGULAR, *owners, *imperfect, *participles, *past)


STOP_WORDS = stop_words()


def ending(word: Column, endings: tuple[str, ...]) -> Column:
    """The longest of the endings that a word has, else an empty text."""
    return F.regexp_extract(word, f"({'|'.join(endings)})$", 1)


def without(word: Column, tail: Column | int) -> Column:
    """A word without as many letters at its end."""
    return F.substring(word, F.lit(1), F.length(word) - tail)


def cut(word: Column, endings: tuple[str, ...], region: Column) -> Column:
    """A word without the longest of the endings, if that lies in the region (which begins behind so many letters)."""
    tail = F.length(ending(word, endings))
    return F.when((tail > 0) & (F.length(word) - tail >= region), without(word, tail)).otherwise(word)


def stemmed(words: DataFrame, word: str = "word", out: str = "lexeme") -> DataFrame:
    """words with the stem of the folded word in each row; words with digits or other signs are their own stem. Meant for
    distinct words: each step is a projection of its own, so nothing is evaluated twice."""
    w, r1, r2, rv = F.col(word), F.col("__r1"), F.col("__r2"), F.col("__rv")
    s, tail, base = F.col("__s"), F.col("__tail"), F.col("__base")
    step = "[^aeiou]*[aeiou]+[^aeiou]"

    def region(pattern: str) -> Column:
        begins = F.length(F.regexp_extract(w, f"^(?:{pattern})", 0))
        return F.when(begins > 0, begins).otherwise(F.length(w))

    df = words.withColumns({"__r1": region(step), "__r2": region(step * 2), "__rv": region(".[^aeiou][^aeiou]*[aeiou]|[aeiou]{2}[aeiou]*[^aeiou]|[^aeiou][aeiou]."), "__s": w})

    # An attached pronoun behind an infinitive or a gerund.
    pronoun = F.regexp_extract("__s", f"(?:{'|'.join(BEFORE_PRONOUNS)}|yendo)({'|'.join(PRONOUNS)})$", 1)
    verb = F.regexp_extract("__s", f"((?:{'|'.join(BEFORE_PRONOUNS)}|uyendo)(?:{'|'.join(PRONOUNS)}))$", 1)
    begins = F.length(s) - F.length("__verb") + F.startswith(F.col("__verb"), F.lit("u")).cast("int")
    df = df.withColumns({"__tail": pronoun, "__verb": verb})
    df = df.withColumn("__s", F.when((F.length("__verb") > 0) & (begins >= rv), without(s, F.length(tail))).otherwise(s))

    # Standard endings; what they leave may end once more.
    others = ("amente", "mente", "ucion", "uciones", "encia", "encias")
    df = df.withColumn("__tail", ending(s, PLAIN + AGENT + others + ABSTRACT + ACTIVE)).withColumn("__base", without(s, F.length(tail)))
    there = F.when(tail == "", False).when(tail == "amente", F.length(base) >= r1).otherwise(F.length(base) >= r2)
    left = (
        F.when(tail.isin(*AGENT), cut(base, ("ic",), r2))
        .when(tail.isin("ucion", "uciones"), F.concat(base, F.lit("u")))
        .when(tail.isin("encia", "encias"), F.concat(base, F.lit("ente")))
        .when((tail == "amente") & F.endswith(base, F.lit("ativ")) & (F.length(base) - 4 >= r2), without(base, 4))
        .when(tail == "amente", cut(base, ("iv", "os", "ic", "ad"), r2))
        .when(tail == "mente", cut(base, ("ante", "able", "ible"), r2))
        .when(tail.isin(*ABSTRACT), cut(base, ("abil", "ic", "iv"), r2))
        .when(tail.isin(*ACTIVE), cut(base, ("at",), r2))
        .otherwise(base)
    )
    df = df.withColumn("__done", there).withColumn("__s", F.when(F.col("__done"), left).otherwise(s))

    # Verb endings within the verb's region.
    in_verb = lambda endings: ending(F.substring(s, rv + 1, F.length(s)), endings)
    df = df.withColumn("__tail", in_verb(Y_VERBS)).withColumn("__base", without(s, F.length(tail)))
    y = ~F.col("__done") & (tail != "") & F.endswith(base, F.lit("u"))
    df = df.withColumn("__s", F.when(y, base).otherwise(s)).withColumn("__done", F.col("__done") | y)
    df = df.withColumn("__tail", in_verb(VERBS + GU_VERBS)).withColumn("__base", without(s, F.length(tail)))
    after_gu = tail.isin(*GU_VERBS) & F.endswith(base, F.lit("gu"))
    df = df.withColumn("__s", F.when(F.col("__done") | (tail == ""), s).when(after_gu, without(base, 1)).otherwise(base))

    # The vowel that is left.
    df = df.withColumn("__tail", ending(s, ("os", "a", "o", "e"))).withColumn("__base", without(s, F.length(tail)))
    last = F.when((tail == "") | (F.length(base) < rv), s).when((tail == "e") & F.endswith(base, F.lit("gu")) & (F.length(base) - 1 >= rv), without(base, 1)).otherwise(base)
    df = df.withColumn(out, F.when(F.rlike(w, F.lit("^[a-z]+$")), last).otherwise(w))
    # Behind explode, so that no filter on the stem is pushed through the steps, which would write each into the next.
    return df.select(*words.columns, F.explode(F.array(F.col(out))).alias(out))
