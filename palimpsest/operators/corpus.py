"""Corpus upkeep: range maps, version chains, sources of articles and their parsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.dictionaries import ARTICLE_AREAS


def bucket(c: Column, ranges: tuple = ARTICLE_AREAS) -> Column:
    """The name of the closed range that holds a number; null between ranges."""
    out = F.lit(None).cast("string")
    for low, high, name in ranges:
        out = F.when(c.between(low, high), name).otherwise(out)
    return out


def chains(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (root, id, version) of all descendants of roots, breadth first. links: (id, parent), without cycles.

    One join a generation; it ends with the first empty one.
    """
    front = roots.select(F.col("id").alias("root"), "id", F.lit(1).alias("version"))
    out = front
    while True:
        parents = front.select("root", F.col("id").alias("parent"), "version")
        front = links.join(parents, "parent").select("root", "id", (F.col("version") + 1).alias("version"))
        if front.isEmpty():
            return out
        out = out.unionByName(front)


@dataclass(frozen=True)
class Profile:
    """What differs between sources of articles. noise: lines to drop; article: a header with the article's number as its
    group; level: a heading with its kind and number as groups; expected: how many articles there have to be."""

    name: str
    expected: int
    noise: str
    article: str
    level: str


LEVELS = ("LIBRO", "PARTE", "TITULO", "CAPITULO", "SECCION")

#: Sources and their patterns.
PROFILES = {
    "codigo_civil": Profile(
        "Codigo Civil", 1570, r"^(?:CODIGO CIVIL - .*InfoLeyes.*|http://bolivia\.infoleyes\.com/.*|CODIGO CIVIL)$",
        r"^ART[IÍ]CULO\s+(\d+)\s*[.\-]", r"^(LIBRO|PARTE|TITULO|CAPITULO|SECCION|SUBSECCION)\s+(\S+)\s*$",
    ),
}
NOT_A_NAME = r"^(?:[IVX]+\.|\()"
HEADING = r"^\s*\(?\s*([^)\n]{0,120}(?:\n[^)\n]{0,120}){0,3})\s*\)\s*[.\-]{0,2}"


def lines_of(texts: DataFrame, key: str, text: str, noise: str) -> DataFrame:
    """Rows (key, n, line) without the lines of page headers, which a source repeats on every page."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(~F.rlike("line", F.lit(noise)))


def parsed_articles(texts: DataFrame, profile: Profile, key: str = "source", text: str = "text") -> DataFrame:
    """Rows (key, number, heading, body, libro, parte, titulo, capitulo, seccion) of the articles in texts.

    A level's name is the run of capital lines below it. A level ends the levels under it; subsections are dropped. An
    article has the levels that hold where it begins. Windows run within one source text, whatever their number.
    """
    trimmed = F.trim(F.col("line"))
    capital = (F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line"))
    lines = lines_of(texts, key, text, profile.noise)
    level, article = F.rlike("line", F.lit(profile.level)), F.rlike("line", F.lit(profile.article))
    kind = F.when(level, "level").when(article, "article").when(capital & (trimmed != "") & ~F.rlike(trimmed, F.lit(NOT_A_NAME)), "name").otherwise("text")
    known = lines.select(key, "n", "line", kind.alias("kind"))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # The last line that is no name: a name belongs to a level if that line is one.
    owner = F.last(F.when(F.col("kind") != "name", F.struct("kind", "n")), ignorenulls=True).over(upto)
    known = known.withColumn("owner", owner)
    is_name = (F.col("kind") == "name") & (F.col("owner.kind") == "level")
    names = known.where(is_name).groupBy(key, F.col("owner.n").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("x")))), lambda x: x["x"]), " ").alias("name"))
    rest = known.where(~is_name).join(names, [key, "n"], "left")
    which, number = F.regexp_extract("line", profile.level, 1), F.regexp_extract("line", profile.level, 2)
    title = F.concat_ws(" ", which, number, F.when(F.coalesce("name", F.lit("")) != "", F.col("name")))
    for name in LEVELS:
        at = F.last(F.when((F.col("kind") == "level") & (which == name), F.struct(F.col("n").alias("n"), title.alias("title"))), ignorenulls=True).over(upto)
        rest = rest.withColumn(name.lower(), at)
    rest = rest.withColumn("article", F.sum(F.when(F.col("kind") == "article", 1).otherwise(0)).over(upto)).where("article > 0 and kind <> 'level'")
    line = F.when(F.col("kind") == "article", F.regexp_replace("line", profile.article, "")).otherwise(F.col("line"))
    line = F.when((F.col("kind") == "article") & (line == ""), F.lit(None)).otherwise(line)
    body = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("n", line.alias("x")))), lambda x: x["x"].isNotNull()), lambda x: x["x"]), "\n")
    head = F.min(F.when(F.col("kind") == "article", F.struct("n", F.regexp_extract("line", profile.article, 1).cast("int").alias("number"), *(x.lower() for x in LEVELS))))
    grouped = rest.groupBy(key, "article").agg(head.alias("h"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("raw"))
    kept, higher = [], F.lit(-1)
    for name in map(str.lower, LEVELS):  # a level holds if no higher one has begun since
        at = F.coalesce(F.col(f"h.{name}.n"), F.lit(-1))
        kept.append(F.when(at > higher, F.col(f"h.{name}.title")).alias(name))
        higher = F.greatest(higher, at)
    heading, text_of = heading_split(F.col("raw"))
    return grouped.select(key, F.col("h.number").alias("number"), heading.alias("heading"), text_of.alias("body"), *kept)


def sequence_faults(articles: DataFrame, expected: int, key: str = "source", number: str = "number") -> DataFrame:
    """Rows (key, fault, low, high) where a source's articles aren't those from 1 to expected, each once: runs of numbers that
    are missing, repeated numbers, and numbers beyond. A source without any article has no row; rows without a key
    or a number take no part.

    Each number looks at the one before it in its source, a sort without anything held, and says what lies between.
    """
    each = articles.where(F.col(key).isNotNull() & F.col(number).isNotNull()).groupBy(key, F.col(number).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("times"))
    inside = (F.col("n") >= 1) & (F.col("n") <= expected)
    own = Window.partitionBy(key).orderBy("n")
    around = each.select(key, "n", "times", inside.alias("inside"), F.lag("n").over(own).alias("before"), F.lead("n").over(own).alias("after"))
    fault = lambda cond, name, low, high: F.when(cond, F.struct(F.lit(name).alias("fault"), low.cast("long").alias("low"), high.cast("long").alias("high")))
    before = F.greatest(F.coalesce("before", F.lit(0)), F.lit(0))  # of numbers below 1 none are between
    upto = F.least(F.col("n") - 1, F.lit(expected))
    last = F.greatest(F.col("n"), F.lit(0))
    found = F.array(
        fault((upto > before), "missing", before + 1, upto),
        fault(F.col("after").isNull() & (last < expected), "missing", last + 1, F.lit(expected)),
        fault(F.col("times") > 1, "repeated", F.col("n"), F.col("n")),
        fault(~F.col("inside"), "beyond", F.col("n"), F.col("n")),
    )
    return around.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def whole_sources(articles: DataFrame, profile: Profile, key: str = "source", number: str = "number") -> DataFrame:
    """The articles of those sources that have all that the profile expects, each once, and no other: nothing of a source that
    was read in part is stored. Rows without a key or a number go."""
    faulty = sequence_faults(articles, profile.expected, key, number).select(key).distinct()
    return articles.where(F.col(key).isNotNull() & F.col(number).isNotNull()).join(faulty, key, "left_anti")


def heading_split(raw: Column) -> tuple[Column, Column]:
    """An article's heading, in brackets over four lines at most, and what follows it; (null, raw) without one."""
    there = F.rlike(raw, F.lit(HEADING))
    heading = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(raw, HEADING, 1), r"\s+", " ")), r"^[-(\s]+", "")
    return F.when(there & (heading != ""), heading), F.when(there, F.regexp_replace(F.regexp_replace(raw, HEADING, ""), r"^\s+|\s+$", "")).otherwise(raw)
