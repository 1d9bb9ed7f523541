"""Quality rules as weak supervision: rules vote keep or reject or abstain, expectation-maximisation estimates how often
each does so on good and on bad documents, and a document's posterior decides. DataFrame functions only.

Capitals and small letters are those of ASCII; letters outside it are neither, so the rules on capitals abstain on other
scripts.

Edge cases: a null text has no words and counts as empty; such texts fail the base rule. Equal rows get equal verdicts.
An empty table gives an empty result; a table on which no rule votes keeps all that pass the base rule. Ids may be null.
Windows are compared by the XXH64 of their three words; two different windows of one text would have to share it to be
miscounted. Columns other than the id and the text are not read by stats() and passed through by filtered(), whatever
their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import drop_written, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: How many documents the rules' votes start from being right about, and where rounds stop.
PRIOR, ROUNDS, SMOOTH = 0.9, 25, 1.0
#: A rule's votes at the start: keep, reject, abstain, on good and on bad documents. It fixes which class is the good one.
FIRST = {"good": (0.58, 0.02, 0.4), "bad": (0.2, 0.4, 0.4)}
VOTES = (1, 0, None)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows sorted by hash beside their place; neighbours with
    the same hash are repeats; their places, sorted, cover 3 words each less what they share with the next."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda w: F.filter(w, lambda x, k: (F.get(w, k - 1)["h"] == x["h"]) | (F.get(w, k + 1)["h"] == x["h"]))
        places = lambda w: F.sort_array(F.transform(same(w), lambda x: x["i"]))
        gaps = lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
        return let(placed, lambda w: let(places(w), gaps))

    distinct = lambda hashes: F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(n < 4, F.lit(0)).otherwise(let(windows, lambda h: F.when(distinct(h), F.lit(0)).otherwise(covered(h))))


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Rows (doc_id, the base counts, and what else the rules look at); whole: with the document's columns as a struct, row."""
    row = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if whole else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = text
    for space in "\n\t\r\x0b\x0c":
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), flat.alias("f"), *row)
    row = ["row"] * whole
    loose = F.contains("f", F.lit("  ")) | F.startswith("f", F.lit(" ")) | F.endswith("f", F.lit(" ")) | (F.col("f") == "")
    split = read.select("doc_id", "t", *row, F.when(loose, F.filter(F.split("f", " "), lambda w: w != "")).otherwise(F.split("f", " ")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.array_join("w", "")
    counts = (
        F.size("w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        held("#*$%&|<>").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("lines"),
        F.size(F.array_distinct("w")).cast("long").alias("distinct_words"),
        F.octet_length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("capitals"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[a-z]+", ""))).cast("long").alias("smalls"),
        held("!?").alias("shouts"),
        held(".,").alias("stops"),
    )
    # Rows of one element each: what follows reads the counts as they are made, and can't be merged into their making.
    return split.select("doc_id", *row, F.inline_outer(F.array(F.struct(*counts))))


def held(characters: str) -> Column:
    """How many of these ASCII characters t has. Replacing one at a time is far cheaper than a regular expression or translate()."""
    rest = F.col("t")
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length("t") - F.octet_length(rest)).cast("long")


def votes() -> dict[str, Column]:
    """Each rule's vote from a document's counts: 1 keep, 0 reject, null abstains.

    The first five know one fault each and abstain on a text without it. The last three look at the whole: they vote keep
    only where none of the five has found its fault, so that no fault is outvoted by rules that look for others.
    """
    words = F.greatest(F.col("n_words"), F.lit(1))
    per_word = lambda c: F.col(c) / words
    marks = (F.col("n_symbols") + F.col("shouts")) / words
    capital = F.col("capitals") / F.greatest(F.col("capitals") + F.col("smalls"), F.lit(1))
    faults = {
        "symbols": per_word("n_symbols") >= 0.2,
        "capitals": (capital >= 0.6) & (F.col("capitals") >= 20),
        "shouts": per_word("shouts") >= 0.3,
        "repeats": per_word("n_repeat_words") >= 0.4,
        "lines": (F.col("lines") >= 4) & (F.col("n_dup_lines") >= 0.4 * F.col("lines")),
    }
    sound = ~reduce(lambda a, b: a | b, faults.values())
    sentences = (per_word("stops") >= 0.02) & (per_word("stops") <= 0.6)
    return {k: F.when(found, 0) for k, found in faults.items()} | {
        "marks": F.when(marks >= 0.2, 0).when(sound & (marks < 0.1), 1),
        "natural": F.when(sound & (marks < 0.1) & (capital < 0.25) & sentences, 1).when((marks >= 0.2) | faults["capitals"] | (per_word("stops") > 1), 0),
        "variety": F.when(faults["repeats"] | faults["lines"], 0).when(sound & (F.col("n_words") >= 50) & (per_word("n_repeat_words") < 0.15), 1),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_odds(model: dict) -> Column:
    """Of good against bad, given the votes and how often each rule votes so on either."""
    total = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for rule, shares in model["rules"].items():
        keep, reject, abstain = (math.log(good / bad) for good, bad in zip(shares["good"], shares["bad"]))
        total = total + F.when(F.col(rule) == 1, keep).when(F.col(rule) == 0, reject).otherwise(abstain)
    return total


def shares_of(sums: dict[str, list[float]]) -> dict[str, tuple[float, ...]]:
    """A rule's shares of keep, reject and abstain on good and bad documents from their sums, smoothed towards FIRST. No
    rule may reject more of the good than of the bad, or keep more of the bad: what says so is set to the other's share."""
    share = {c: [(n + SMOOTH * f) / (sum(ns) + SMOOTH) for n, f in zip(ns, FIRST[c])] for c, ns in sums.items()}
    good, bad = share["good"], share["bad"]
    if good[0] < bad[0]:
        bad[0] = good[0]
    if good[1] > bad[1]:
        good[1] = bad[1]
    return {c: tuple(x) for c, x in share.items()}


def fit(counted: DataFrame) -> dict:
    """prior: share of good documents; rules: for good and bad the shares of keep, reject and abstain.

    The votes of all documents are first grouped: at most 3 ** 8 patterns, whatever the corpus' size. Each round is one
    aggregation over them, of which one row of sums comes back.
    """
    rules = list(votes())
    patterns = written(counted.select(*(v.alias(k) for k, v in votes().items())).groupBy(*rules).agg(F.count(F.lit(1)).alias("n")), "patterns")
    model = {"prior": PRIOR, "rules": {r: FIRST for r in rules}}
    for _ in range(ROUNDS):
        p = F.lit(1.0) / (1 + F.exp(-log_odds(model)))
        weighed = patterns.select("*", (F.col("n") * p).alias("good"), (F.col("n") * (1 - p)).alias("bad"))
        sums = [F.sum(F.when(F.col(r).eqNullSafe(v), F.col(c))).alias(f"{r}_{v}_{c}") for r in rules for v in VOTES for c in FIRST]
        got = weighed.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), *sums).first().asDict()
        n = (got["good"] or 0) + (got["bad"] or 0) + 2 * SMOOTH
        shares = {r: shares_of({c: [got[f"{r}_{v}_{c}"] or 0 for v in VOTES] for c in FIRST}) for r in rules}
        following = {"prior": ((got["good"] or 0) + SMOOTH) / n, "rules": shares}
        change = max(abs(following["prior"] - model["prior"]), *(abs(x - y) for r in rules for c in FIRST for x, y in zip(shares[r][c], model["rules"][r][c])))
        model = following
        if change < 1e-6:
            break
    drop_written(patterns)
    return model


def decided(counted: DataFrame, model: dict, threshold: float) -> DataFrame:
    """stats() with the votes, the posterior that the document is good, base_failed and kept."""
    posterior = F.lit(1.0) / (1 + F.exp(-log_odds(model)))
    voted = counted.withColumns(votes()).withColumn("posterior", posterior)
    return voted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """stats() with the votes, the posterior that the document is good, base_failed and kept."""
    counted = written(stats(docs, id_col, text_col), "stats")
    return decided(counted, fit(counted), threshold)


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that judged() keeps, with all their columns. Counts are made twice, for the model and for the verdict,
    so that no text is shuffled or written a second time."""
    model = fit(stats(docs, id_col, text_col))
    return decided(stats(docs, id_col, text_col, whole=True), model, threshold).where("kept").select("row.*")
