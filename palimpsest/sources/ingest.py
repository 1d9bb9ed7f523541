"""Documents from files: decoding, clean-up, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, LEAST_CHARACTERS = 10 << 20, 200
SUFFIXES = ("pdf", "docx", "txt")


def normalised(text: Column) -> Column:
    """Line ends as \\n, at most one blank line in a row."""
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n")


def bare_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[ \t\n\r\f\x0b]", ""))


def status(accepted: Column, size: Column, text: Column, most: int = MOST_BYTES) -> Column:
    """rechazado: wrong kind or too large; fallido: too little text; else procesado."""
    return F.when(~accepted | (size > most), "rechazado").when(F.coalesce(bare_length(text), F.lit(0)) < LEAST_CHARACTERS, "fallido").otherwise("procesado")


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where that fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, suffix, bytes, text, status) of a folder's files; what isn't plain text is left for its own extractor.
    Files that are refused stay as rows: a bad upload doesn't stop the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.substring_index("path", ".", -1))
    known = files.select("path", suffix.alias("suffix"), F.col("length").alias("bytes"), F.when(suffix == "txt", normalised(decoded(F.col("content")))).alias("text"))
    return known.withColumn("status", status(F.col("suffix").isin(*SUFFIXES), F.col("bytes"), F.col("text")))
