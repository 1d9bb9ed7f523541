"""All registered queries but those of the corpus subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import answer_queries, case_queries, contract_queries, relational_queries, report_queries, text_queries, validation_queries

MODULES = (report_queries, relational_queries, text_queries, case_queries, contract_queries, answer_queries, validation_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two calendar years by month."""
    return QUERIES["flagship_report"](spark, sf_dir)
