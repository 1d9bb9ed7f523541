"""The digest tree, and texts made once."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import relational as R
from palimpsest.operators.cases import fitting


def root(spark, rows, fan=1):
    df = spark.createDataFrame(rows, "k long, text string")
    return tuple(R.digest_tree(df.repartition(3), F.col("k"), F.md5("text"), fan).first())


def test_a_digest_tree_knows_every_change_and_no_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(10**15), f"text {i}") for i in range(900)] + [(None, "x"), (5, None), (6, ""), (7, "twice"), (7, "twice")]
    whole = root(spark, rows)
    assert whole[1] == len(rows) and root(spark, rows[::-1]) == whole
    changes = (rows[:-1], rows + [(8, "new")], [(rows[0][0], "other")] + rows[1:], [(rows[0][0] + 1, rows[0][1])] + rows[1:], [x for x in rows if x != (5, None)] + [(5, "")])
    assert len({root(spark, c)[0] for c in changes} | {whole[0]}) == 6
    empty = spark.createDataFrame([], "k long, text string")
    assert R.digest_tree(empty, F.col("k"), F.md5("text")).count() == 0


def test_no_node_of_a_digest_tree_has_many_children(spark):
    """Ids that share all but their last digits still part: leaves follow a hash of the key."""
    df = spark.range(0, 4000 * 10**9, 10**9).select(F.col("id").alias("k"), F.col("id").cast("string").alias("text"))
    leaves = df.select(F.md5(F.col("k").cast("string")).alias("path")).groupBy(F.substring("path", 1, 2)).count().agg(F.max("count")).first()[0]
    assert leaves < 3 * 16


def test_a_column_made_once_stays_once_in_the_plan(spark):
    df = R.made_once(spark.range(3), {"x": F.sha2(F.col("id").cast("string"), 256)})
    plan = df.where(F.length("x") > 0).select(*(F.concat("x", F.lit(str(i))).alias(f"c{i}") for i in range(5)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_fitting_has_no_cross_join(spark):
    q = spark.createDataFrame([("la duración del contrato de trabajo",), ("nada",)], "text string")
    h = spark.createDataFrame([(1, "contrato trabajo nocturno"), (2, "otra materia")], "item_id int, heading string")
    plan = fitting(q, h, "text", "heading", "item_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_content_hash_of_more_keys_than_leaves_of_leaves(spark, tmp_path):
    from oracle import differences

    from palimpsest.plans.catalog_queries import ORACLE_SQL, QUERIES

    texts = F.when(F.col("doc_id") % 1000 != 0, F.concat(F.lit("text "), F.col("doc_id").cast("string")))
    spark.range(65_537).select(F.col("id").alias("doc_id"), texts.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, str(tmp_path), QUERIES["content_hash"], ORACLE_SQL["content_hash"]) == ""
