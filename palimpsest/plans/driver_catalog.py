"""The report catalog over the driver's tables, and the reading of those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.spec import DATE, ENUM, NUMBER, TEXT, Entity, Field, Order, Tables


def tables_of(spark: SparkSession, sf_dir: str) -> Tables:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(name: str):
    """Stored instants carry no zone; they are UTC."""
    return lambda: F.col(name).cast("timestamp")


def month(name: str):
    """The month bucket follows the session's zone, unlike filters, which follow the report calendar."""
    return lambda: F.date_format(F.date_trunc("month", F.col(name)), "yyyy-MM")


def plain(name: str):
    return lambda: F.col(name)


def money(name: str):
    return lambda: F.col(name).cast("decimal(18,2)")


def severity(c: Column) -> Column:
    return F.when(c == "alta", 3).when(c == "media", 2).otherwise(1)


def priority_rank() -> Column:
    return F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)


def lines_per_order(t: Tables) -> DataFrame:
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_partkey")
    return lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.array_join(F.array_sort(F.collect_list(F.col("l_partkey").cast("string"))), ", ").alias("parts"))


def risk_chain(t: Tables) -> DataFrame:
    lines, orders, customers = t("lineitem"), t("orders"), t("customer")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.withColumn("level", F.when(F.col("l_returnflag") == "R", "alta").when(F.col("l_returnflag") == "A", "media").otherwise("baja"))


def nation_pairs(t: Tables) -> DataFrame:
    suppliers, customers, nations = t("supplier"), t("customer"), t("nation")
    a, b = nations.alias("a"), nations.alias("b")
    pairs = suppliers.join(customers, F.col("s_suppkey") == F.col("c_custkey"))
    return pairs.join(a, F.col("s_nationkey") == F.col("a.n_nationkey")).join(b, F.col("c_nationkey") == F.col("b.n_nationkey"))


CATALOG: dict[str, Entity] = {
    "orders": Entity(
        label="Órdenes",
        base=lambda t: t("orders"),
        key=("o_orderkey",),
        owner="o_custkey",
        has_detail=True,
        default_columns=("key", "date", "status"),
        default_order=Order("date", True),
        derived={"lines": ("o_orderkey", lines_per_order)},
        fields={
            "key": Field("Clave", NUMBER, plain("o_orderkey"), "FO"),
            "date": Field("Fecha", DATE, instant("o_orderdate"), "FO"),
            "status": Field("Estado", ENUM, plain("o_orderstatus"), "FOG", ("F", "O", "P")),
            "priority": Field("Prioridad", TEXT, plain("o_orderpriority"), "FOG", rank=priority_rank),
            "price": Field("Precio", NUMBER, money("o_totalprice"), "FOGA"),
            "month": Field("Mes", TEXT, month("o_orderdate"), "OG"),
            "lines": Field("Cantidad de líneas", NUMBER, lambda: F.coalesce(F.col("lines"), F.lit(0)), "FOA", needs="lines"),
            "returned": Field("Devueltas", NUMBER, lambda: F.coalesce(F.col("returned"), F.lit(0)), "FOA", needs="lines"),
            "parts": Field("Partes", TEXT, plain("parts"), "", needs="lines"),
        },
    ),
    "all_orders": Entity(
        label="Órdenes de todos",
        base=lambda t: t("orders"),
        key=("o_orderkey",),
        default_columns=("key", "status"),
        default_order=Order("key"),
        derived={"lines": ("o_orderkey", lines_per_order)},
        fields={
            "key": Field("Clave", NUMBER, plain("o_orderkey"), "FO"),
            "date": Field("Fecha", DATE, instant("o_orderdate"), "FO"),
            "customer": Field("Cliente", NUMBER, plain("o_custkey"), "FOG"),
            "status": Field("Estado", ENUM, plain("o_orderstatus"), "FOG", ("F", "O", "P")),
            "priority": Field("Prioridad", TEXT, plain("o_orderpriority"), "FOG", rank=priority_rank),
            "price": Field("Precio", NUMBER, money("o_totalprice"), "FOA"),
            "month": Field("Mes", TEXT, month("o_orderdate"), "OG"),
            "lines": Field("Cantidad de líneas", NUMBER, lambda: F.coalesce(F.col("lines"), F.lit(0)), "FOA", needs="lines"),
            "parts": Field("Partes", TEXT, plain("parts"), "", needs="lines"),
        },
    ),
    "risks": Entity(
        label="Riesgos",
        base=risk_chain,
        key=("l_orderkey", "l_linenumber"),
        owner="c_custkey",
        default_columns=("order", "level", "mode"),
        default_order=Order("level", True),
        fields={
            "order": Field("Orden", NUMBER, plain("l_orderkey"), "FO"),
            "line": Field("Línea", NUMBER, plain("l_linenumber"), "FO"),
            "level": Field("Severidad", ENUM, plain("level"), "FOG", ("alta", "media", "baja"), rank=lambda: severity(F.col("level"))),
            "mode": Field("Estado", ENUM, plain("l_linestatus"), "FOG", ("F", "O")),
            "segment": Field("Segmento", TEXT, plain("c_mktsegment"), "FOG"),
            "quantity": Field("Cantidad", NUMBER, lambda: F.col("l_quantity").cast("decimal(18,2)"), "FOA"),
            "date": Field("Fecha", DATE, instant("l_shipdate"), "FO"),
            "month": Field("Mes", TEXT, month("l_shipdate"), "OG"),
        },
    ),
    "comparisons": Entity(
        label="Comparaciones",
        base=nation_pairs,
        key=("s_suppkey",),
        default_columns=("supplier", "nation_a", "nation_b"),
        default_order=Order("supplier"),
        fields={
            "supplier": Field("Proveedor", NUMBER, plain("s_suppkey"), "FO"),
            "nation_a": Field("Documento A", TEXT, plain("a.n_name"), "FOG"),
            "nation_b": Field("Documento B", TEXT, plain("b.n_name"), "FOG"),
        },
    ),
    "parts": Entity(
        label="Partes",
        base=lambda t: t("part"),
        key=("p_partkey",),
        fixed=lambda: F.col("p_size") <= 25,
        default_columns=("key", "name", "brand"),
        default_order=Order("key"),
        has_detail=True,
        fields={
            "key": Field("Clave", NUMBER, plain("p_partkey"), "FOA"),
            "name": Field("Nombre", TEXT, plain("p_name"), "FO"),
            "brand": Field("Marca", TEXT, plain("p_brand"), "FOG"),
            "type": Field("Tipo", TEXT, plain("p_type"), "FOG"),
            "size": Field("Tamaño", NUMBER, plain("p_size"), "FOGA"),
            "price": Field("Precio", NUMBER, money("p_retailprice"), "FOA"),
        },
    ),
}
