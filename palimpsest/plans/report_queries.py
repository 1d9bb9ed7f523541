"""Registered queries of the report engine: specifications over the driver's catalog, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans import sinks
from palimpsest.plans.binder import bind
from palimpsest.plans.driver_catalog import CATALOG, tables_of
from palimpsest.plans.spec import ReportSpec

#: The moment that relative dates are read from; inside the driver tables' range.
NOW = datetime(1996, 9, 15, 18, 0, tzinfo=UTC)
OWNER = 7

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def report(name: str, spec: dict, sql: str, owner: object = None) -> None:
    """Registers a specification. Decimals leave as doubles and instants as text, so that engines can be compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = bind(ReportSpec.parse(spec), CATALOG, tables_of(spark, sf_dir), owner, NOW).df
        out = []
        for c, kind in df.dtypes:
            if kind.startswith("decimal"):
                out.append(F.round(F.col(c), 2).cast("double").alias(c))
            elif kind == "timestamp":
                out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)

    QUERIES[name], ORACLE_SQL[name] = run, sql


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def eq(field: str, value: str) -> dict:
    return {"field": field, "op": "eq", "value": value}


report("scan_entity", {"entity": "all_orders", "columns": ["key", "customer", "status", "date"], "limit": 500},
       f"SELECT o_orderkey AS key, o_custkey AS customer, o_orderstatus AS status, {day('o_orderdate')} AS date FROM orders ORDER BY o_orderkey LIMIT 500")
report("report_projection", {"entity": "parts", "columns": ["name", "nope", "Brand ", "price"], "limit": 50},
       "SELECT p_name AS name, p_brand AS brand, round(CAST(p_retailprice AS DECIMAL(18,2)), 2)::DOUBLE AS price, p_partkey AS _id FROM part WHERE p_size <= 25 ORDER BY p_partkey LIMIT 50")
report("report_with_id", {"entity": "orders", "columns": ["status"]},
       f"SELECT o_orderkey AS _id, o_orderstatus AS status FROM orders WHERE o_custkey = {OWNER} ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100", OWNER)
report("tenant_isolation", {"entity": "orders", "columns": ["key", "date", "status"], "filters": [{"field": "price", "op": "gt", "value": "0"}]},
       f"SELECT o_orderkey AS _id, o_orderkey AS key, {day('o_orderdate')} AS date, o_orderstatus AS status FROM orders WHERE o_custkey = {OWNER} AND o_totalprice > 0 ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100", OWNER)
report("fixed_filter", {"entity": "parts", "columns": ["key", "size"], "filters": [{"field": "size", "op": "ge", "value": "20"}]},
       "SELECT p_partkey AS _id, p_partkey AS key, p_size AS size FROM part WHERE p_size <= 25 AND p_size >= 20 ORDER BY p_partkey LIMIT 100")
report("month_bucket", {"entity": "all_orders", "group_by": ["month"], "order": [{"field": "month"}], "limit": 200},
       "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1 NULLS LAST LIMIT 200")
report("severity_rank", {"entity": "risks", "columns": ["order", "line", "level"], "limit": 40},
       f"""SELECT l_orderkey AS "order", l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 'alta' WHEN 'A' THEN 'media' ELSE 'baja' END AS level
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = {OWNER}
       ORDER BY CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END DESC, l_orderkey, l_linenumber LIMIT 40""", OWNER)  # fmt: skip
report("join_chain", {"entity": "risks", "group_by": ["level", "mode"], "aggregates": [{"function": "count"}, {"function": "sum", "field": "quantity"}]},
       f"""SELECT CASE l_returnflag WHEN 'R' THEN 'alta' WHEN 'A' THEN 'media' ELSE 'baja' END AS level, l_linestatus AS mode, count(*) AS count,
       sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS sum_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       WHERE c_custkey = {OWNER} GROUP BY 1, 2""", OWNER)  # fmt: skip
report("join_self_alias", {"entity": "comparisons", "group_by": ["nation_a", "nation_b"], "limit": 500, "order": [{"field": "nation_a"}, {"field": "nation_b"}]},
       """SELECT a.n_name AS nation_a, b.n_name AS nation_b, count(*) AS count FROM supplier JOIN customer ON s_suppkey = c_custkey
       JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY 1, 2 ORDER BY 1 NULLS LAST, 2 NULLS LAST LIMIT 500""")  # fmt: skip

flat = "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE {} ORDER BY o_orderkey LIMIT 500"
for name, told, where in (
    ("f_eq", eq("status", "F"), "o_orderstatus = 'F'"),
    ("f_ne", {"field": "status", "op": "ne", "value": "F"}, "o_orderstatus IS DISTINCT FROM 'F'"),
    ("f_contains", {"field": "priority", "op": "contains", "value": "urg"}, "contains(lower(o_orderpriority), 'urg')"),
    ("f_range", {"field": "price", "op": "ge", "value": "150000,5"}, "CAST(o_totalprice AS DECIMAL(18,2)) >= 150000.5"),
    ("f_between", {"field": "price", "op": "between", "value": "1000", "value_to": "90000"}, "CAST(o_totalprice AS DECIMAL(18,2)) BETWEEN 1000 AND 90000"),
    ("f_date_eq", eq("date", "1996-03"), "o_orderdate >= TIMESTAMP '1996-03-01 04:00:00' AND o_orderdate < TIMESTAMP '1996-04-01 04:00:00'"),
    ("f_date_between", {"field": "date", "op": "between", "value": "mes pasado", "value_to": "septiembre"}, "o_orderdate >= TIMESTAMP '1996-08-01 04:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 04:00:00'"),
    ("f_date_ne", {"field": "date", "op": "ne", "value": "1996"}, "o_orderdate < TIMESTAMP '1996-01-01 04:00:00' OR o_orderdate >= TIMESTAMP '1997-01-01 04:00:00'"),
    ("f_date_open", {"field": "date", "op": "gt", "value": "últimos 30 días"}, "o_orderdate >= TIMESTAMP '1996-09-16 04:00:00'"),
    ("f_derived_count", {"field": "lines", "op": "gt", "value": "5"}, "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) > 5"),
):
    report(name, {"entity": "all_orders", "columns": ["key", "status"], "filters": [told], "limit": 500}, flat.format(where))

report("agg_count", {"entity": "all_orders", "aggregates": [{"function": "count"}]}, "SELECT count(*) AS count FROM orders")
report("agg_count_col", {"entity": "all_orders", "group_by": ["status"], "aggregates": [{"function": "count", "field": "priority"}]},
       "SELECT o_orderstatus AS status, count(o_orderpriority) AS count_priority FROM orders GROUP BY 1")
for fn, sql in (("sum", "sum({})"), ("avg", "avg({})"), ("min", "min({})"), ("max", "max({})")):
    report(f"agg_{fn}", {"entity": "all_orders", "group_by": ["status"], "aggregates": [{"function": fn, "field": "price"}]},
           f"SELECT o_orderstatus AS status, round({sql.format('CAST(o_totalprice AS DECIMAL(18,2))')}, 2)::DOUBLE AS {fn}_price FROM orders GROUP BY 1")
report("group_multi", {"entity": "all_orders", "group_by": ["status", "priority"], "limit": 500},
       "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS count FROM orders GROUP BY 1, 2 LIMIT 500")
report("agg_global", {"entity": "all_orders", "aggregates": [{"function": "count"}, {"function": "max", "field": "price"}], "order": [{"field": "key"}]},
       "SELECT count(*) AS count, round(max(CAST(o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS max_price FROM orders")
report("agg_over_derived", {"entity": "all_orders", "group_by": ["priority"], "aggregates": [{"function": "sum", "field": "lines"}, {"function": "max", "field": "lines"}]},
       """SELECT o_orderpriority AS priority, CAST(sum(coalesce(n, 0)) AS BIGINT) AS sum_lines, max(coalesce(n, 0)) AS max_lines FROM orders
       LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")  # fmt: skip
report("string_agg", {"entity": "all_orders", "columns": ["key", "parts"], "limit": 200},
       """SELECT o_orderkey AS key, p AS parts FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY CAST(l_partkey AS VARCHAR)) AS p
       FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY 1 LIMIT 200""")  # fmt: skip
report("corr_count", {"entity": "all_orders", "columns": ["key", "lines"], "order": [{"field": "lines", "descending": True}], "limit": 300},
       """SELECT o_orderkey AS key, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders ORDER BY 2 DESC, 1 LIMIT 300""")  # fmt: skip
report("order_multi", {"entity": "all_orders", "columns": ["key", "status", "priority"], "order": [{"field": "priority", "descending": True}, {"field": "status"}, {"field": "parts"}], "limit": 120},
       """SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders
       ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END DESC, o_orderstatus NULLS LAST, o_orderkey LIMIT 120""")  # fmt: skip
report("order_default", {"entity": "all_orders", "group_by": ["month"], "aggregates": [{"function": "sum", "field": "price"}], "limit": 12},
       """SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS sum_price FROM orders GROUP BY 1
       ORDER BY sum(CAST(o_totalprice AS DECIMAL(18,2))) DESC NULLS FIRST, 1 LIMIT 12""")  # fmt: skip
report("limit_clamp", {"entity": "all_orders", "columns": ["key"], "limit": 9999}, "SELECT o_orderkey AS key FROM orders ORDER BY 1 LIMIT 500")
FLAGSHIP = {"entity": "all_orders", "filters": [{"field": "date", "op": "between", "value": "1995", "value_to": "1996"}], "group_by": ["month"],
            "aggregates": [{"function": "count"}, {"function": "sum", "field": "price"}], "order": [{"field": "month"}]}
report("flagship_report", FLAGSHIP,
       """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS sum_price FROM orders
       WHERE o_orderdate >= TIMESTAMP '1995-01-01 04:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 04:00:00' GROUP BY 1 ORDER BY 1 LIMIT 100""")  # fmt: skip


def chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of a report by month: its label and its number."""
    bound = bind(ReportSpec.parse({"entity": "all_orders", "group_by": ["month"], "chart": "bar", "limit": 500}), CATALOG, tables_of(spark, sf_dir), None, NOW)
    return bound.df.select(sinks.bar(bound.df, bound.columns).alias("bar")).select("bar.*")


def shown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every order as its report shows them."""
    orders = tables_of(spark, sf_dir)("orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return orders.select("o_orderkey", *sinks.cells(orders, ["o_orderdate", "o_totalprice", "o_orderpriority"]))


QUERIES |= {"chart_bars": chart_bars, "shown_cells": shown_cells}
ORACLE_SQL |= {
    "chart_bars": "SELECT coalesce(strftime(o_orderdate, '%Y-%m'), '—') AS label, count(*)::DOUBLE AS value FROM orders GROUP BY 1",
    "shown_cells": """SELECT o_orderkey, coalesce(strftime(o_orderdate - INTERVAL 4 HOUR, '%d/%m/%Y'), '—') AS o_orderdate, coalesce(nullif(o_orderpriority, ''), '—') AS o_orderpriority,
        coalesce(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS VARCHAR), '\\.00$|(\\.[0-9])0$', '\\1'), '—') AS o_totalprice FROM orders""",
}
