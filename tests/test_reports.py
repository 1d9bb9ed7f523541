"""The report engine: what its specifications may say, dates, order, limits, isolation."""

from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import dates, fidelity, sinks
from palimpsest.plans.binder import bind, clamp
from palimpsest.plans.driver_catalog import CATALOG
from palimpsest.plans.spec import NUMBER, InvalidReport, ReportSpec

NOW = datetime(2026, 9, 15, 2, 30, tzinfo=UTC)  # still the 14th in UTC-4


@pytest.fixture(scope="module")
def tables(spark):
    orders = spark.createDataFrame(
        [(1, 1, "F", 10.5, datetime(2026, 9, 1, 2), "2-HIGH"), (2, 1, None, 99.0, datetime(2026, 9, 10), "1-URGENT"), (3, 2, "O", 5.0, datetime(2026, 8, 5), None), (4, 1, "F", 7.0, None, "100% _x")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    )
    lines = spark.createDataFrame([(1, "R", 5), (1, "N", 4), (2, "A", 3)], "l_orderkey long, l_returnflag string, l_partkey long")
    return {"orders": orders, "lineitem": lines}.__getitem__


def keys(tables, owner=1, **spec):
    df = bind(ReportSpec.parse({"entity": "orders", "columns": ["key"]} | spec), CATALOG, tables, owner, NOW)
    return [r["_id"] for r in df.df.collect()]


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("hoy", "2026-09-14", "2026-09-15"), ("ayer", "2026-09-13", "2026-09-14"), ("este mes", "2026-09-01", "2026-10-01"), ("mes_pasado", "2026-08-01", "2026-09-01"),
        ("esta semana", "2026-09-14", "2026-09-21"), ("Año pasado", "2025-01-01", "2026-01-01"), ("últimos 30 días", "2026-08-15", "2026-09-15"), ("ultimos_12_meses", "2025-09-01", "2026-09-15"),
        ("2026-02", "2026-02-01", "2026-03-01"), ("2024", "2024-01-01", "2025-01-01"), ("2026-09-15", "2026-09-15", "2026-09-16"), ("marzo", "2026-03-01", "2026-04-01"),
        ("noviembre", "2025-11-01", "2025-12-01"), ("diciembre de 2024", "2024-12-01", "2025-01-01"),
    ],
)
def test_dates(text, start, end):
    found = dates.resolve(text, NOW)
    assert [f"{d:%Y-%m-%d %H}" for d in found] == [f"{start} 04", f"{end} 04"]


@pytest.mark.parametrize("text", ["", "pronto", "2026-02-31", "2026-13", "el", "99"])
def test_ambiguous_dates(text):
    with pytest.raises(dates.AmbiguousDate):
        dates.resolve(text, NOW)


def test_isolation_and_default_order(tables):
    assert keys(tables) == [4, 2, 1]  # newest first, nulls before
    assert keys(tables, owner=2) == [3]
    with pytest.raises(InvalidReport):
        keys(tables, owner=None)


def test_filters(tables):
    f = lambda field, op, value, to=None: keys(tables, filters=[{"field": field, "op": op, "value": value, "value_to": to}])
    assert f("status", "ne", "F") == [2]  # a null differs
    assert f("date", "ne", "2026-08") == [2]  # a null date doesn't, and the 1st at 02:00 is still August in UTC-4
    assert f("date", "eq", "2026-08") == [1]
    assert f("price", "ge", "10,5") == [2, 1]
    assert f("price", "between", "7", "10,5") == [4, 1]
    assert f("priority", "contains", "% _X") == [4]
    assert f("lines", "gt", "1") == [1]


@pytest.mark.parametrize(
    "spec",
    [
        {"entity": "nothing"}, {"filters": [{"field": "nope", "op": "eq", "value": "1"}]}, {"filters": [{"field": "status", "op": "eq", "value": "Z"}]},
        {"filters": [{"field": "price", "op": "gt", "value": "many"}]}, {"filters": [{"field": "status", "op": "gt", "value": "F"}]}, {"filters": [{"field": "date", "op": "eq", "value": "31/31"}]},
        {"filters": [{"field": "month", "op": "eq", "value": "2026-09"}]}, {"group_by": ["date"]}, {"aggregates": [{"function": "sum", "field": "status"}]}, {"aggregates": [{"function": "median", "field": "price"}]},
    ],
)
def test_invalid(tables, spec):
    with pytest.raises(InvalidReport):
        keys(tables, **spec)


def test_unknown_keys():
    with pytest.raises(InvalidReport):
        ReportSpec.parse({"entity": "orders", "sql": "drop"})


def test_warnings_and_groups(tables):
    b = bind(ReportSpec.parse({"entity": "orders", "columns": ["key", "nope"], "order": [{"field": "parts"}], "chart": "bar"}), CATALOG, tables, 1, NOW)
    assert len(b.warnings) == 3 and b.chart == "table"
    b = bind(ReportSpec.parse({"entity": "orders", "group_by": ["status"], "aggregates": [{"function": "sum", "field": "price"}], "chart": "bar"}), CATALOG, tables, 1, NOW)
    assert [tuple(r) for r in b.df.collect()] == [(None, 99), ("F", 17.5)] and b.chart == "bar"
    assert b.df.columns == ["status", "sum_price"]


def test_limits():
    assert [clamp(n) for n in (None, 0, -1, 1, 9999)] == [100, 100, 1, 1, 500]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "orders.parquet")
    spark.range(10).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.current_timestamp().alias("o_orderdate"), F.lit("x").alias("o_orderpriority")).write.parquet(path)
    b = bind(ReportSpec.parse({"entity": "orders", "columns": ["status"]}), CATALOG, lambda n: spark.read.parquet(path), 1, NOW)
    plan = b.df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,1)" in plan and "o_totalprice" not in plan


def test_titles_facts_and_charts(tables):
    spec = {"entity": "orders", "columns": ["key", "date", "status"], "filters": [{"field": "status", "op": "eq", "value": "F"}], "order": [{"field": "parts"}]}
    bound = bind(ReportSpec.parse(spec), CATALOG, tables, 1, NOW)
    assert bound.title == "Órdenes: F" and bind(ReportSpec.parse({"entity": "orders", "group_by": ["status"]}), CATALOG, tables, 1, NOW).title == "Órdenes por estado"
    report = sinks.gathered(bound, "Órdenes", "mostrame las F", NOW)
    assert report.facts[:3] == [("Petición", "mostrame las F"), ("Generado", "14/09/2026 22:30"), ("Entidad", "Órdenes")] and report.facts[-1][0] == "Avisos" and ("Resultados", "2") in report.facts
    assert report.bars == [("—", 4.0), ("31/08/2026", 1.0)] and report.measure == "Clave"
    assert sinks.as_csv(report) == "Clave,Fecha,Estado\n4,—,F\n1,31/08/2026,F\n"
    import json

    told = json.loads(sinks.as_json(report))
    assert told["filas"][0]["key"] == 4 and told["grafico"]["valores"] == [4.0, 1.0]
    page = sinks.as_html(report)
    assert page.count("<tr>") == 3 and "Órdenes: F" in page and "<meter" in page
    empty = sinks.gathered(bind(ReportSpec.parse(spec | {"filters": [{"field": "status", "op": "eq", "value": "P"}]}), CATALOG, tables, 1, NOW), "Órdenes")
    assert empty.bars == [] and sinks.as_csv(empty) == "Clave,Fecha,Estado\n"


def test_cells_are_shown_by_spark(spark):
    row = [("", None, 1.5, 10.256, -0.004, 1e7, "x" * 301, [1, 2], datetime(2026, 9, 1, 2, tzinfo=UTC), datetime(2026, 9, 1, 2), date(2026, 9, 1), Decimal("7.10"), True, 12)]
    df = spark.createDataFrame(row, "a string, b string, c double, d double, e double, f double, g string, h array<int>, i timestamp, j timestamp_ntz, k date, l decimal(9,2), m boolean, n int")
    got = list(df.select(*sinks.cells(df, df.columns)).first())
    assert got == ["—", "—", "1.5", "10.26", "0", "10000000", "x" * 300 + "…", "1, 2", "31/08/2026", "31/08/2026", "01/09/2026", "7.1", "true", "12"]
    bar = sinks.bar(df, [("d", "D", NUMBER), ("c", "C", NUMBER), ("k", "K", "date"), ("a", "A", "text")])
    assert tuple(df.select(bar).first()[0]) == ("01/09/2026", 10.256) and sinks.bar(df, [("a", "A", "text")]) is None


def test_ranges_are_described_by_their_days():
    assert dates.describe("hoy", dates.days("hoy", NOW)) == "hoy (14/09/2026)"
    assert dates.describe("marzo", dates.days("marzo", NOW)) == "marzo (del 01/03/2026 al 31/03/2026)"
    assert dates.days("septiembre", NOW)[0] == date(2026, 9, 1) and dates.days("este año", NOW) == (date(2026, 1, 1), date(2027, 1, 1))


@pytest.mark.parametrize(
    ("request_text", "groups", "totals", "chart"),
    [
        ("mostrame clave y cantidad de líneas de mis órdenes", (), 0, "table"), ("órdenes agrupadas por estado", ("status",), 1, "table"), ("cuántas órdenes hay por mes en un gráfico", ("status",), 1, "bar"),
        ("el promedio de precios", (), 1, "table"), ("distribución por prioridad en torta", ("status",), 1, "pie"), ("ordenes por cliente", (), 0, "table"), ("exportalas a excel en un listado", (), 0, "table"),
    ],
)
def test_reports_say_no_more_than_asked(request_text, groups, totals, chart):
    spec = ReportSpec.parse({"entity": "orders", "group_by": ["status"], "aggregates": [{"function": "count"}], "chart": "bar"})
    got = fidelity.faithful(spec, request_text, CATALOG)
    assert (got.group_by, len(got.aggregates), got.chart) == (groups, totals, chart)
    kept = fidelity.faithful(spec, "ordenalo al revés", CATALOG, spec)
    assert (kept.group_by, kept.aggregates, kept.chart) == (spec.group_by, spec.aggregates, "bar")
    assert [fidelity.file_asked(x) for x in ("a Excel", "en PowerPoint", "como PDF", "nada")] == ["xlsx", "pptx", "pdf", ""]
    assert fidelity.faithful(ReportSpec("nope"), "x", CATALOG) == ReportSpec("nope")
