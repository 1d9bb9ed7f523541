"""Report sinks. What a report shows is made by Spark: cells as texts and the chart's bars are Columns over the bound frame.
A bound report has 500 rows at most (spec.clamp), which then come to the driver in one collect; results of any size are
written by Spark itself. Office formats need libraries that aren't here.
"""

from __future__ import annotations

import csv
import html
import io
import json
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import shortened
from palimpsest.plans.binder import Bound
from palimpsest.plans.dates import ZONE
from palimpsest.plans.spec import NUMBER

# What stands for nothing, the longest text, the labels of the header facts in their order.
EMPTY, LONGEST = "—", 300
FACTS = ("Petición", "Generado", "Entidad", "Resultados", "Presentación", "Filtros aplicados", "Avisos")


@dataclass(frozen=True)
class Report:
    """What every sink shows alike. lines: the rows as texts; bars: the chart's labels and values, none without a chart."""

    title: str
    columns: list[tuple[str, str, str]]
    rows: list[dict]
    lines: list[list[str]]
    facts: list[tuple[str, str]]
    bars: list[tuple[str, float]]
    measure: str


def shown(c: Column, kind: T.DataType) -> Column:
    """A cell's text: instants as days of the report calendar, numbers to two places without zeros behind, lists joined by
    commas, long texts cut; a dash for null and for an empty text."""
    if isinstance(kind, T.TimestampType):
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
        text = F.date_format(utc - F.expr("INTERVAL 4 HOURS"), "dd/MM/yyyy")
    elif isinstance(kind, T.TimestampNTZType):  # stored instants without a zone are UTC
        text = F.date_format(c - F.expr("INTERVAL 4 HOURS"), "dd/MM/yyyy")
    elif isinstance(kind, T.DateType):
        text = F.date_format(c, "dd/MM/yyyy")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = F.regexp_replace(F.round(c.cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string"), r"\.00$|(\.[0-9])0$", "$1")
    elif isinstance(kind, T.ArrayType):
        text = shortened(F.array_join(c.cast("array<string>"), ", "), LONGEST)
    else:
        text = shortened(c.cast("string"), LONGEST)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(EMPTY))


def cells(df: DataFrame, keys: list[str]) -> list[Column]:
    return [shown(F.col(f"`{k}`"), df.schema[k].dataType).alias(k) for k in keys]


def bar(df: DataFrame, columns: list[tuple[str, str, str]]) -> Column | None:
    """A row's bar, struct<label, value>: the text of the first column that holds no numbers and the number in the first that
    does, 0 where there is none. None if the report lacks either."""
    by_kind: dict[bool, str] = {}
    for key, _, kind in columns:
        by_kind.setdefault(kind == NUMBER, key)
    if len(by_kind) < 2:
        return None
    value = F.coalesce(F.col(f"`{by_kind[True]}`").try_cast("double"), F.lit(0.0))
    return F.struct(shown(F.col(f"`{by_kind[False]}`"), df.schema[by_kind[False]].dataType).alias("label"), value.alias("value"))


def gathered(bound: Bound, entity: str, request: str = "", now: datetime | None = None) -> Report:
    """A bound report's rows, their texts and bars in one collect, with the facts about it."""
    keys = [k for k, _, _ in bound.columns]
    chart = bar(bound.df, bound.columns)
    told = bound.df.select(F.struct(*(F.col(f"`{k}`") for k in keys)).alias("row"), F.array(*cells(bound.df, keys)).alias("line"), (chart if chart is not None else F.lit(None)).alias("bar")).collect()
    measure = next((label for _, label, kind in bound.columns if kind == NUMBER), "")
    values = request, f"{(now or datetime.now(UTC)).astimezone(ZONE):%d/%m/%Y %H:%M}", entity, f"{len(told)}", bound.chart, " · ".join(bound.filters) or "sin filtros", " · ".join(bound.warnings)
    facts = [fact for fact in zip(FACTS, values, strict=True) if fact[1]]
    return Report(bound.title, bound.columns, [r["row"].asDict() for r in told], [r["line"] for r in told], facts, [tuple(r["bar"]) for r in told if r["bar"]], measure)


def as_csv(report: Report) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow([label for _, label, _ in report.columns])
    writer.writerows(report.lines)
    return out.getvalue()


def as_json(report: Report) -> str:
    told = {"titulo": report.title, "ficha": dict(report.facts), "columnas": [{"clave": k, "etiqueta": label, "tipo": kind} for k, label, kind in report.columns], "filas": report.rows}
    if report.bars:
        labels, values = zip(*report.bars)
        told["grafico"] = {"etiquetas": labels, "valores": values, "titulo": report.measure}
    return json.dumps(told, ensure_ascii=False, default=lambda v: float(v) if isinstance(v, Decimal) else v.isoformat())


def as_html(report: Report) -> str:
    """A page of the title, the header facts, the chart as bars of their share of the largest value, and the table."""
    e = html.escape
    row = lambda tag, texts: "<tr>" + "".join(f"<{tag}>{e(x)}</{tag}>" for x in texts) + "</tr>"
    facts = "".join(f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in report.facts)
    top = max((v for _, v in report.bars if v > 0), default=1.0)
    bars = "".join(f'<div>{e(k)} <meter max="1" value="{max(v, 0) / top:.4f}"></meter> {v:.10g}</div>' for k, v in report.bars)
    figure = f"<figure><figcaption>{e(report.measure)}</figcaption>{bars}</figure>" if bars else ""
    head, body = row("th", [label for _, label, _ in report.columns]), "".join(row("td", line) for line in report.lines)
    return f"<!doctype html><meta charset=utf-8><title>{e(report.title)}</title><h1>{e(report.title)}</h1><dl>{facts}</dl>{figure}<table><thead>{head}</thead><tbody>{body}</tbody></table>"
