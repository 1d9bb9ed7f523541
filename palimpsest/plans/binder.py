"""Binds a ReportSpec to a catalog: validation and warnings on the driver, then one DataFrame plan for Catalyst.

A filter that can't be understood stops the report; columns and orders that can't be served are left out with a
warning. Rows are confined to their owner before anything that the specification says. Sorting follows the convention
of nulls last ascending and first descending, and ends with the key, so a limit cuts the same rows every time.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans import dates
from palimpsest.plans.spec import DATE, ENUM, FUNCTIONS, NUMBER, OPERATORS, Aggregate, Entity, Field, Filter, InvalidReport, Order, ReportSpec, Tables

DEFAULT_LIMIT, MOST_ROWS = 100, 500
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
LABELS = {"sum": "Suma", "avg": "Promedio", "min": "Mínimo", "max": "Máximo"}


@dataclass
class Bound:
    """df: the plan, its columns named by key. columns: (key, label, kind). filters: what was applied, in words."""

    df: DataFrame
    columns: list[tuple[str, str, str]]
    filters: list[str]
    warnings: list[str]
    title: str
    chart: str
    limit: int


def entity_of(catalog: dict[str, Entity], name: str) -> Entity:
    found = catalog.get((name or "").strip().lower())
    if found is None:
        raise InvalidReport(f"there is no entity {name!r}; there are: {', '.join(sorted(catalog))}")
    return found


def field_of(entity: Entity, name: str | None) -> Field:
    found = entity.fields.get((name or "").strip().lower())
    if found is None:
        raise InvalidReport(f"{entity.label} has no field {name!r}; it has: {', '.join(sorted(entity.fields))}")
    return found


def number(text: str, label: str) -> Decimal:
    try:
        value = Decimal(str(text).strip().replace(",", "."))
    except InvalidOperation:
        raise InvalidReport(f"{text!r} is no number for {label}") from None
    if not value.is_finite():
        raise InvalidReport(f"{text!r} is no number for {label}")
    return value


def date_condition(f: Field, told: Filter, now: datetime) -> tuple[Column, str]:
    try:
        found = dates.days(told.value, now)
        words = dates.describe(told.value, found)
        if told.op == "between" and told.value_to:
            found = found[0], dates.days(told.value_to, now)[1]
            words = f"{told.value} - {told.value_to}"
    except dates.AmbiguousDate as e:
        raise InvalidReport(f"{e} can't be read as a date") from None
    c, (lo, hi) = f.column(), map(F.lit, dates.instants(found))
    inside = c.isNotNull() & (c >= lo) & (c < hi)
    chosen = {"eq": inside, "between": inside, "ge": c >= lo, "gt": c >= hi, "le": c < hi, "lt": c < lo, "ne": (c < lo) | (c >= hi)}[told.op]
    return chosen, f"{f.label} {told.op} {words}"


def condition(entity: Entity, told: Filter, now: datetime) -> tuple[Column, str]:
    f = field_of(entity, told.field)
    if "F" not in f.can:
        raise InvalidReport(f"{f.label} can't be filtered")
    if told.op not in OPERATORS[f.kind]:
        raise InvalidReport(f"{told.op} doesn't apply to {f.label}")
    if f.kind == DATE:
        return date_condition(f, told, now)
    c = f.column()
    if told.op == "contains":
        return F.contains(F.lower(c), F.lower(F.lit(told.value))), f"{f.label} contains {told.value!r}"
    value: object = str(told.value).strip()
    if f.kind == NUMBER:
        value = number(told.value, f.label)
    elif f.kind == ENUM and value not in f.values:
        raise InvalidReport(f"{told.value!r} is no value of {f.label}; it has: {', '.join(f.values)}")
    v = F.lit(value)
    if told.op == "between":
        upper = number(told.value_to, f.label)
        return c.between(v, F.lit(upper)), f"{f.label} between {value} and {upper}"
    found = {"eq": c == v, "ne": ~c.eqNullSafe(v), "gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[told.op]
    return found, f"{f.label} {told.op} {value}"


def aggregate(entity: Entity, told: Aggregate) -> tuple[str, str, Column]:
    if told.function not in FUNCTIONS:
        raise InvalidReport(f"there is no function {told.function!r}")
    if told.function == "count" and not told.field:
        return "count", "Cantidad", F.count(F.lit(1))
    f = field_of(entity, told.field)
    name = told.field.strip().lower()
    if told.function == "count":
        return f"count_{name}", f"Cantidad de {f.label.lower()}", F.count(f.column())
    if "A" not in f.can:
        raise InvalidReport(f"{f.label} can't be aggregated")
    return f"{told.function}_{name}", f"{LABELS[told.function]} de {f.label.lower()}", AGGREGATES[told.function](f.column())


def placed(c: Column, descending: bool) -> Column:
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def clamp(limit: int | None) -> int:
    return max(1, min(limit or DEFAULT_LIMIT, MOST_ROWS))


def bind(spec: ReportSpec, catalog: dict[str, Entity], tables: Tables, owner: object = None, now: datetime | None = None) -> Bound:
    """The plan of a report for one owner. A private entity without an owner is an error, never all rows."""
    entity = entity_of(catalog, spec.entity)
    now = now or datetime.now(UTC)
    warnings: list[str] = []
    conditions = [condition(entity, f, now) for f in spec.filters]

    groups = [(g.strip().lower(), field_of(entity, g)) for g in spec.group_by]
    for name, f in groups:
        if "G" not in f.can:
            raise InvalidReport(f"{f.label} can't be grouped by")
    told = spec.aggregates or ((Aggregate("count"),) if groups else ())
    sums = [aggregate(entity, a) for a in told]

    if entity.owner and owner is None:
        raise InvalidReport(f"{entity.label} is private")
    df = entity.base(tables)
    if entity.owner:
        df = df.where(F.col(entity.owner) == F.lit(owner))
    if entity.fixed:
        df = df.where(entity.fixed())

    shown = []
    if not groups and not sums:
        for name in spec.columns:
            if name.strip().lower() in entity.fields:
                shown.append(name.strip().lower())
            else:
                warnings.append(f"unknown column {name!r} left out")
        shown = list(dict.fromkeys(shown)) or list(entity.default_columns)

    named = [f.field for f in spec.filters] + list(spec.group_by) + [a.field for a in told if a.field] + shown + [o.field for o in spec.order] + [entity.default_order.field]
    for need in dict.fromkeys(f.needs for n in named if (f := entity.fields.get(n.strip().lower())) and f.needs):
        key, make = entity.derived[need]
        df = df.join(make(tables), key, "left")
    for c, _ in conditions:
        df = df.where(c)

    orders, keys = sorting(entity, spec, groups, sums, warnings)
    limit = clamp(spec.limit)
    if groups or sums:
        if groups:
            grouped = df.groupBy(*(f.column().alias(n) for n, f in groups))
            df = grouped.agg(*(c.alias(n) for n, _, c in sums))
        else:
            df = df.agg(*(c.alias(n) for n, _, c in sums))
        columns = [(n, f.label, f.kind) for n, f in groups] + [(n, label, NUMBER) for n, label, _ in sums]
        df = df.orderBy(*orders, *keys).limit(limit) if orders or keys else df.limit(limit)
    else:
        columns = [(n, entity.fields[n].label, entity.fields[n].kind) for n in shown]
        ids = [F.col(entity.key[0]).alias("_id")] if entity.has_detail else []
        df = df.orderBy(*orders, *keys).limit(limit).select(*ids, *(entity.fields[n].column().alias(n) for n in shown))
    chart = spec.chart
    if chart != "table" and not (columns[0][2] != NUMBER and any(k == NUMBER for _, _, k in columns[1:])):
        warnings.append("a chart needs a label and a number; shown as a table")
        chart = "table"
    return Bound(df, columns, [d for _, d in conditions], warnings, spec.title or default_title(entity, spec, [f for _, f in groups]), chart, limit)


def default_title(entity: Entity, spec: ReportSpec, groups: list[Field]) -> str:
    """What a report without a title shows: its groups, else the value of the first equality with one of a field's values."""
    if groups:
        return f"{entity.label} por {', '.join(f.label.lower() for f in groups)}"
    for told in spec.filters:
        found = entity.fields.get(told.field.strip().lower())
        if found is not None and found.kind == ENUM and told.op == "eq":
            return f"{entity.label}: {told.value}"
    return entity.label


def sorting(entity: Entity, spec: ReportSpec, groups: list, sums: list, warnings: list[str]) -> tuple[list[Column], list[Column]]:
    """What is sorted by and the key that ends it. A grouped report sorts by its groups and aggregates alone; a group
    sorts by its own value even where the field has a rank."""
    made = {n for n, _ in groups} | {n for n, _, _ in sums}
    orders: list[Column] = []
    for o in spec.order:
        name = o.field.strip().lower()
        if groups or sums:
            if name not in made:
                warnings.append(f"can't sort by {o.field!r} here")
                continue
            orders.append(placed(F.col(name), o.descending))
            continue
        f = entity.fields.get(name)
        if f is None or "O" not in f.can:
            warnings.append(f"can't sort by {o.field!r}")
            continue
        orders.append(placed((f.rank or f.column)(), o.descending))
    if groups or sums:
        if not orders and sums and groups:
            orders = [placed(F.col(sums[0][0]), True)]
        return orders, [placed(F.col(n), False) for n, _ in groups]
    if not orders:
        f = field_of(entity, entity.default_order.field)
        orders = [placed((f.rank or f.column)(), entity.default_order.descending)]
    return orders, [placed(F.col(k), False) for k in entity.key]


__all__ = ["Bound", "Order", "bind", "clamp", "condition"]
