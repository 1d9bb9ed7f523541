"""The logical plan of a report: plain frozen values that come from JSON, and the catalog that they are bound against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

TEXT, NUMBER, DATE, ENUM, LIST = "text", "number", "date", "enum", "list"

#: Operators that each kind of field takes.
OPERATORS = {
    TEXT: ("eq", "ne", "contains"),
    NUMBER: ("eq", "ne", "gt", "ge", "lt", "le", "between"),
    DATE: ("eq", "ne", "gt", "ge", "lt", "le", "between"),
    ENUM: ("eq", "ne"),
    LIST: (),
}
FUNCTIONS = ("count", "sum", "avg", "min", "max")


class InvalidReport(ValueError):
    """The specification asks for what the catalog doesn't have; nothing was run."""


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: str
    value_to: str | None = None


@dataclass(frozen=True)
class Aggregate:
    function: str
    field: str | None = None


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class ReportSpec:
    entity: str
    columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None
    title: str = ""
    chart: str = "table"

    @staticmethod
    def parse(data: dict) -> ReportSpec:
        """From a JSON object; unknown keys are an error."""
        known = {"entity", "columns", "filters", "group_by", "aggregates", "order", "limit", "title", "chart"}
        if odd := set(data) - known:
            raise InvalidReport(f"unknown keys: {', '.join(sorted(odd))}")
        try:
            return ReportSpec(
                entity=str(data["entity"]),
                columns=tuple(data.get("columns", ())),
                filters=tuple(Filter(**f) for f in data.get("filters", ())),
                group_by=tuple(data.get("group_by", ())),
                aggregates=tuple(Aggregate(**a) for a in data.get("aggregates", ())),
                order=tuple(Order(**o) for o in data.get("order", ())),
                limit=data.get("limit"),
                title=data.get("title", ""),
                chart=data.get("chart", "table"),
            )
        except (KeyError, TypeError) as e:
            raise InvalidReport(f"the specification is malformed: {e}") from e


@dataclass(frozen=True)
class Field:
    """A column that reports may name. column: made when it is bound. rank: what it is sorted by, if not by itself.
    needs: the derived table that has to be joined for it."""

    label: str
    kind: str
    column: Callable[[], Column]
    can: str = "F"  # F filter, O order, G group, A aggregate
    values: tuple[str, ...] = ()
    rank: Callable[[], Column] | None = None
    needs: str | None = None


Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Entity:
    """base: rows with joined parents. owner: the column that a private entity's rows belong to. fixed: a predicate that
    always holds. derived: pre-aggregated children, joined by left_key only if a field needs them."""

    label: str
    base: Callable[[Tables], DataFrame]
    key: tuple[str, ...]
    fields: dict[str, Field]
    default_columns: tuple[str, ...]
    default_order: Order
    owner: str | None = None
    fixed: Callable[[], Column] | None = None
    derived: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = field(default_factory=dict)
    has_detail: bool = False
