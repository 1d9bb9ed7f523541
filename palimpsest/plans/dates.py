"""Date expressions of report filters, read as runs of whole days of a calendar that is four hours behind UTC all year.

RULES lists every form an expression can have, each with what makes its days; what fits no rule, or names a day that no
calendar has, is ambiguous and rejected. A run is its first day and the day after its last; as instants it is half open.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import UTC, date, datetime, time, timedelta, timezone

ZONE = timezone(timedelta(hours=-4))
Days = tuple[date, date]

# Names that users write.
MONTHS = (
    ("enero", 1), ("febrero", 2), ("marzo", 3), ("abril", 4), ("mayo", 5), ("junio", 6), ("julio", 7), ("agosto", 8),
    ("septiembre", 9), ("setiembre", 9), ("octubre", 10), ("noviembre", 11), ("diciembre", 12),
)
FILLERS = ("de", "del", "el", "la", "los", "las", "en")


class AmbiguousDate(ValueError):
    """The expression names no single run of days."""


def month_number(day: date) -> int:
    """Months since the year 0, so that neighbours differ by one."""
    return day.year * 12 + day.month - 1


def months(number: int, n: int = 1) -> Days:
    """n months from that with the given number on."""
    first, after = (date(m // 12, m % 12 + 1, 1) for m in (number, number + n))
    return first, after


def run(first: date, n: int) -> Days:
    return first, first + timedelta(days=n)


def of_today(unit: str, shift: int) -> Callable[[re.Match, date], Days]:
    """The day, week, month or year of today, or as many before."""
    return {
        "day": lambda m, today: run(today + timedelta(days=shift), 1),
        "week": lambda m, today: run(date.fromordinal(today.toordinal() - today.weekday() + 7 * shift), 7),
        "month": lambda m, today: months(month_number(today) + shift),
        "year": lambda m, today: months((today.year + shift) * 12, 12),
    }[unit]


def named_month(m: re.Match, today: date) -> Days:
    """With a year, that year's; alone, the latest that has begun."""
    number = dict(MONTHS)[m["month"]] - 1
    latest = month_number(today) - (month_number(today) - number) % 12
    return months(int(m["year"]) * 12 + number if m["year"] else latest)


YEAR = "an(?:i?o)"
RULES: tuple[tuple[str, Callable[[re.Match, date], Days]], ...] = (
    ("hoy", of_today("day", 0)),
    ("ayer", of_today("day", -1)),
    ("esta_semana|semana_actual", of_today("week", 0)),
    ("semana_(?:pasada|anterior)", of_today("week", -1)),
    ("este_mes|mes_actual", of_today("month", 0)),
    ("mes_(?:pasado|anterior)", of_today("month", -1)),
    (f"este_{YEAR}|{YEAR}_actual", of_today("year", 0)),
    (f"{YEAR}_(?:pasado|anterior)", of_today("year", -1)),
    (r"ultimos?_(?P<n>\d{1,3})_dias", lambda m, today: run(today - timedelta(days=int(m["n"])), int(m["n"]) + 1)),
    (r"ultimos?_(?P<n>\d{1,2})_meses", lambda m, today: (months(month_number(today) - int(m["n"]))[0], today + timedelta(days=1))),
    (r"(?P<y>\d{4})", lambda m, today: months(int(m["y"]) * 12, 12)),
    (r"(?P<y>\d{4})_(?P<m>0?[1-9]|1[0-2])", lambda m, today: months(int(m["y"]) * 12 + int(m["m"]) - 1)),
    (r"(?P<y>\d{4})_(?P<m>\d{1,2})_(?P<d>\d{1,2})", lambda m, today: run(date(int(m["y"]), int(m["m"]), int(m["d"])), 1)),
    (rf"(?P<month>{'|'.join(name for name, _ in MONTHS)})(?:_(?P<year>\d{{4}}))?", named_month),
)


def plain(text: str) -> str:
    """Lower case without accents and filler words, parts joined by underscores."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return "_".join(w for w in re.split(r"[\s/_-]+", bare) if w and w not in FILLERS)


def days(expression: str, now: datetime) -> Days:
    """The run of days that an expression names."""
    text, today = plain(expression), now.astimezone(ZONE).date()
    for pattern, make in RULES:
        if m := re.fullmatch(pattern, text):
            try:
                return make(m, today)
            except (ValueError, OverflowError):  # a day or year that no calendar has
                break
    raise AmbiguousDate(expression)


def instants(of: Days) -> tuple[datetime, datetime]:
    """A run of days as a half-open range in UTC."""
    first, after = (datetime.combine(d, time(), ZONE).astimezone(UTC) for d in of)
    return first, after


def resolve(expression: str, now: datetime) -> tuple[datetime, datetime]:
    return instants(days(expression, now))


def describe(expression: str, of: Days) -> str:
    """The expression with the days that it was read as: a single one, or the first and the last."""
    ends = list(dict.fromkeys(f"{d:%d/%m/%Y}" for d in (of[0], of[1] - timedelta(days=1))))
    return f"{expression} ({ends[0] if len(ends) == 1 else 'del ' + ' al '.join(ends)})"
