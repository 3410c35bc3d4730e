"""Extraction windows. Each returns a boolean Column, so the scan below can prune and push down."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Day = date | datetime | str


def as_day(value: Day) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.strptime(value[:10], "%Y-%m-%d").date()


def midnight(value: Day) -> Column:
    """Midnight as a literal that takes the type of the column it is compared with.

    Date, zone-free and zoned columns all stay uncast, so the comparison reaches Parquet and JDBC scans. A text column
    compares as ISO text, in which a bare day comes before all times of that day.
    """
    return F.lit(as_day(value).isoformat())


def date_window(column: str, start: Day, end: Day, end_inclusive_day: bool = False) -> Column:
    """One day is half-open; a range ends at midnight of its last day, that instant included.

    ``end_inclusive_day`` takes the whole last day instead.
    """
    first, last = as_day(start), as_day(end)
    if last < first:
        raise ValueError(f"window ends before it starts: {first} > {last}")
    c = F.col(column)
    if first == last or end_inclusive_day:
        return (c >= midnight(first)) & (c < midnight(last + timedelta(days=1)))
    return (c >= midnight(first)) & (c <= midnight(last))


#: Pattern letters of a date format, longest first, and their strftime form.
DATE_LETTERS = {"yyyy": "%Y", "yy": "%y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}


def int_date_value(value: Day, fmt: str = "yyyyMMdd") -> int:
    """The day (at midnight) in a format of numeric pattern letters, as a number; other characters stand for themselves."""
    text, at = "", 0
    day = as_day(value)
    while at < len(fmt):
        letters = next((k for k in DATE_LETTERS if fmt.startswith(k, at)), fmt[at])
        text += datetime(day.year, day.month, day.day).strftime(DATE_LETTERS[letters]) if letters in DATE_LETTERS else letters
        at += len(letters)
    if not text.isdigit():
        raise ValueError(f"the date format {fmt!r} does not give a number: {text!r}")
    return int(text)


def int_date_window(column: str, start: Day, end: Day, fmt: str = "yyyyMMdd") -> Column:
    low, high = int_date_value(start, fmt), int_date_value(end, fmt)
    if high < low:
        raise ValueError(f"window ends before it starts: {low} > {high}")
    c = F.col(column)
    return c == F.lit(low) if low == high else c.between(low, high)


def scd2_window(effective: str, start: Day, end: Day, expiration: str = "ExpirationDate") -> Column:
    """Versions that began inside the window and are still open at its end."""
    began = F.col(effective).between(midnight(start), midnight(end))
    still_open = F.col(expiration).isNull() | (F.col(expiration) > midnight(end))
    return began & still_open


def static_window() -> Column:
    return F.lit(True)


def _need(value: str | None, kind: str, what: str) -> str:
    if not value:
        raise ValueError(f"a {kind} window needs {what}")
    return value


def make_window(
    kind: str,
    column: str | None = None,
    start: Day | None = None,
    end: Day | None = None,
    fmt: str = "yyyyMMdd",
    effective: str | None = None,
    expiration: str = "ExpirationDate",
) -> Column:
    """Pick a window by type name. Windowed kinds need their column and both dates."""
    kind = kind.lower()
    if kind == "static":
        return static_window()
    builders: dict[str, Callable[[], Column]] = {
        "date": lambda: date_window(_need(column, kind, "a column"), start, end),
        "int_date": lambda: int_date_window(_need(column, kind, "a column"), start, end, fmt),
        "scd2": lambda: scd2_window(_need(effective, kind, "an effective date column"), start, end, expiration),
    }
    if kind not in builders:
        raise ValueError(f"unknown window type {kind!r}")
    if start is None or end is None:
        raise ValueError(f"a {kind} window needs a start and an end date")
    return builders[kind]()


def window_and_where(window: Column, where: str | None = None) -> Column:
    """The window AND the caller's predicate, which is taken as one unit whatever ORs it holds."""
    if where is None or not where.strip():
        return window
    return window & F.expr(f"({where})")
