"""Scalar helpers over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_parts(column: Column) -> list[Column]:
    """Zero-padded ``year``, ``month`` and ``day`` texts, the directory names of a dated dataset."""
    return [
        F.date_format(column, "yyyy").alias("year"),
        F.date_format(column, "MM").alias("month"),
        F.date_format(column, "dd").alias("day"),
    ]


def partition_path(column: Column) -> Column:
    year, month, day = date_parts(column)
    return F.concat(F.lit("year="), year, F.lit("/month="), month, F.lit("/day="), day)


def int_date(column: Column, fmt: str = "yyyyMMdd") -> Column:
    return F.date_format(column, fmt).cast("int")


def iso_text(column: Column) -> Column:
    """ISO-8601 text with microseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def epoch_days(column: Column) -> Column:
    return F.unix_date(column.cast("date"))


def add_days(column: Column, days: int) -> Column:
    """Whole-day shift; the time of day is cut off."""
    return F.date_add(column.cast("date"), days)


def contains_ci(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def ends_with_ci(column: Column, text: str) -> Column:
    return F.endswith(F.lower(column), F.lit(text.lower()))


def equals_ci(column: Column, text: str) -> Column:
    return F.lower(column) == F.lit(text.lower())


def is_one_of_ci(column: Column, names: tuple[str, ...]) -> Column:
    return F.lower(column).isin([n.lower() for n in names])
