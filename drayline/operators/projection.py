"""Projections, casts, fills, ordering and limits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.scalars import contains_ci
from drayline.functions.types import Field, canonical, required_default
from drayline.functions.windows import window_and_where


def free_name(taken: Iterable[str], wanted: str) -> str:
    """A column name like ``wanted`` that none of the given ones has, in whatever case."""
    names = {t.lower() for t in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def extract(
    df: DataFrame,
    window: Column,
    where: str | None = None,
    columns: list[str] | None = None,
    limit: int | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Window, then the caller's predicate, then column choice, then the row limit."""
    rows = df.where(window_and_where(window, where))
    rows = rows.select(*columns) if columns else rows
    return rows if limit is None else row_limit(rows, limit, order_by)


def project_filter_sort(df: DataFrame, columns: dict[str, str], where: str, order_by: list[Column]) -> DataFrame:
    """``columns`` maps each output name to an expression over the input."""
    return df.where(where).select([F.expr(e).alias(n) for n, e in columns.items()]).orderBy(*order_by)


def canonicalise(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Every declared column cast to its canonical type in one projection."""
    stored = {f.name: f.dataType for f in df.schema}
    return df.select([canonical(F.col(f.name), f, stored[f.name]) for f in fields])


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Target columns in target order and type: a missing one is NULL, an extra one is dropped.

    Names match as Spark and databases match them, in any letter case, the same spelling first. A target name that
    several columns differ from only in case is an error.
    """
    spelled: dict[str, list[str]] = {}
    for name in df.columns:
        spelled.setdefault(name.lower(), []).append(name)

    def source(name: str) -> Column:
        found = spelled.get(name.lower(), [])
        if len(found) > 1:
            raise ValueError(f"{name!r} could be any of the columns {found}")
        return F.col(f"`{found[0]}`") if found else F.lit(None)

    return df.select([source(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def fill_required(df: DataFrame, fields: list[Field]) -> DataFrame:
    """NULL in a required column becomes that type's default; an optional column keeps its NULLs."""
    required = {f.name: f for f in fields if f.required}
    return df.select(
        [F.coalesce(F.col(c), required_default(required[c])).alias(c) if c in required else F.col(c) for c in df.columns]
    )


def to_utc(column: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` as zone-free UTC time."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), column)


def row_limit(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """Any ``n`` rows, or the first ``n`` in an order.

    The same plan for every ``n``: each task stops after ``n`` rows, and a database whose dialect has limits is asked for no
    more. The rows of the result then pass through one task, a row at a time.
    """
    if n <= 0:
        raise ValueError("a row limit must be positive")
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def ordered(df: DataFrame, by: list[Column]) -> DataFrame:
    """Global order. End ``by`` with a unique column, so that equal leading values still split over tasks."""
    return df.orderBy(*by)


def top_n(df: DataFrame, n: int, by: list[Column]) -> DataFrame:
    if n <= 0:
        raise ValueError("top-n needs a positive n")
    return df.orderBy(*by).limit(n)


def contains_top_k(df: DataFrame, column: str, text: str, k: int = 5) -> DataFrame:
    """Values that contain ``text`` in any case, shortest first, then by name."""
    return df.where(contains_ci(F.col(column), text)).orderBy(F.length(column), column).limit(k)
