"""Counts and summaries of one or two tables."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, isnan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayline.functions.windows import static_window, window_and_where
from drayline.operators.projection import free_name
from drayline.operators.reconcile import average, schema_diff, total
from drayline.session import local_rows


def filtered_count(df: DataFrame, window: Column | None = None, where: str | None = None) -> DataFrame:
    """Rows a transfer would extract; a row limit plays no part. This is also the dry run of a transfer."""
    rows = df.where(window_and_where(static_window() if window is None else window, where))
    return rows.agg(F.count(F.lit(1)).alias("row_count"))


@dataclass(frozen=True)
class Measure:
    """One output of a summary: ``rows``, ``total``, ``average``, ``least`` or ``greatest`` of a column where a condition
    holds. ``scale`` as in ``reconcile.total``."""

    name: str
    kind: str
    column: str | None = None
    when: Column | None = None
    scale: int | None = None

    def over(self, df: DataFrame) -> Column:
        if self.kind == "rows":
            return F.count(F.lit(1)) if self.when is None else F.count_if(self.when)
        # the condition is part of the input, so that every measure sees plain columns
        kinds = {"total": lambda d, c: total(d, c, self.scale), "average": lambda d, c: average(d, c, self.scale), "least": lambda d, c: F.min(c), "greatest": lambda d, c: F.max(c)}
        if self.kind not in kinds:
            raise ValueError(f"unknown measure {self.kind!r}")
        return kinds[self.kind](df, self.column if self.when is None else self.name)

    def input(self) -> Column | None:
        if self.kind == "rows" or self.when is None:
            return None
        return F.when(self.when, F.col(self.column)).alias(self.name)


def conditional_summary(df: DataFrame, measures: list[Measure]) -> DataFrame:
    """One row with the given measures, from one pass over ``df``."""
    inputs = [i for i in (m.input() for m in measures) if i is not None]
    rows = df.select("*", *inputs) if inputs else df
    return rows.agg(*[m.over(rows).alias(m.name) for m in measures])


def order_totals_by_owner(
    owners: DataFrame, owner_key: str, carry: list[str], orders: DataFrame, order_owner: str, order_key: str, amount: str,
    scale: int | None = None,
) -> DataFrame:
    """Every owner with order count and total, zero when there are none, by total descending.

    Orders are summed per owner before the join, with map-side combine, so an owner with very many orders
    costs no more than another and the join sees one row per owner on each side.
    """
    totals = orders.groupBy(F.col(order_owner).alias(owner_key)).agg(
        F.count(order_key).alias("orders_placed"), total(orders, amount, scale).alias("amount_ordered")
    )
    return (
        owners.select(owner_key, *carry)
        .join(totals, owner_key, "left")
        .select(
            owner_key,
            *carry,
            F.coalesce("orders_placed", F.lit(0)).cast("long").alias("orders_placed"),
            F.coalesce(F.col("amount_ordered").cast("double"), F.lit(0.0)).alias("amount_ordered"),
        )
        .orderBy(F.desc("amount_ordered"), owner_key)
    )


def schema_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """The schema difference of two tables, with the non-NULL count of each column on each side."""

    def filled(df: DataFrame, name: str) -> DataFrame:
        return column_stats(df).select("column_name", F.col("non_null_count").alias(name))

    return (
        schema_diff(source.sparkSession, source.schema, target.schema)
        .join(filled(source, "source_non_null"), "column_name", "left")
        .join(filled(target, "target_non_null"), "column_name", "left")
        .orderBy("column_name")
    )


def column_stats(df: DataFrame) -> DataFrame:
    """Type, non-NULL and NULL count of every column, in one pass."""
    every = free_name(df.columns, "_rows")
    counts = df.agg(F.count(F.lit(1)).alias(every), *[F.count(F.col(c)).alias(c) for c in df.columns])
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f.name).alias("non_null_count"),
                (F.col(every) - F.col(f.name)).alias("null_count"),
            )
            for f in df.schema
        ]
    )
    return counts.select(F.inline(entries))


#: Share of the rows on each side of a wanted percentile that is looked at; Spark's approximate percentiles are ten times closer.
PERCENTILE_MARGIN = 0.001


def _at_ranks(counts: list[tuple[int, int]], at: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """(rank, cell, rank within it) of the values that percentiles lie at or between, from the rows of each cell in order."""
    n = sum(rows for _, rows in counts)
    found = []
    for rank in sorted({int(f((n - 1) * p)) for p in at for f in (floor, ceil)}) if n else []:
        below = 0
        for cell, rows in counts:
            if rank < below + rows:
                found.append((rank, cell, rank - below))
                break
            below += rows
    return found


def exact_percentiles(df: DataFrame, columns: list[str], at: tuple[float, ...]) -> DataFrame:
    """``percentile`` of numeric columns: a row per column with its name and the array ``percentiles``, in the order of ``at``.

    Spark's own holds every distinct value in one task. Here approximate percentiles cut the values into cells, the rows of each cell are
    counted, and only the cells that hold a wanted rank are put in order. How close the cuts are decides how many rows these are, not the result.
    """
    around = sorted({min(1.0, max(0.0, p + m)) for p in at for m in (-PERCENTILE_MARGIN, PERCENTILE_MARGIN)})
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    found = doubles.agg(*[F.percentile_approx(f"v{i}", around, 10_000).alias(f"v{i}") for i in range(len(columns))]).first()
    cuts = [sorted({v for v in f or () if not isnan(v)}) for f in found]
    parts = []
    for i, some in enumerate(cuts):
        above = [F.when(F.col(f"v{i}") >= v, F.lit(1)).otherwise(F.lit(0)) for v in some]
        parts.append(F.struct(F.lit(i).alias("number"), sum(above, F.lit(0)).alias("cell"), F.col(f"v{i}").alias("value")))
    values = doubles.select(F.explode(F.array(*parts)).alias("c")).select("c.*").where("value is not null")
    counted: list[list[tuple[int, int]]] = [[] for _ in columns]
    for r in values.groupBy("number", "cell").count().collect():
        counted[r["number"]].append((r["cell"], r["count"]))
    ranks = [_at_ranks(sorted(c), at) for c in counted]
    wanted = [(i, cell, place, rank) for i, some in enumerate(ranks) for rank, cell, place in some]
    cells = sorted({(i, cell) for i, cell, _, _ in wanted})
    near = values.where(F.struct("number", "cell").isin([F.struct(F.lit(i), F.lit(c)) for i, c in cells])) if cells else values.limit(0)
    upto = Window.partitionBy("number", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = near.groupBy("number", "cell", "value").count().withColumn("until", F.sum("count").over(upto))
    here = [
        F.min(F.when((F.col("number") == i) & (F.col("cell") == cell) & (F.col("until") > place), F.col("value"))).alias(f"r{k}") for k, (i, cell, place, _) in enumerate(wanted)
    ]
    values_at = dict(zip([(i, rank) for i, _, _, rank in wanted], placed.agg(*here).first())) if here else {}
    rows = []
    for i, name in enumerate(columns):
        n = sum(c for _, c in counted[i])
        rows.append((name, [_between(values_at, i, (n - 1) * p) for p in at] if n else [None] * len(at)))
    return local_rows(df.sparkSession, rows, "column_name string, percentiles array<double>")


def _between(values: dict[tuple[int, int], float], i: int, position: float) -> float:
    lower, higher = floor(position), ceil(position)
    a, b = values[i, lower], values[i, higher]
    return a if a == b or isnan(a) and isnan(b) else (higher - position) * a + (position - lower) * b
