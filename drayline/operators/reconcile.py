"""Source-to-target comparison: counts, rows, NULLs, ranges and schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.operators.merge import has_null_key
from drayline.operators.projection import free_name
from drayline.session import local_rows

MATCH, MISMATCH = "MATCH", "MISMATCH"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def count_of(df: DataFrame, label: str, name: str = "table_name") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(label).alias(name), "row_count")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([count_of(df, name) for name, df in tables.items()])


def verify_counts(source: dict[str, DataFrame | None], target: dict[str, DataFrame | None]) -> DataFrame:
    """Per table: both counts, ``difference`` = target - source, status and message.

    A side that is None is unknown: its count, the difference and the message are NULL and nothing matches.
    """
    counts = [
        count_of(df, name).withColumn("side", F.lit(side))
        for side, tables in (("source", source), ("target", target))
        for name, df in tables.items()
        if df is not None
    ]
    if not counts:
        raise ValueError("nothing to count on either side")
    per_side = union_all(counts).groupBy("table_name").pivot("side", ["source", "target"]).agg(F.first("row_count"))
    s, t = F.col("source"), F.col("target")
    matched = F.coalesce(s == t, F.lit(False))
    message = F.when(matched, F.concat(F.lit("row counts match: "), s.cast("string"))).when(
        s.isNotNull() & t.isNotNull(),
        F.concat(
            F.lit("row counts differ: source="), s.cast("string"), F.lit(", target="), t.cast("string"),
            F.lit(", difference="), (t - s).cast("string"),
        ),
    )
    return per_side.select(
        "table_name",
        s.alias("source_count"),
        t.alias("target_count"),
        (t - s).alias("difference"),
        F.when(matched, MATCH).otherwise(MISMATCH).alias("status"),
        message.alias("message"),
    )


def reconcile_rows(
    source: DataFrame,
    target: DataFrame,
    key: list[str],
    compare: list[str],
    null_safe: bool = False,
) -> DataFrame:
    """Full outer comparison by key: both sides' values per compared column, and MATCH or MISMATCH.

    A missing side is a mismatch, and so is a NULL in a compared column unless ``null_safe``.

    Rows of both sides are grouped by their whole content, which is one shuffle with map-side combine where
    equal rows collapse (into one row with counts) and a repeated key spreads by content. Only rows that found
    no equal partner are then looked at by key: one on each side makes a pair. Where a key has several left over,
    each comes out for its own side, instead of in all pairs. NULL keys equal nothing, so such rows are
    mismatches on their own.
    """
    columns = [*key, *compare]
    in_s, in_t, no_key, one_s, one_t = (free_name(columns, n) for n in ("_s", "_t", "_null_key", "_source", "_target"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    sides = source.select(*columns, one.alias(in_s), zero.alias(in_t)).unionByName(
        target.select(*columns, zero.alias(in_s), one.alias(in_t))
    )
    # The NULL test is an aggregate so that no branch below filters ahead of the shuffle: all read the same one.
    contents = sides.groupBy(*columns).agg(
        F.sum(in_s).alias(in_s), F.sum(in_t).alias(in_t), F.bool_or(has_null_key(key)).alias(no_key)
    )
    s, t, null_key = F.col(in_s), F.col(in_t), F.col(no_key)

    def both(value) -> list[Column]:
        return [value(c, side) for c in compare for side in ("source", "target")]

    has_null = reduce(lambda a, c: a | F.col(c).isNull(), compare, F.lit(False))
    equal = F.lit(True) if null_safe else ~has_null
    paired = F.least(s, t)
    matched = contents.where(~null_key & (s > 0) & (t > 0)).select(
        *key,
        *both(lambda c, side: F.col(c).alias(f"{c}_{side}")),
        paired.alias("source_rows"),
        paired.alias("target_rows"),
        F.when(equal, MATCH).otherwise(MISMATCH).alias("status"),
    )

    left_s, left_t = F.greatest(s - t, zero), F.greatest(t - s, zero)
    leftover = contents.where(~null_key & (s != t)).select(*columns, left_s.alias(in_s), left_t.alias(in_t))
    row = F.struct(*compare)
    differing = leftover.groupBy(*key).agg(
        F.max(F.when(s > 0, row)).alias(one_s),
        F.max(F.when(t > 0, row)).alias(one_t),
        F.sum(in_s).alias("source_rows"),
        F.sum(in_t).alias("target_rows"),
    )
    single = (F.col("source_rows") <= 1) & (F.col("target_rows") <= 1)
    pairs = differing.where(single).select(
        *key,
        *both(lambda c, side: F.col(one_s if side == "source" else one_t)[c].alias(f"{c}_{side}")),
        "source_rows",
        "target_rows",
        F.lit(MISMATCH).alias("status"),
    )

    def one_sided(rows: DataFrame) -> DataFrame:
        return rows.select(
            *key,
            *both(lambda c, side: F.when((s if side == "source" else t) > 0, F.col(c)).alias(f"{c}_{side}")),
            s.alias("source_rows"),
            t.alias("target_rows"),
            F.lit(MISMATCH).alias("status"),
        )

    repeated = leftover.join(differing.where(~single).select(*key), key, "left_semi")
    return union_all([matched, pairs, one_sided(repeated), one_sided(contents.where(null_key))])


def reconcile_inner(source: DataFrame, target: DataFrame, key: list[str], compare: list[str], null_safe: bool = False) -> DataFrame:
    """The rows of ``reconcile_rows`` that have a partner on the other side."""
    rows = reconcile_rows(source, target, key, compare, null_safe)
    return rows.where(~has_null_key(key) & (F.col("source_rows") > 0) & (F.col("target_rows") > 0))


def _sides(source: DataFrame, target: DataFrame, summary) -> DataFrame:
    return union_all(
        [df.agg(*summary(df)).select(F.lit(side).alias("side"), "*") for side, df in (("source", source), ("target", target))]
    )


def null_counts_compare(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column, one row per side, one pass over each."""
    return _sides(source, target, lambda df: [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def total(df: DataFrame, column: str, scale: int | None = None) -> Column:
    """The sum of a column in a type that holds it: decimals as decimals, integers exactly, floating point as double.

    Sums of doubles depend on the order of addition in their last digits; with a ``scale`` every value is first taken
    as a decimal with so many digits after the point, which makes the sum independent of it.
    """
    kind = df.schema[column].dataType
    c = F.col(column)
    if scale is not None:
        return F.sum(c.cast(T.DecimalType(38, scale)))
    if isinstance(kind, T.IntegralType):
        return F.sum(c.cast(T.DecimalType(38, 0)))
    return F.sum(c) if isinstance(kind, T.DecimalType) else F.sum(c.cast("double"))


def average(df: DataFrame, column: str, scale: int | None = None) -> Column:
    """The average as double, from the same sum; NULL without values."""
    return total(df, column, scale).cast("double") / F.count(column)


def range_compare(source: DataFrame, target: DataFrame, numbers: list[str], times: list[str]) -> DataFrame:
    """Min, max and average of numbers and min and max of times, one row per side."""

    def summary(df: DataFrame) -> list[Column]:
        of_numbers = [a for c in numbers for a in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), average(df, c).alias(f"avg_{c}"))]
        return of_numbers + [a for c in times for a in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]

    return _sides(source, target, summary)


COLUMN_SCHEMA = "column_name string, data_type string, is_nullable boolean"


def schema_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Column names, types with their arguments, and nullability. Only metadata."""
    return local_rows(spark, [(f.name, f.dataType.simpleString(), f.nullable) for f in schema], COLUMN_SCHEMA)


def schema_diff(spark: SparkSession, source: T.StructType, target: T.StructType) -> DataFrame:
    """Per column name: both types and ``ok``, ``type_diff``, ``missing_in_source`` or ``missing_in_target``."""
    s = schema_frame(spark, source).select("column_name", F.col("data_type").alias("source_type"))
    t = schema_frame(spark, target).select("column_name", F.col("data_type").alias("target_type"))
    verdict = (
        F.when(F.col("target_type").isNull(), "missing_in_target")
        .when(F.col("source_type").isNull(), "missing_in_source")
        .when(F.col("source_type") == F.col("target_type"), "ok")
        .otherwise("type_diff")
    )
    return s.join(t, "column_name", "full_outer").withColumn("status", verdict)
