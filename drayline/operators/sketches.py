"""Column profiles that add up: counts, distinct-count sketches and quantile sketches made while rows are written, merged later.

Distinct counts are HyperLogLog sketches of ``2 ** LG_REGISTERS`` registers (relative standard error about 1.04 / sqrt of that, 1.6 %);
quantiles are KLL sketches with ``KLL_SIZE`` items a level (rank error about 1.3 % at 200). Both are Spark's own aggregates, and merge without
loss beyond these bounds. A sketch has a bounded size whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.evolution import FIELD_ID, field_id

LG_REGISTERS = 12
KLL_SIZE = 200
QUANTILES = (0.25, 0.5, 0.75)


def _distinct_value(field: T.StructField) -> Column:
    """A value that is equal where the column's is, also after its type was widened: numbers as double or decimal text."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.NumericType):
        number = c.cast("double")
        whole = c.cast("decimal(38,0)") if not isinstance(field.dataType, (T.FloatType, T.DoubleType)) else number
        return F.when(whole.cast("double") == number, number.cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def column_sketches(schema: T.StructType) -> dict[str, Column]:
    """Aggregates to take of rows while they are written, as text, by name. Numbers that are not finite have no place in quantiles."""
    found = {}
    for f in schema.fields:
        c, i = F.col(f"`{f.name}`"), field_id(f)
        found[f"n{i}"] = F.count(c).cast("string")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType)):
            continue
        found[f"d{i}"] = F.base64(F.hll_sketch_agg(_distinct_value(f), F.lit(LG_REGISTERS)))
        if _is_number(f):
            number = c.cast("double")
            finite = F.when(F.abs(number) < F.lit(float("inf")), number)
            found[f"l{i}"] = F.min(finite).cast("string")
            found[f"g{i}"] = F.max(finite).cast("string")
            found[f"q{i}"] = F.base64(F.kll_sketch_agg_double(finite, F.lit(KLL_SIZE)))
    return found


def sketch_rows(schema: T.StructType, rows: int, taken: dict[str, str | None]) -> list[tuple]:
    """The taken aggregates as rows of ``PROFILE``."""
    import base64

    def binary(name: str) -> bytes | None:
        return None if taken.get(name) is None else base64.b64decode(taken[name])

    def number(name: str) -> float | None:
        return None if taken.get(name) is None else float(taken[name])

    out = []
    for f in schema.fields:
        i = field_id(f)
        out.append((i, rows, int(taken[f"n{i}"]), binary(f"d{i}"), number(f"l{i}"), number(f"g{i}"), binary(f"q{i}")))
    return out


def merged_profile(parts: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per column of the schema, from any number of partial profiles: rows, non-NULL values, an estimate of the distinct ones,
    least, greatest and quartiles of numbers. A column that a part does not know was NULL in its rows."""
    total = parts.groupBy("part").agg(F.max("rows").alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    merged = parts.groupBy("field_id").agg(
        F.sum("non_null").alias("non_null_count"),
        F.hll_union_agg("distinct_sketch").alias("d"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("quantile_sketch").alias("q"),
    )
    names = F.create_map(*[F.lit(x) for f in schema.fields for x in (f.metadata[FIELD_ID], f.name)])
    known = merged.withColumn("column_name", names[F.col("field_id")]).where(F.col("column_name").isNotNull())
    quartiles = [
        F.when(F.col("greatest").isNotNull(), F.kll_sketch_get_quantile_double("q", F.lit(p))).alias(f"quantile_{int(p * 100)}") for p in QUANTILES
    ]
    rows = total.scalar()
    return known.select(
        "column_name",
        rows.alias("rows"),
        "non_null_count",
        (rows - F.col("non_null_count")).alias("null_count"),
        F.hll_sketch_estimate("d").alias("distinct_estimate"),
        "least",
        "greatest",
        *quartiles,
    )
