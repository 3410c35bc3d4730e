"""Change dedup and the append and upsert merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayline.operators.projection import align, free_name

# Merge mode names.
MERGE_MODES = ("append", "upsert")


def merge_mode(name: str) -> str:
    mode = name.lower()
    if mode not in MERGE_MODES:
        raise ValueError(f"merge mode {name!r} is not one of {MERGE_MODES}")
    return mode


def latest_per_key(df: DataFrame, key: list[str], by: str, ties: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``by`` per key; ties fall to the greatest remaining columns.

    The rank filter is applied before the shuffle as well (a partial window group limit), so a key that holds
    a large share of the rows sends at most one row per map task.
    """
    rest = ties if ties is not None else [c for c in df.columns if c not in key and c != by]
    order = [F.desc_nulls_last(c) for c in [by, *rest]]
    rank, name = F.row_number().over(Window.partitionBy(*key).orderBy(*order)), free_name(df.columns, "_rank")
    return df.withColumn(name, rank).where(F.col(name) == 1).drop(name)


def is_newer(mark: Column, than: Column) -> Column:
    """Whether one mark is above another; a NULL mark is below all others. Never NULL."""
    return F.coalesce(mark > than, mark.isNotNull() & than.isNull())


def stale_keys(target: DataFrame, changes: DataFrame, key: list[str], by: str) -> DataFrame:
    """Keys of the changes whose row in the target has a higher ``by``. Two columns of the target are read, besides the key's."""
    stored, arriving = free_name([*key, by], "_stored"), free_name([*key, by], "_arriving")
    both = changes.select(*key, F.col(by).alias(arriving)).join(target.select(*key, F.col(by).alias(stored)), key)
    return both.where(is_newer(F.col(stored), F.col(arriving))).select(*key)


def has_null_key(key: list[str]) -> Column:
    condition = F.lit(False)
    for c in key:
        condition = condition | F.col(c).isNull()
    return condition


def reject_null_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Fail the job on a NULL key, without an extra pass."""
    first, *rest = key
    checked = F.when(has_null_key(key), F.raise_error(F.lit(f"NULL in merge key {key}"))).otherwise(F.col(first))
    return df.withColumn(first, checked)


def new_rows(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Changes whose key the target lacks. A NULL key matches nothing and counts as new."""
    return changes.join(target.select(*key), key, "left_anti").select(changes.columns)


def merge_append(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Insert new keys only; existing rows are never touched."""
    aligned = align(changes, target.schema)
    return target.unionByName(new_rows(target, aligned, key))


def merge_upsert(target: DataFrame, changes: DataFrame, key: list[str], latest_by: str | None = None) -> DataFrame:
    """Replace rows whose key is in ``changes`` and add the others. Nothing is deleted.

    ``changes`` holds one row per key (see ``latest_per_key``). With ``latest_by`` a row whose stored version has a higher
    value stays as it is; at equal values the change replaces it, and NULL is below all. Adaptive execution
    broadcasts the changed keys when they turn out small, and otherwise splits a skewed target partition.
    """
    aligned = align(changes, target.schema)
    if latest_by:
        aligned = aligned.join(stale_keys(target, aligned, key, latest_by), key, "left_anti").select(target.columns)
    kept = target.join(aligned.select(*key), key, "left_anti").select(target.columns)
    return kept.unionByName(aligned)


def merge(target: DataFrame, changes: DataFrame, key: list[str], mode: str, latest_by: str | None = None) -> DataFrame:
    """Either merge; ``latest_by`` first keeps the newest change of each key, and lets an upsert skip older ones."""
    changes = latest_per_key(changes, key, latest_by) if latest_by else changes
    return merge_upsert(target, changes, key, latest_by) if merge_mode(mode) == "upsert" else merge_append(target, changes, key)


def merge_action_counts(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """INSERT and UPDATE row counts of an upsert. A match counts as UPDATE even when nothing differs."""
    name = free_name(key, "_present")
    present = target.select(*key).withColumn(name, F.lit(True))
    action = F.when(F.col(name), F.lit("UPDATE")).otherwise(F.lit("INSERT"))
    joined = changes.select(*key).join(present, key, "left")
    return joined.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("row_count"))
