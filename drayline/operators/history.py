"""Versions over time and differences between states.

A hot key is never one group of one task: rows are taken by key and a bucket of time, and what crosses from one bucket of a key
to the next goes through a row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drayline.operators.merge import has_null_key, latest_per_key
from drayline.operators.projection import free_name

VALID_FROM, VALID_TO, CHANGE = "valid_from", "valid_to", "change"
INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _names(columns: list[str], *wanted: str) -> list[str]:
    found: list[str] = []
    for w in wanted:
        found.append(free_name([*columns, *found], w))
    return found


def _reject_names(columns: list[str], *reserved: str) -> None:
    for name in reserved:
        if name in (c.lower() for c in columns):
            raise ValueError(f"the column name {name!r} is reserved")


def validity_intervals(log: DataFrame, key: list[str], at: str, bucket: str = "month") -> DataFrame:
    """One row per version of a key and the time it held: the columns of the log but ``at``, ``valid_from`` and ``valid_to`` (not included;
    NULL for the version in force).

    A version that is sent again unchanged goes on; one that returns after another is a new interval. Of several rows of a key at one time
    the one with the greatest other columns counts. Rows without a time or with a NULL in their key are left out. ``bucket`` is a
    unit of ``date_trunc``: a key's rows of one such unit are sorted in one task.
    """
    _reject_names(log.columns, VALID_FROM, VALID_TO)
    payload = [c for c in log.columns if c not in key and c != at]
    b, row, before, after, pad = _names(log.columns, "_bucket", "_row", "_before", "_after", "_pad")
    timed = log.where(F.col(at).isNotNull() & ~has_null_key(key))
    latest = latest_per_key(timed, [*key, at], payload[0], payload[1:]) if payload else timed.dropDuplicates([*key, at])
    rows = latest.select(*key, at, F.struct(*payload, F.lit(0).alias(pad)).alias(row), F.date_trunc(bucket, F.col(at)).alias(b))
    inside = Window.partitionBy(*key, b).orderBy(at)
    rows = rows.withColumn(before, F.lag(row).over(inside)).where(~F.col(row).eqNullSafe(F.col(before)))
    # The last version of the bucket before, for the first row of each.
    over = Window.partitionBy(*key).orderBy(b)
    ends = rows.groupBy(*key, b).agg(F.max_by(row, at).alias(before))
    rows = rows.drop(before).join(ends.withColumn(before, F.lag(before).over(over)), [*key, b], "left")
    first = F.row_number().over(inside) == 1
    rows = rows.withColumn(after, first).where(~(F.col(after) & F.col(row).eqNullSafe(F.col(before)) & F.col(before).isNotNull())).drop(before, after)
    # Where the next version begins, in this bucket or a later one.
    begins = rows.groupBy(*key, b).agg(F.min(at).alias(after))
    rows = rows.join(begins.withColumn(after, F.lead(after).over(over)), [*key, b], "left")
    until = F.coalesce(F.lead(at).over(inside), F.col(after))
    return rows.select(*key, *[F.col(row)[c].alias(c) for c in payload], F.col(at).alias(VALID_FROM), until.alias(VALID_TO))


def as_of_join(facts: DataFrame, versions: DataFrame, key: list[str], at: str, bucket: str = "day") -> DataFrame:
    """Facts with the columns of the version of their key that held at ``at``; NULL where none did.

    ``versions`` has ``valid_from`` and ``valid_to`` and no overlapping intervals of a key. Facts and beginnings of versions of a key
    are sorted together, by buckets of time; each bucket takes in the last version before it. No pairs of facts and versions are formed.
    A fact without a time, or with a NULL in its key, finds no version.
    """
    kept = [c for c in versions.columns if c not in key]
    clash = [c for c in kept if c.lower() in (f.lower() for f in facts.columns)]
    if clash:
        raise ValueError(f"facts have the columns {clash} too")
    b, t, fact, version, carried = _names(facts.columns + versions.columns, "_bucket", "_time", "_fact", "_version", "_carried")
    none = F.lit(None)
    begun = versions.where(~has_null_key(key)).select(*key, F.col(VALID_FROM).alias(t), F.struct(*kept).alias(version))
    asked = facts.select(*key, F.col(at).alias(t), F.struct(*facts.columns).alias(fact))
    both = begun.withColumn(fact, none.cast(asked.schema[fact].dataType)).unionByName(asked.withColumn(version, none.cast(begun.schema[version].dataType)))
    both = both.withColumn(b, F.date_trunc(bucket, F.col(t)))
    states = both.groupBy(*key, b).agg(F.max_by(version, F.when(F.col(version).isNotNull(), F.col(t))).alias(carried))
    earlier = Window.partitionBy(*key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn(carried, F.last(carried, ignorenulls=True).over(earlier))
    # At one time a version comes before the facts.
    inside = Window.partitionBy(*key, b).orderBy(F.col(t), F.col(fact).isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.join(states, [*key, b], "left").withColumn(version, F.coalesce(F.last(version, ignorenulls=True).over(inside), F.col(carried)))
    holds = ~has_null_key(key) & F.col(t).isNotNull() & (F.col(version)[VALID_TO].isNull() | (F.col(version)[VALID_TO] > F.col(t)))
    return met.where(F.col(fact).isNotNull()).select(
        f"{fact}.*", *[F.when(holds, F.col(version)[c]).alias(c) for c in kept]
    )


def state_difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """What turns one state into the other: rows of ``after`` with ``change`` insert or update, and of ``before`` with delete.

    Keys are unique and not NULL; rows that are equal in all columns, NULLs included, are no change. Columns are those of ``before``.
    """
    _reject_names(before.columns, CHANGE)
    columns = before.columns
    old, new = _names(columns, "_old", "_new")
    a = before.select(*key, F.struct(*columns).alias(old))
    z = after.select(*key, F.struct(*columns).alias(new))
    both = a.join(z, key, "full_outer")
    change = F.when(F.col(old).isNull(), INSERT).when(F.col(new).isNull(), DELETE).when(~F.col(old).eqNullSafe(F.col(new)), UPDATE)
    return both.select(F.coalesce(new, old).alias(new), change.alias(CHANGE)).where(F.col(CHANGE).isNotNull()).select(f"{new}.*", CHANGE)


def apply_difference(before: DataFrame, feed: DataFrame, key: list[str]) -> DataFrame:
    """The later state: rows of changed keys are replaced, those of deleted ones go."""
    kept = before.join(feed.select(*key), key, "left_anti").select(before.columns)
    return kept.unionByName(feed.where(F.col(CHANGE) != DELETE).select(before.columns))


def log_difference(log, key: list[str], by: str, first: int, last: int) -> DataFrame:
    """The net changes of a snapshot table's keys from one snapshot to a later one; an audit log has no deletes.

    Only rows added in between are compared, with the rows of their keys before.
    """
    columns = log.schema().names
    _reject_names(columns, CHANGE)
    added = latest_per_key(log.read_between(first + 1, last), key, by)
    stored = log.read_as_of(first).join(added.select(*key), key, "left_semi").select(columns)
    before = latest_per_key(stored, key, by)
    return state_difference(before, latest_per_key(before.unionByName(added), key, by), key)
