"""Schemas that change: every field has an id for good, and rows written under an older schema are read by it.

An id is given once, is kept when its field is renamed or widened, and is never given again. So a renamed column finds its older
values, and a column that takes over a former name does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_ID = "drayline.field_id"

#: Integer types from narrow to wide, and the digits each may need.
INTEGRAL = ("byte", "short", "integer", "long")
DIGITS = {"byte": 3, "short": 5, "integer": 10, "long": 19}


def field_id(field: T.StructField) -> int:
    return field.metadata[FIELD_ID]


def _with_id(field: T.StructField, number: int) -> T.StructField:
    return T.StructField(field.name, field.dataType, True, {**field.metadata, FIELD_ID: number})


def with_field_ids(schema: T.StructType) -> tuple[T.StructType, int]:
    """A first schema: ids from 1 in order of the columns, and the last id given."""
    fields = [_with_id(f, i + 1) for i, f in enumerate(schema.fields)]
    return T.StructType(fields), len(fields)


def is_wider(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of the old type is one of the new type."""
    a, b = old.typeName(), new.typeName()
    if a in INTEGRAL and b in INTEGRAL:
        return INTEGRAL.index(a) <= INTEGRAL.index(b)
    if isinstance(new, T.DecimalType):
        if a in INTEGRAL:
            return new.precision - new.scale >= DIGITS[a]
        return isinstance(old, T.DecimalType) and new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    if b == "double":
        return a in ("byte", "short", "integer", "float", "double")
    return old == new or (a, b) == ("date", "timestamp_ntz")


def evolved(
    schema: T.StructType, last: int, add: list[T.StructField] = (), rename: dict[str, str] | None = None, widen: dict[str, T.DataType] | None = None
) -> tuple[T.StructType, int]:
    """The schema after renaming, then widening (by the new names), then adding columns at the end; and the last id given."""
    rename, widen = rename or {}, widen or {}
    for name in rename:
        if name not in schema.names:
            raise ValueError(f"no column {name!r} to rename")
    fields = [T.StructField(rename.get(f.name, f.name), f.dataType, True, f.metadata) for f in schema.fields]
    known = {f.name for f in fields}
    for name in widen:
        if name not in known:
            raise ValueError(f"no column {name!r} to widen")
    for i, f in enumerate(fields):
        if f.name in widen:
            if not is_wider(f.dataType, widen[f.name]):
                raise ValueError(f"{f.name!r}: {widen[f.name].simpleString()} does not hold all values of {f.dataType.simpleString()}")
            fields[i] = T.StructField(f.name, widen[f.name], True, f.metadata)
    for f in add:
        last += 1
        fields.append(_with_id(f, last))
    lowered = [f.name.lower() for f in fields]
    for name in lowered:
        if lowered.count(name) > 1:
            raise ValueError(f"several columns would be called {name!r}")
    return T.StructType(fields), last


def changes_for(schema: T.StructType, arriving: T.StructType) -> tuple[list[T.StructField], dict[str, T.DataType]]:
    """What to add and to widen so that the schema holds the arriving columns. A type that neither holds the other is an error."""
    stored = {f.name.lower(): f for f in schema.fields}
    add, widen = [], {}
    for f in arriving.fields:
        held = stored.get(f.name.lower())
        if held is None:
            add.append(f)
        elif not is_wider(f.dataType, held.dataType):
            if not is_wider(held.dataType, f.dataType):
                raise ValueError(f"{f.name!r} is {held.dataType.simpleString()} and arrives as {f.dataType.simpleString()}")
            widen[held.name] = f.dataType
    return add, widen


def as_current(written: T.StructType, current: T.StructType) -> list[Column]:
    """Columns of rows written under one schema, in terms of another: found by id, cast where widened, NULL where added since."""
    by_id = {field_id(f): f.name for f in written.fields}
    return [
        (F.col(f"`{by_id[field_id(f)]}`") if field_id(f) in by_id else F.lit(None)).cast(f.dataType).alias(f.name) for f in current.fields
    ]
