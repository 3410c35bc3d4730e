"""Declared source types, their Spark types, and the values that fill required columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source type name -> Spark type. char/decimal/binary families take arguments.
TYPE_TABLE: dict[str, T.DataType] = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "smallint": T.IntegerType(),
    "tinyint": T.IntegerType(),
    "bit": T.BooleanType(),
    "float": T.DoubleType(),
    "real": T.FloatType(),
    "money": T.DecimalType(19, 4),
    "smallmoney": T.DecimalType(10, 4),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "smalldatetime": T.TimestampNTZType(),
    "datetime2": T.TimestampNTZType(),
    "datetimeoffset": T.TimestampType(),
    "char": T.StringType(),
    "nchar": T.StringType(),
    "varchar": T.StringType(),
    "nvarchar": T.StringType(),
    "text": T.StringType(),
    "ntext": T.StringType(),
    "binary": T.BinaryType(),
    "varbinary": T.BinaryType(),
    "image": T.BinaryType(),
    "uniqueidentifier": T.StringType(),
}

# Source types that cannot be moved.
UNSUPPORTED_TYPES = ("timestamp", "rowversion", "sql_variant", "xml", "udt", "structured", "table")

# What a NULL in a required column becomes, by Spark type name.
REQUIRED_DEFAULTS = {
    "bigint": "0",
    "int": "0",
    "boolean": "false",
    "double": "0.0",
    "float": "0.0",
    "string": "",
    "date": "1970-01-01",
    "timestamp": "0001-01-01 00:00:00",
    "timestamp_ntz": "0001-01-01 00:00:00",
    "binary": "",
}
ZERO_UUID = "00000000-0000-0000-0000-000000000000"

_DECLARED = re.compile(r"^\s*([a-z_0-9]+)\s*(?:\(\s*([0-9]+|max)\s*(?:,\s*([0-9]+)\s*)?\))?\s*$", re.IGNORECASE)


@dataclass(frozen=True)
class Field:
    """One declared column: source type text such as ``decimal(18,2)``, and whether NULL is allowed."""

    name: str
    declared: str
    required: bool = False

    @property
    def base(self) -> str:
        return _split(self.declared)[0]

    @property
    def spark_type(self) -> T.DataType:
        return spark_type(self.declared)


def _split(declared: str) -> tuple[str, str | None, str | None]:
    match = _DECLARED.match(declared)
    if not match:
        raise ValueError(f"cannot read type {declared!r}")
    return match.group(1).lower(), match.group(2), match.group(3)


def spark_type(declared: str) -> T.DataType:
    base, first, second = _split(declared)
    if base in ("decimal", "numeric"):
        return T.DecimalType(int(first or 18), int(second or 0))
    if base in UNSUPPORTED_TYPES or base not in TYPE_TABLE:
        raise ValueError(f"type {declared!r} is not supported")
    return TYPE_TABLE[base]


def uuid_text(column: Column, stored: T.DataType) -> Column:
    """Canonical 36-character lowercase text from 16 raw bytes or from any text form of a uuid."""
    digits = F.lower(F.hex(column)) if isinstance(stored, T.BinaryType) else F.lower(F.regexp_replace(column, "[{}-]", ""))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def canonical(column: Column, field: Field, stored: T.DataType) -> Column:
    if field.base == "uniqueidentifier":
        return uuid_text(column, stored).alias(field.name)
    return column.cast(field.spark_type).alias(field.name)


def required_default(field: Field) -> Column:
    if field.base == "uniqueidentifier":
        return F.lit(ZERO_UUID)
    name = field.spark_type.simpleString()
    text = "0" if name.startswith("decimal") else REQUIRED_DEFAULTS[name]
    return F.lit(text).cast(field.spark_type)


def schema_of(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.spark_type, not f.required) for f in fields])
