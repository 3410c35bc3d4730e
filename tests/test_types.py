import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.types import ZERO_UUID, Field, schema_of, spark_type
from drayline.operators.projection import align, canonicalise, fill_required, to_utc
from drayline.sources.files import read_typed_parquet


@pytest.mark.parametrize(
    "declared, expected",
    [
        ("bigint", "bigint"),
        ("INT", "int"),
        ("smallint", "int"),
        ("tinyint", "int"),
        ("bit", "boolean"),
        ("float", "double"),
        ("real", "float"),
        ("decimal", "decimal(18,0)"),
        ("decimal(10)", "decimal(10,0)"),
        ("Decimal(18, 2)", "decimal(18,2)"),
        ("money", "decimal(19,4)"),
        ("smallmoney", "decimal(10,4)"),
        ("date", "date"),
        ("datetime", "timestamp_ntz"),
        ("smalldatetime", "timestamp_ntz"),
        ("datetime2(7)", "timestamp_ntz"),
        ("datetimeoffset", "timestamp"),
        ("char(3)", "string"),
        ("nvarchar(max)", "string"),
        ("ntext", "string"),
        ("varbinary(max)", "binary"),
        ("image", "binary"),
        ("uniqueidentifier", "string"),
    ],
)
def test_type_table(declared, expected):
    assert spark_type(declared).simpleString() == expected


@pytest.mark.parametrize("declared", ["timestamp", "sql_variant", "xml", "udt", "geography", "decimal(1,2,3)"])
def test_unsupported_types(declared):
    with pytest.raises(ValueError):
        spark_type(declared)


FIELDS = [
    Field("id", "bigint", required=True),
    Field("flag", "bit"),
    Field("small_num", "smallint"),
    Field("price", "decimal(18,2)"),
    Field("description", "nvarchar(200)"),
    Field("unique_id", "uniqueidentifier"),
    Field("created_date", "date"),
    Field("updated_timestamp", "datetimeoffset"),
]


def test_canonical_row(spark):
    text = "6F9619FF-8B86-D011-B42D-00C04FC964FF"
    raw = spark.createDataFrame(
        [("1", "true", "7", "9.99", "x", "{" + text + "}", "2024-03-01", "2024-03-01 10:00:00+02:00")], [f.name for f in FIELDS]
    )
    typed = canonicalise(raw, FIELDS)
    assert [f.dataType for f in typed.schema] == [f.dataType for f in schema_of(FIELDS)]
    row = typed.select("*", F.unix_seconds("updated_timestamp").alias("at")).first()
    assert row.unique_id == text.lower() and str(row.price) == "9.99"
    assert row.at == 1709280000


def test_typed_scan_reads_uuid_bytes_and_missing_columns(spark, tmp_path):
    path, one = str(tmp_path / "t"), uuid.uuid4()
    schema = "unique_id binary, id bigint"
    spark.createDataFrame([(bytearray(one.bytes), 1), (None, 2)], schema).write.parquet(path)
    read = read_typed_parquet(spark, path, [FIELDS[0], FIELDS[4], FIELDS[5]])
    assert read.columns == ["id", "description", "unique_id"]
    assert {tuple(r) for r in read.collect()} == {(1, None, str(one)), (2, None, None)}


def test_nullability_follows_required():
    fields = [Field("id", "int", True), Field("required_field", "nvarchar(10)", True), Field("optional_field", "nvarchar(10)")]
    assert [f.nullable for f in schema_of(fields)] == [False, False, True]


def test_align_orders_fills_and_drops(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "b int, a string, extra double")
    out = align(df, T.StructType.fromDDL("a string, missing decimal(5,1), b bigint"))
    assert out.schema.simpleString() == "struct<a:string,missing:decimal(5,1),b:bigint>"
    assert tuple(out.first()) == ("x", None, 1)


def test_required_fill_by_type(spark):
    kinds = [
        ("l", "bigint", 0),
        ("b", "bit", False),
        ("f", "float", 0.0),
        ("d", "decimal(10,2)", 0),
        ("s", "nvarchar(5)", ""),
        ("y", "date", "1970-01-01"),
        ("t", "datetime", datetime(1, 1, 1)),
        ("x", "varbinary(5)", bytearray()),
        ("u", "uniqueidentifier", ZERO_UUID),
    ]
    fields = [Field(n, t, required=True) for n, t, _ in kinds] + [Field("o", "int")]
    empty = spark.range(1).select([F.lit(None).cast(f.spark_type).alias(f.name) for f in fields])
    filled = fill_required(empty, fields).withColumn("y", F.col("y").cast("string")).first()
    for name, _, value in kinds:
        assert filled[name] == value, name
    assert filled["o"] is None


def test_to_utc_follows_daylight_saving(spark):
    df = spark.createDataFrame([("2024-01-10 12:00:00",), ("2024-07-10 12:00:00",)], "t string")
    out = df.select(to_utc(F.col("t").cast("timestamp_ntz"), "America/New_York").alias("u"))
    assert [r.u for r in out.collect()] == [datetime(2024, 1, 10, 17), datetime(2024, 7, 10, 16)]


def test_align_ignores_letter_case(spark):
    df = spark.createDataFrame([(1, "x")], "ID int, V string")
    out = align(df, T.StructType.fromDDL("id long, v string, w double"))
    assert [tuple(r) for r in out.collect()] == [(1, "x", None)] and out.columns == ["id", "v", "w"]
    twice = df.toDF("a", "A")
    with pytest.raises(ValueError, match="could be any"):
        align(twice, T.StructType.fromDDL("a int"))
