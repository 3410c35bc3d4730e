import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.scalars import int_date, iso_text, partition_path
from drayline.session import files_and_bytes
from drayline.sources import files


def days(spark, n=40, per_day=10):
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 40 as int), 1)")
    return spark.range(n * per_day).select("id", at.alias("at"))


def test_codecs(spark, tmp_path):
    for codec, mark in (("snappy", ".snappy."), ("gzip", ".gz."), ("none", "")):
        path = str(tmp_path / codec)
        files.write_parquet(spark.range(10), path, compression=codec)
        assert all(mark in f for f in glob.glob(path + "/*.parquet"))
        assert files.read_parquet(spark, path).count() == 10
    with pytest.raises(ValueError):
        files.write_parquet(spark.range(1), str(tmp_path / "x"), compression="lzo")


def test_missing_path_is_an_error_and_an_empty_table_keeps_its_schema(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_parquet(spark, str(tmp_path / "nothing"))
    blank = tmp_path / "blank.parquet"
    blank.touch()
    assert files.read_parquet(spark, str(blank), T.StructType().add("id", "long")).count() == 0
    path = str(tmp_path / "empty")
    files.write_parquet(spark.range(0), path)
    read = files.read_parquet(spark, path)
    assert read.count() == 0 and read.columns == ["id"]


@pytest.mark.parametrize("rows, per_file", [(150, 100), (1000, 500)])
def test_file_rolling(spark, tmp_path, rows, per_file):
    path = str(tmp_path / "rolled")
    files.write_parquet(spark.range(rows).coalesce(1), path, max_records_per_file=per_file)
    sizes = [r.record_count for r in files.file_stats(spark, path).collect()]
    assert len(sizes) == 2 and max(sizes) == per_file and sum(sizes) == rows
    count, size = files_and_bytes(spark, path)
    assert count == 2 and size == sum(os.path.getsize(f) for f in glob.glob(path + "/*.parquet"))


def test_newest_files_first(spark, tmp_path):
    path = str(tmp_path / "f")
    for _ in range(3):
        files.write_parquet(spark.range(5).coalesce(1), path, mode="append")
    times = [r.file_modification_time for r in files.newest_first(files.file_stats(spark, path)).collect()]
    assert len(times) == 3 and times == sorted(times, reverse=True)


def test_run_date_rerun_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "runs")
    files.write_run_date(spark.range(3), path, "2024-03-06")
    for _ in range(2):
        folder = files.write_run_date(spark.range(7), path, "2024-03-07")
    assert folder.endswith("year=2024/month=03/day=07")
    schema = T.StructType.fromDDL("id bigint")
    assert files.read_day_range(spark, path, "2024-03-06", "2024-03-07", schema).count() == 10
    assert files.read_day_range(spark, path, "2024-03-07", "2024-03-07", schema).count() == 7


def test_data_date_sink_prunes_and_replaces_days(spark, tmp_path, plan):
    path, df = str(tmp_path / "dated"), days(spark)
    files.write_data_date(df, path, "at")
    read = files.read_day_range(spark, path, "2024-01-30", "2024-02-02", df.schema)
    assert read.count() == 40
    assert read.select("day").distinct().count() == 4
    partition_filters = next(line for line in plan(read).splitlines() if "PartitionFilters" in line)
    assert "year" in partition_filters and "concat" in partition_filters
    assert "DataFilters" not in partition_filters.split("PartitionFilters")[0]
    files.write_data_date(df.where("at < '2024-01-02'").limit(1), path, "at")
    assert files.read_day_range(spark, path, "2024-01-01", "2024-12-31", df.schema).count() == 391


def test_data_date_of_an_integer_date_and_static(spark, tmp_path):
    path, df = str(tmp_path / "int"), days(spark).select("id", int_date(F.col("at")).alias("d"))
    files.write_data_date(df, path, None, F.to_date(F.col("d").cast("string"), "yyyyMMdd"))
    assert files.read_day_range(spark, path, "2024-01-05", "2024-01-05", df.schema).count() == 10
    files.write_data_date(df, str(tmp_path / "all"), None)
    assert files.read_parquet(spark, str(tmp_path / "all/static")).count() == 400


def test_partition_path(spark):
    df = spark.sql("select timestamp_ntz'2024-03-07 10:11:12.000013' as t")
    row = df.select(partition_path(F.col("t")).alias("p"), iso_text(F.col("t")).alias("i")).first()
    assert row.p == "year=2024/month=03/day=07" and row.i == "2024-03-07T10:11:12.000013"


ROW = T.StructType().add("id", "long").add("name", "string").add("price", "double").add("nested", "string")


def test_json_rows(spark):
    texts = ['[{"id":1,"name":"a","price":1.5,"nested":{"k":[1,2]}},{"id":2,"name":null}]', "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = {tuple(r) for r in files.explode_json_rows(df, "t", ROW, ("n",)).collect()}
    assert got == {(0, 1, "a", 1.5, '{"k":[1,2]}'), (0, 2, None, None, None)}


@pytest.mark.parametrize("bad", ['{"id":1}', "nonsense", '[{"id":"x"}]', '[{"id":1'])
def test_json_that_is_no_array_of_rows_fails(spark, bad):
    df = spark.createDataFrame([(bad,)], "t string")
    with pytest.raises(Exception):
        files.explode_json_rows(df, "t", ROW).collect()


def test_json_round_trip(spark, tmp_path):
    df = spark.sql("select 1L as id, cast(null as string) as name, 2.5D as price, timestamp_ntz'2024-01-02 03:04:05.000006' as at")
    text = files.to_json_rows(df).first()[0]
    assert text == '{"id":1,"name":null,"price":2.5,"at":"2024-01-02T03:04:05.000006"}'
    path = str(tmp_path / "rows")
    files.write_json_lines(df, path)
    assert [tuple(r) for r in files.read_json_lines(spark, path, df.schema).collect()] == [tuple(df.first())]
    array = tmp_path / "array.json"
    array.write_text("[\n " + text + ",\n " + text + "]")
    assert files.read_json_rows(spark, str(array), df.schema).count() == 2
    array.write_text('[{"a": 1, "b": null}, {"a": 2.5, "b": "x"}]')
    assert files.read_json_rows(spark, str(array)).schema.simpleString() == "struct<a:double,b:string>"


def test_csv_is_in_key_order(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.write_csv(spark.range(1000).select((999 - F.col("id")).alias("id"), F.lit("a,b").alias("t")), path, ["id"])
    lines = [line for f in sorted(glob.glob(path + "/part-*.csv")) for line in open(f).read().splitlines()]
    assert [int(x.split(",")[0]) for x in lines if x != "id,t"] == list(range(1000))
    assert files.read_csv(spark, path, T.StructType.fromDDL("id bigint, t string")).where("t = 'a,b'").count() == 1000


def test_own_day_columns_and_lone_objects(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1999)], "id int, year int")
    path = str(tmp_path / "own")
    files.write_run_date(rows, path, "2024-01-05")
    files.write_run_date(rows, path, "2024-02-05")
    found = files.read_day_range(spark, path, "2024-01-01", "2024-01-31", rows.schema)
    assert [tuple(r) for r in found.collect()] == [(1, 1999)] and found.schema["year"].dataType.simpleString() == "int"
    with pytest.raises(ValueError, match="day folders"):
        files.write_data_date(rows.withColumn("d", F.lit("2024-01-05").cast("date")), str(tmp_path / "x"), "d")
    for name, text in (("lone", '{"a": 1}'), ("array", '[{"a": 1, "b": {"c": [2]}}, {"a": null}]')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "rows.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON array"):
        files.read_json_rows(spark, str(tmp_path / "lone")).collect()
    assert sorted(((r.a, r.b) for r in files.read_json_rows(spark, str(tmp_path / "array")).collect()), key=repr) == [(1, '{"c":[2]}'), (None, None)]
