import pytest
from pyspark.sql import functions as F

from drayline.operators.profile import database_profile
from drayline.sources import jdbc

PEOPLE = "Id int, Name string, Age int"


@pytest.fixture
def people(spark, db):
    rows = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25)], PEOPLE)
    jdbc.append_rows(rows, db, "PEOPLE", text_length=40)
    return rows


def test_parallel_scan_is_complete_and_pushes_filters(spark, db, plan):
    df = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), F.col("id").cast("int").alias("v"))
    jdbc.append_rows(df, db, "NUMS")
    read = jdbc.read_table(spark, db, "NUMS", jdbc.Split("k", 4))
    assert read.rdd.getNumPartitions() == 4
    assert read.count() == 1000 and read.where("k is null").count() == 100
    text = plan(read.where("v > 500"))
    assert "PushedFilters: [v IS NOT NULL, v > 500]" in text


def test_counts_run_in_the_database(spark, db, people, plan):
    counted = jdbc.count_rows(spark, db, "PEOPLE", "Age > 26")
    assert "PushedAggregates: [COUNT(*)]" in plan(counted) and "Age > 26" in plan(counted)
    in_parts = jdbc.read_table(spark, db, "PEOPLE", jdbc.Split("Id", 2)).groupBy().count()
    assert "PushedAggregates: [COUNT(*)]" in plan(in_parts) and in_parts.first()[0] == 2
    assert jdbc.read_table(spark, db, "APP.PEOPLE").count() == 2


def test_query_slices_and_counts(spark, db, people, rows):
    sql = 'SELECT "Id", "Name" AS "who" FROM PEOPLE WHERE "Age" > 26'
    assert rows(jdbc.read_query(spark, db, sql)) == [(1, "Alice")]
    assert rows(jdbc.read_slices(spark, db, "PEOPLE", ['"Id" = 1', '"Id" <> 1'])) == rows(people)
    assert jdbc.count_rows(spark, db, "PEOPLE", "Age > 26").first().row_count == 1


def test_append_truncate_and_empty_append(spark, db, people, rows):
    jdbc.append_rows(people.where("Id > 5"), db, "PEOPLE")
    assert jdbc.read_table(spark, db, "PEOPLE").count() == 2
    jdbc.append_new_rows(people.unionByName(spark.createDataFrame([(3, "Cy", 1)], PEOPLE)), db, "PEOPLE", ["Id"])
    assert jdbc.read_table(spark, db, "PEOPLE").count() == 3
    jdbc.truncate_load(people.where("Id = 2"), db, "PEOPLE")
    assert rows(jdbc.read_table(spark, db, "PEOPLE")) == [(2, "Bob", 25)]


def test_timestamps_stay_zone_free(spark, db):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000001' as t, 1 as k")
    jdbc.append_rows(df, db, "TIMES")
    read = jdbc.read_table(spark, db, "TIMES")
    assert read.schema["t"].dataType.simpleString() == "timestamp_ntz"
    assert read.where("t > timestamp_ntz'2024-03-10 02:30:00'").first().t == df.first().t


def test_merge_in_the_database(spark, db, people, rows):
    changes = spark.createDataFrame([(1, "Alice Updated", 31), (3, "Charlie", 35)], PEOPLE)
    assert jdbc.merge_rows(changes, db, "PEOPLE", ["Id"], "upsert") == jdbc.Merged(1, 1)
    assert rows(jdbc.read_table(spark, db, "PEOPLE")) == [(1, "Alice Updated", 31), (2, "Bob", 25), (3, "Charlie", 35)]


def test_merge_makes_missing_columns_null_and_append_leaves_rows(spark, db, people, rows):
    partial = spark.createDataFrame([(2, "Robert")], "Id int, Name string")
    assert jdbc.merge_rows(partial, db, "PEOPLE", ["Id"], "upsert") == jdbc.Merged(0, 1)
    assert jdbc.merge_rows(partial, db, "PEOPLE", ["Id"], "append") == jdbc.Merged(0, 0)
    assert rows(jdbc.read_table(spark, db, "PEOPLE")) == [(1, "Alice", 30), (2, "Robert", None)]


def test_older_rows_do_not_undo_newer_ones(spark, db, people, rows):
    table = jdbc.DatabaseTable(db, "PEOPLE", ["Id"])
    late = spark.createDataFrame([(1, "Younger", 29), (2, "Same", 25), (2, "Lower", 3), (4, "New", None)], PEOPLE)
    assert table.merge(late, latest_by="Age") == jdbc.Merged(1, 1, 1)
    assert rows(jdbc.read_table(spark, db, "PEOPLE")) == [(1, "Alice", 30), (2, "Same", 25), (4, "New", None)]
    assert table.merge(spark.createDataFrame([(4, "Marked", 0), (1, "None", None)], PEOPLE), latest_by="Age") == jdbc.Merged(0, 1, 1)
    assert rows(jdbc.read_table(spark, db, "PEOPLE")) == [(1, "Alice", 30), (2, "Same", 25), (4, "Marked", 0)]


def test_failed_merge_leaves_the_table_and_no_staging(spark, db, people, rows):
    with pytest.raises(ValueError):
        jdbc.merge_rows(people, db, "PEOPLE", ["Id"], "replace")
    twice = people.unionByName(people)
    with pytest.raises(Exception):
        jdbc.merge_rows(twice.withColumn("Name", F.repeat("Name", F.lit(20))), db, "PEOPLE", ["Id"], "upsert")
    assert rows(jdbc.read_table(spark, db, "PEOPLE")) == rows(people)


def test_large_import(spark, db):
    df = spark.range(50_000).select(F.col("id").cast("int").alias("Id"), F.lit("n").alias("Name"), F.lit(1).alias("Age"))
    jdbc.append_rows(df, db, "BIG", text_length=10)
    assert jdbc.count_rows(spark, db, "BIG").first()[0] == 50_000


def test_long_text_key_only_tables_and_split_queries(spark, db, rows):
    jdbc.execute(spark, db, 'CREATE TABLE NOTES ("id" INT NOT NULL, "body" CLOB)', 'CREATE TABLE KEYS ("a" INT, "b" INT)')
    notes = spark.createDataFrame([(1, "x" * 5000), (2, None)], "id int, body string")
    assert jdbc.merge_rows(notes, db, "NOTES", ["id"]) == jdbc.Merged(2, 0)
    assert sorted(len(r.body or "") for r in jdbc.read_table(spark, db, "NOTES").collect()) == [0, 5000]
    keys = spark.createDataFrame([(i, i % 3) for i in range(40)], "a int, b int")
    assert jdbc.merge_rows(keys, db, "KEYS", ["a", "b"]) == jdbc.Merged(40, 0)
    assert jdbc.merge_rows(keys, db, "KEYS", ["a", "b"]) == jdbc.Merged(0, 40)
    assert jdbc.append_new_rows(keys.unionByName(spark.createDataFrame([(99, 0)], "a int, b int")), db, "KEYS", ["a", "b"]) == 1
    sql = 'SELECT "a", "b" FROM KEYS WHERE "a" < 90'
    for split in (jdbc.Split("a", 4), jdbc.Split("a", cuts=(5, 6, 30))):
        found = jdbc.read_query(spark, db, sql, split)
        assert found.rdd.getNumPartitions() == 4 and rows(found) == rows(keys)
    assert jdbc.read_table(spark, db, "KEYS", jdbc.Split("a", cuts=(5, 6, 30))).count() == 41


def test_merge_statement_by_dialect():
    derby, server = jdbc.Database("jdbc:derby:memory:x"), jdbc.Database("jdbc:sqlserver://h;databaseName=d")
    assert jdbc.merge_sql(server, "S", "T", ["k", "v"], ["k"], "upsert").endswith(";")
    assert not jdbc.merge_sql(derby, "S", "T", ["k", "v"], ["k"], "upsert").endswith(";")
    assert "UPDATE" not in jdbc.merge_sql(server, "S", "T", ["k"], ["k"], "upsert")
    assert jdbc.stage_sql(server, "S", "T").startswith("SELECT TOP 0 * INTO S")


def test_discovery(spark, db, people):
    found = jdbc.discover(spark, db)
    assert list(found) == ["APP.PEOPLE"]
    profile = database_profile(spark, found)
    assert [tuple(r) for r in profile.collect()] == [("APP", "PEOPLE", 2, 3)]


def part_sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("shape", ["outlier", "growing", "repeated", "negative"])
def test_balanced_cuts(spark, db, rows, shape):
    i = F.col("id")
    key = {"outlier": F.when(i == 999, 10**15).otherwise(i), "growing": i * i * i, "repeated": F.when(i < 500, 7).otherwise(i), "negative": (i - 500) * 1_000_003}[shape]
    df = spark.range(1000).select(key.cast("long").alias("k"), (i % 3).cast("int").alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1)], "k long, v int"))
    jdbc.append_rows(df, db, "SPREAD")
    cuts = jdbc.balanced_cuts(spark, db, "SPREAD", "k", 4)
    found = jdbc.read_table(spark, db, "SPREAD", jdbc.Split("k", 4, balanced=True))
    assert rows(found) == rows(df) and cuts == tuple(sorted(set(cuts)))
    if shape == "repeated":
        assert max(part_sizes(found)) <= 520  # one value with half of the rows stays whole
    else:
        assert found.rdd.getNumPartitions() == 4 and max(part_sizes(found)) <= 270
    query = jdbc.read_query(spark, db, 'SELECT "k" FROM SPREAD WHERE "v" = 1', jdbc.Split("k", 4, balanced=True))
    assert rows(query) == rows(df.where("v = 1").select("k"))


def test_balanced_cuts_of_fractions_dates_and_nothing(spark, db, rows):
    df = spark.range(1000).select((F.exp(F.col("id") / 40) - 3).alias("x"), F.expr("date_add(DATE'2020-01-01', cast(pow(id, 1.3) as int))").alias("d"))
    jdbc.append_rows(df, db, "REALS")
    for column in ("x", "d"):
        found = jdbc.read_table(spark, db, "REALS", jdbc.Split(column, 5, balanced=True))
        assert rows(found) == rows(df) and max(part_sizes(found)) <= 230
    jdbc.execute(spark, db, 'CREATE TABLE NONE_YET ("k" BIGINT)', 'CREATE TABLE ONE_KEY ("k" BIGINT)', 'INSERT INTO ONE_KEY VALUES 5, 5, NULL')
    assert jdbc.read_table(spark, db, "NONE_YET", jdbc.Split("k", 4, balanced=True)).count() == 0
    assert jdbc.read_table(spark, db, "ONE_KEY", jdbc.Split("k", 4, balanced=True)).count() == 3
