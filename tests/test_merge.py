import pytest
from pyspark.sql import functions as F

from drayline.operators import merge

PEOPLE = "Id int, Name string, Age int"


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25)], PEOPLE)


@pytest.fixture
def changes(spark):
    return spark.createDataFrame([(1, "Alice Updated", 31), (3, "Charlie", 35)], PEOPLE)


def test_upsert(people, changes, rows):
    assert rows(merge.merge(people, changes, ["Id"], "UPSERT")) == [(1, "Alice Updated", 31), (2, "Bob", 25), (3, "Charlie", 35)]


def test_append_never_updates(people, changes, rows):
    assert rows(merge.merge(people, changes, ["Id"], "append")) == [(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)]


def test_unknown_mode(people, changes):
    with pytest.raises(ValueError):
        merge.merge(people, changes, ["Id"], "replace")


def test_upsert_writes_nulls_and_missing_columns_as_null(spark, people, rows):
    nulls = spark.createDataFrame([(1, None)], "Id int, Name string")
    assert rows(merge.merge_upsert(people, nulls, ["Id"])) == [(1, None, None), (2, "Bob", 25)]


def test_null_key_never_matches(spark, rows):
    target = spark.createDataFrame([(None, "old", 1)], PEOPLE)
    source = spark.createDataFrame([(None, "new", 2)], PEOPLE)
    both = [(None, "new", 2), (None, "old", 1)]
    assert rows(merge.merge_append(target, source, ["Id"])) == both
    assert rows(merge.merge_upsert(target, source, ["Id"])) == both
    with pytest.raises(Exception, match="NULL in merge key"):
        merge.reject_null_keys(source, ["Id"]).collect()


def test_action_counts(people, changes, rows):
    assert rows(merge.merge_action_counts(people, changes, ["Id"])) == [("INSERT", 1), ("UPDATE", 1)]
    assert rows(merge.merge_action_counts(people, people, ["Id"])) == [("UPDATE", 2)]


def test_latest_per_key_ties_and_null_marks(spark, rows):
    data = [(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (2, None, "x")]
    df = spark.createDataFrame(data, "k int, v int, t string")
    assert rows(merge.latest_per_key(df, ["k"], "v")) == [(1, 5, "b"), (2, None, "x")]


def test_latest_per_key_ranks_before_the_shuffle(spark, plan):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    text = plan(merge.latest_per_key(df, ["k"], "v"))
    assert text.count("WindowGroupLimit") >= 2


def test_hot_key_sends_one_row_per_task(spark):
    """A third of the rows share a key; the shuffle carries a few rows of it."""
    df = spark.range(0, 90_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    latest = merge.latest_per_key(df, ["k"], "v")
    assert latest.count() == 60_001
    assert latest.where("k = 0").first().v == 89_997


def test_merge_plans_have_no_python_and_one_side_read_for_keys_only(spark, plan, people, changes, tmp_path):
    people.write.parquet(str(tmp_path / "t"))
    changes.write.parquet(str(tmp_path / "s"))
    target, source = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "s"))
    text = plan(merge.merge_upsert(target, source, ["Id"]))
    assert "LeftAnti" in text and "Python" not in text
    assert "ReadSchema: struct<Id:int>" in text


def test_older_changes_leave_newer_rows(spark, rows):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", None), (4, "d", 5)], "id int, name string, rev int")
    changes = spark.createDataFrame([(1, "old", 4), (2, "same", 5), (3, "any", 0), (4, "none", None), (5, "new", None), (1, "older", 3)], target.schema)
    got = rows(merge.merge(target, changes, ["id"], "upsert", latest_by="rev"))
    assert got == [(1, "a", 5), (2, "same", 5), (3, "any", 0), (4, "d", 5), (5, "new", None)]


def test_helper_columns_give_way_to_those_of_the_table(spark, rows):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "_present int, _rank int, v string")
    assert rows(merge.latest_per_key(df, ["_present"], "_rank")) == [(1, 2, "y")]
    assert rows(merge.merge_action_counts(df.limit(1), df.limit(1), ["_present"])) == [("UPDATE", 1)]
