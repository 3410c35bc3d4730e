import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.evolution import is_wider
from drayline.sources import ledger
from drayline.sources.snapshots import SnapshotTable


def simple(spark, first, last):
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("v"), "id").alias("value"))


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "snap"))


def test_append_and_time_travel(spark, table):
    table.create(simple(spark, 1, 5))
    added = table.append(simple(spark, 6, 8))
    assert (added.snapshot_id, added.rows) == (2, 3)
    assert table.read().count() == 8
    assert table.read_as_of(1).count() == 5
    assert table.read_added(2).count() == 3
    for unknown in (0, 3):
        with pytest.raises(ValueError):
            table.read_as_of(unknown)


def test_three_appends_and_history(spark, table, rows):
    for first in (1, 6, 11):
        table.append_or_create(simple(spark, first, first + 4).coalesce(1))
    assert table.read().count() == 15
    assert rows(table.history(), "snapshot_id", "parent_id", "rows_added", "files_added", "total_rows", "total_files") == [
        (1, None, 5, 1, 5, 1),
        (2, 1, 5, 1, 10, 2),
        (3, 2, 5, 1, 15, 3),
    ]
    assert rows(table.files(), "snapshot_id", "record_count") == [(1, 5), (2, 5), (3, 5)]


def test_history_survives_more_commits_than_the_ledger_ring(spark, table):
    for i in range(1, 12):
        table.append_or_create(simple(spark, i, i).coalesce(1))
    assert table.head().snapshot_id == 11
    assert [r.total_rows for r in table.history().orderBy("snapshot_id").collect()] == list(range(1, 12))


def test_empty_append_makes_no_snapshot(spark, table):
    table.create(simple(spark, 1, 5))
    added = table.append(simple(spark, 1, 5).where("id > 9"))
    assert (added.snapshot_id, added.rows) == (None, 0)
    assert table.head().snapshot_id == 1 and table.read().count() == 5
    table.append(simple(spark, 6, 6))
    assert table.head().snapshot_id == 2 and table.read().count() == 6


def test_errors(spark, table, tmp_path):
    for act in (table.read, table.head, lambda: table.append(simple(spark, 1, 1))):
        with pytest.raises(ValueError, match="no snapshot table"):
            act()
    with pytest.raises(ValueError, match="at least one row"):
        table.create(simple(spark, 1, 1).where("id > 9"))
    assert not table.exists()
    with pytest.raises(ValueError, match="at least one column"):
        table.create(simple(spark, 1, 1).select())
    table.create(simple(spark, 1, 1))
    with pytest.raises(ValueError, match="already exists"):
        table.create(simple(spark, 1, 1))


def test_append_takes_the_table_schema(spark, table, rows):
    table.create(simple(spark, 1, 1))
    table.append(spark.createDataFrame([("x", 7, 2)], "extra string, other int, id int"))
    assert rows(table.read()) == [(1, "v1"), (2, None)]


def test_an_uncommitted_attempt_is_invisible_and_overwritten(spark, table):
    table.create(simple(spark, 1, 5).coalesce(1))
    simple(spark, 100, 200).write.parquet(f"{table.data}/drayline_snapshot=2")
    assert table.read().count() == 5 and table.files().count() == table.head().files_added
    table.append(simple(spark, 6, 8))
    assert table.read().count() == 8


def test_a_named_batch_is_appended_once(spark, table):
    table.create(simple(spark, 1, 5))
    for _ in range(2):
        assert table.append(simple(spark, 6, 8), txn="batch-1").snapshot_id == 2
    assert table.read().count() == 8


def test_metrics_are_taken_while_writing(spark, table):
    made = table.create(simple(spark, 1, 5), metrics={"high": F.max("id")})
    assert made.metrics == {"high": "5"}


def test_rolling_files(spark, table):
    table.create(simple(spark, 1, 150).coalesce(1), max_records_per_file=100)
    assert table.head().files_added == 2


def test_reads_prune_snapshots_while_planning(spark, table, plan):
    table.create(simple(spark, 1, 5))
    table.append(simple(spark, 6, 8))
    text = plan(table.read_as_of(1))
    assert "PartitionFilters: [isnotnull(drayline_snapshot" in text and "<= 1)" in text and "Join" not in text


def test_validation(spark, table, rows):
    table.create(simple(spark, 1, 5))
    table.append(simple(spark, 6, 8))
    assert all(r.passed for r in table.validate().collect())
    simple(spark, 1, 1).write.mode("append").parquet(f"{table.data}/drayline_snapshot=2")
    failing = {r.check_name for r in table.validate().collect() if not r.passed}
    assert failing == {"scanned_equals_committed", "snapshots_differing"}


def test_own_columns_keep_their_values(spark, table):
    rows = spark.createDataFrame([(70, 1), (71, 2)], "snapshot_id long, year int")
    table.create(rows)
    assert sorted(r.snapshot_id for r in table.read().collect()) == [70, 71]
    with pytest.raises(ValueError, match="reserved"):
        SnapshotTable(spark, table.path + "-other").create(rows.withColumnRenamed("year", "drayline_snapshot"))


# --- Schemas that change -----------------------------------------------------------------------


def test_renamed_widened_and_added_columns(spark, table, rows, plan):
    table.create(spark.createDataFrame([(1, "a", 1.5)], "id int, old string, v float"))
    assert table.evolve(rename={"old": "name"}, widen={"id": T.LongType(), "v": T.DoubleType()}) == 2
    table.append(spark.createDataFrame([(5_000_000_000, "b", 0.1)], "id long, name string, v double"))
    table.evolve(add=[T.StructField("old", T.IntegerType())])  # a former name, a new column
    table.append(spark.createDataFrame([(3, "c", 7)], "id int, name string, old int"))
    assert rows(table.read(), "id", "name", "v", "old") == [(1, "a", 1.5, None), (3, "c", None, 7), (5_000_000_000, "b", 0.1, None)]
    assert rows(table.read_as_of(3), "id", "name", "old") == [(1, "a", None), (5_000_000_000, "b", None)]
    assert rows(table.read_added(5)) == [(3, "c", None, 7)] and table.read_added(4).count() == 0
    assert [f.name for f in table.schema().fields] == ["id", "name", "v", "old"]
    assert plan(table.read()).split("\n\n")[0].count("Scan parquet") == 3 and plan(table.read_added(5)).split("\n\n")[0].count("Scan parquet") == 1
    assert all(r.passed for r in table.validate().collect())
    assert [r.rows_added for r in table.history().orderBy("snapshot_id").collect()] == [1, 0, 1, 0, 1]


def test_names_may_be_swapped(spark, table, rows):
    table.create(spark.createDataFrame([(1, 2)], "a int, b int"))
    table.evolve(rename={"a": "b", "b": "a"})
    table.append(spark.createDataFrame([(10, 20)], "a int, b int"))
    assert rows(table.read(), "a", "b") == [(10, 20), (2, 1)]


def test_rows_bring_their_columns(spark, table, rows):
    table.create(spark.createDataFrame([(1, "x")], "id int, name string"))
    table.append_evolving(spark.createDataFrame([(2**40, 0.5)], "ID long, score double"), txn="b")
    assert table.append_evolving(spark.createDataFrame([(9, 0.5)], "id long, score double"), txn="b").rows == 1
    assert rows(table.read(), "id", "name", "score") == [(1, "x", None), (2**40, None, 0.5)]
    with pytest.raises(ValueError, match="arrives as"):
        table.append_evolving(spark.createDataFrame([("z",)], "id string"))
    table.append_evolving(spark.createDataFrame([(3,)], "id short"))
    assert table.head().snapshot_id == 4 and table.schema()["id"].dataType == T.LongType()


def test_changes_that_lose_values_are_refused(spark, table):
    table.create(spark.createDataFrame([(1, 2)], "a long, b int"))
    for change in ({"widen": {"a": T.IntegerType()}}, {"widen": {"b": T.FloatType()}}, {"widen": {"x": T.LongType()}}, {"rename": {"x": "y"}}, {"rename": {"a": "B"}}, {"add": [T.StructField("A", T.LongType())]}):
        with pytest.raises(ValueError):
            table.evolve(**change)
    assert table.head().snapshot_id == 1


@pytest.mark.parametrize(
    ("old", "new", "wider"),
    [("int", "long", True), ("long", "int", False), ("int", "double", True), ("long", "double", False), ("float", "double", True), ("decimal(9,2)", "decimal(11,3)", True), ("decimal(9,2)", "decimal(9,3)", False), ("int", "decimal(10,0)", True), ("int", "decimal(9,0)", False), ("date", "timestamp_ntz", True), ("string", "string", True), ("int", "string", False)],
)
def test_wider_types(old, new, wider):
    of = lambda t: T.StructType.fromDDL(f"c {t}").fields[0].dataType
    assert is_wider(of(old), of(new)) is wider


def test_commits_are_written_once_and_gathered(spark, table, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 4)
    for i in range(1, 11):
        table.append_or_create(simple(spark, i, i).coalesce(1))
    names = sorted(ledger.list_names(spark, f"{table.path}/commits"))
    assert names == ["block-4", "block-8", "commit-10", "commit-9"]
    assert [r.total_rows for r in table.history().orderBy("snapshot_id").collect()] == list(range(1, 11))
    spark.range(0).selectExpr("id AS x").write.parquet(f"{table.path}/commits/torn")
    for torn in ("commit-11", "block-12"):  # folders of a write that did not end
        ledger_path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/commits/{torn}/_temporary")
        ledger_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(ledger_path)
    assert table.head().snapshot_id == 10 and table.read().count() == 10
    table.append(simple(spark, 11, 11))
    table.append(simple(spark, 12, 12))
    assert table.head().snapshot_id == 12 and "block-12" in ledger.list_names(spark, f"{table.path}/commits")
    assert table.read().count() == 12


# --- Profiles ----------------------------------------------------------------------------------


def test_profiles_merge_without_reading_data(spark, tmp_path, plan):
    table = SnapshotTable(spark, str(tmp_path / "p"), profiled=True)
    rows = spark.range(20_000).select(F.col("id").cast("int").alias("a"), (F.col("id") % 500).cast("double").alias("b"), F.concat(F.lit("s"), F.col("id") % 37).alias("c"))
    table.create(rows.where("a < 8000"))
    table.evolve(rename={"b": "renamed"}, widen={"a": T.LongType()}, add=[T.StructField("late", T.DoubleType())])
    table.append(rows.where("a >= 4000 AND a < 16000").withColumnRenamed("b", "renamed").withColumn("late", F.when(F.col("a") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("a").cast("double"))))
    now = {r.column_name: r for r in table.profile().collect()}
    assert now["a"].rows == 20_000 and now["a"].non_null_count == 20_000 and now["late"].null_count == 8000
    assert abs(now["a"].distinct_estimate - 16_000) < 800  # a widened column's values are the same values
    assert abs(now["renamed"].distinct_estimate - 500) < 25 and abs(now["c"].distinct_estimate - 37) <= 2
    assert (now["a"].least, now["a"].greatest) == (0.0, 15_999.0) and abs(now["a"].quantile_50 - 7000) < 400
    assert (now["late"].least, now["late"].greatest) == (4001.0, 15_999.0) and now["c"].quantile_25 is None
    first = {r.column_name: r for r in table.profile(1).collect()}
    assert first["a"].rows == 8000 and "late" not in first or first["late"].non_null_count == 0
    assert "drayline_snapshot" in plan(table.profile()) and f"{table.path}/data" not in plan(table.profile())


def test_a_snapshot_without_a_profile_is_named(spark, tmp_path):
    path = str(tmp_path / "p")
    SnapshotTable(spark, path).create(simple(spark, 1, 5))
    with pytest.raises(ValueError, match="no snapshot of"):
        SnapshotTable(spark, path).profile()
    SnapshotTable(spark, path, profiled=True).append(simple(spark, 6, 9))
    with pytest.raises(ValueError, match="snapshot 1 of"):
        SnapshotTable(spark, path).profile()
