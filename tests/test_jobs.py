from pyspark.sql import functions as F

from drayline.functions.types import Field
from drayline.functions.windows import date_window, int_date_window, scd2_window, static_window
from drayline.plans import jobs
from drayline.sources import jdbc
from drayline.sources.snapshots import SnapshotTable

RUN = "2024-03-07"
YEAR = ("2024-01-01", "2024-12-31")


def items(spark, n):
    return spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("Id"),
        F.concat(F.lit("Item"), "id").alias("Name"),
        (F.col("id") * 10.5).cast("decimal(18,2)").alias("Value"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("CreatedDate"),
    )


def created(df, db, name):
    jdbc.append_rows(df.limit(0), db, name, text_length=60)
    return name


def test_table_to_parquet_to_table(spark, db, tmp_path, rows):
    source = items(spark, 100)
    into = created(source, db, "ITEMS")
    done = jobs.transfer_table(source, str(tmp_path), RUN, db, into)
    assert done == jobs.Transferred(100, 100, 100, 100) and done.counts_match and done.difference == 0
    assert rows(jdbc.read_table(spark, db, into)) == rows(source)


def test_rerun_with_a_key_adds_nothing(spark, db, tmp_path):
    source = items(spark, 50)
    into = created(source, db, "ITEMS")
    for loaded in (50, 0):
        done = jobs.transfer_table(source, str(tmp_path), RUN, db, into, key=["Id"])
        assert (done.rows_loaded, done.dest_count) == (loaded, 50)


def test_limit_shows_as_a_count_difference(spark, db, tmp_path):
    source = items(spark, 75)
    into = created(source, db, "ITEMS")
    done = jobs.transfer_table(source, str(tmp_path), RUN, db, into, jobs.Selection(where="Id > 5", limit=10))
    assert (done.rows_extracted, done.source_count, done.dest_count, done.difference) == (10, 70, 10, -60)


def test_empty_table(spark, db, tmp_path):
    source = items(spark, 5).where("Id > 9")
    done = jobs.transfer_table(source, str(tmp_path), RUN, db, created(source, db, "ITEMS"))
    assert done == jobs.Transferred(0, 0, 0, 0)


def test_dry_run(spark):
    assert jobs.dry_run(items(spark, 10), jobs.Selection(where="Id > 4", limit=2)) == 6


def test_snapshot_there_and_back(spark, db, tmp_path, rows):
    fields = [Field("Id", "int", True), Field("Name", "nvarchar(50)"), Field("Value", "decimal(18,2)"), Field("CreatedDate", "datetime2")]
    table, source = SnapshotTable(spark, str(tmp_path / "s")), items(spark, 20)
    assert jobs.to_snapshot(source, table, fields).rows_loaded == 20
    newer = source.where("Id <= 3").withColumn("Name", F.lit("new")).withColumn("CreatedDate", F.lit("2025-01-01").cast("timestamp_ntz"))
    jobs.to_snapshot(newer, table, fields)
    into = created(source, db, "ITEMS")
    done = jobs.from_snapshot(table, db, into, ["Id"], "CreatedDate")
    assert done.rows_loaded == 20 and done.dest_count == 20
    assert jdbc.read_table(spark, db, into).where("Name = 'new'").count() == 3
    assert jdbc.count_rows(spark, db, into).first()[0] == 20


def test_batch_of_mixed_windows_with_a_failure(spark, tmp_path):
    d = "date'2024-01-{:02d}'"
    orders = spark.sql("select * from values " + ",".join(f"({i}, {d.format(i)})" for i in range(1, 6)) + " as t(id, d)")
    sales = spark.createDataFrame([(i, 20240100 + i) for i in range(1, 5)], "id int, d int")
    dims = spark.sql("select * from values (1, date'2024-01-01', date'2024-02-01'), (1, date'2024-02-01', null), (2, date'2024-01-15', null) as t(id, f, u)")
    goods = spark.range(3)
    work = {
        "orders": (orders, date_window("d", *YEAR)),
        "sales": (sales, int_date_window("d", *YEAR)),
        "dims": (dims, scd2_window("f", *YEAR, expiration="u")),
        "goods": (goods, static_window()),
    }

    def job(name):
        df, window = work[name]
        return jobs.Job(name, "table_to_parquet", lambda: jobs.to_parquet(df, str(tmp_path / name), RUN, jobs.Selection(window))[1])

    def broken():
        raise RuntimeError("no such table")

    log = str(tmp_path / "log")
    run = jobs.run_batch(spark, [*map(job, work), jobs.Job("gone", "table_to_parquet", broken)], log)
    rows = {r.table_name: r for r in jobs.read_run_log(spark, log, run).collect()}
    assert {n: rows[n].rows_extracted for n in work} == {"orders": 5, "sales": 4, "dims": 2, "goods": 3}
    assert not rows["gone"].success and rows["gone"].error == "RuntimeError: no such table"
    stats = jobs.run_log_stats(jobs.read_run_log(spark, log)).first()
    assert (stats.total_transfers, stats.successful_transfers, stats.failed_transfers, stats.rows_transferred) == (5, 4, 1, 14)
    assert stats.avg_seconds > 0
    jobs.run_batch(spark, [job("goods")], log)
    assert jobs.read_run_log(spark, log).count() == 6


def test_stats_of_an_empty_log(spark, tmp_path):
    log = spark.createDataFrame([], jobs.RUN_LOG)
    assert tuple(jobs.run_log_stats(log).first()) == (0, 0, 0, 0, 0.0)


def slow(spark, rows=10**11):
    """Spark work that goes on until it is cancelled."""
    return jobs.Transferred(rows_extracted=spark.range(0, rows, 1, 1).selectExpr("sum(hash(id))").first()[0])


def test_a_resumed_batch_takes_only_what_failed(spark, tmp_path):
    log, ran = str(tmp_path / "log"), []

    def job(name, fails):
        def run():
            ran.append(name)
            if fails:
                raise RuntimeError("not yet")
            return jobs.Transferred(rows_extracted=1)

        return jobs.Job(name, "t", run)

    run = jobs.run_batch(spark, [job("a", False), job("b", True), job("c", True)], log)
    assert jobs.run_batch(spark, [job("a", False), job("b", False), job("c", True)], log, resume=run) == run
    jobs.run_batch(spark, [job("a", False), job("b", False), job("c", False)], log, resume=run)
    assert sorted(ran) == ["a", "b", "b", "c", "c", "c"]
    final = jobs.latest_outcomes(jobs.read_run_log(spark, log, run)).collect()
    assert sorted((r.table_name, r.success) for r in final) == [("a", True), ("b", True), ("c", True)]
    assert jobs.read_run_log(spark, log, run).count() == 6


def test_a_time_limit_cancels_the_spark_work_of_one_job(spark, tmp_path):
    log = str(tmp_path / "log")
    work = [jobs.Job("endless", "t", lambda: slow(spark)), jobs.Job("quick", "t", lambda: jobs.Transferred(spark.range(5).count()))]
    run = jobs.run_batch(spark, work, log, time_limit=6, pool="{table}")
    rows = {r.table_name: r for r in jobs.read_run_log(spark, log, run).collect()}
    assert rows["quick"].success and not rows["endless"].success and "took more than 6 s" in rows["endless"].error
    assert spark.range(3).count() == 3  # later work is not cancelled


def test_a_failure_may_stop_the_others(spark, tmp_path):
    log = str(tmp_path / "log")

    def broken():
        import time

        time.sleep(2)
        raise RuntimeError("broken")

    work = [jobs.Job("endless", "t", lambda: slow(spark)), jobs.Job("broken", "t", broken), jobs.Job("waiting", "t", lambda: slow(spark))]
    run = jobs.run_batch(spark, work, log, parallel=2, stop_on_failure=True)
    errors = {r.table_name: r.error for r in jobs.read_run_log(spark, log, run).collect()}
    assert "another job failed" in errors["endless"] and "not begun" in errors["waiting"] and errors["broken"] == "RuntimeError: broken"
