from pyspark.sql import functions as F

from drayline.operators import profile, summary
from drayline.operators.projection import contains_top_k, ordered, row_limit, top_n
from drayline.plans import catalog
from drayline.session import table_path


def table(spark, ddl, n):
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = dict(c.split() for c in ddl.split(", "))
    return spark.range(n).select([F.lit(None).cast(kinds[c]).alias(c) for c in names])


def test_advice_rules(spark):
    tables = {
        "history": table(spark, "id int, validfrom date, EndDate date", 5),
        "small": table(spark, "id int, order_date date", 9_999),
        "big": table(spark, "id int, created timestamp, order_date timestamp", 10_000),
        "big_first_by_name": table(spark, "id int, b_at timestamp, a_at timestamp", 10_000),
        "int_day": table(spark, "id int, sale_day int", 10_000),
        "int_dt": table(spark, "id int, saledt int", 10_000),
        "long_day": table(spark, "id int, sale_day bigint", 10_000),
        "plain": table(spark, "id int, name string", 10_000),
    }
    got = {r.table_name: r for r in profile.partition_advice(spark, tables).collect()}
    assert {n: (r.window_type, r.column_name, r.confidence) for n, r in got.items()} == {
        "history": ("scd2", None, 0.9),
        "small": ("static", None, 0.85),
        "big": ("date", "order_date", 0.8),
        "big_first_by_name": ("date", "a_at", 0.8),
        "int_day": ("int_date", "sale_day", 0.8),
        "int_dt": ("int_date", "saledt", 0.8),
        "long_day": ("static", None, 0.6),
        "plain": ("static", None, 0.6),
    }
    assert (got["history"].effective_column, got["history"].expiration_column) == ("validfrom", "EndDate")


def test_profile_and_lookup(spark, rows):
    tables = {"Orders": spark.range(10), "Lines": spark.range(20), "Log": spark.range(5).withColumn("x", F.lit(1))}
    prof = profile.table_profile(spark, tables, {"Orders": "Sales", "Lines": "Sales"})
    assert rows(prof) == [("Sales", "Lines", 20, 1), ("Sales", "Orders", 10, 1), ("main", "Log", 5, 2)]
    assert rows(profile.schema_totals(prof)) == [("Sales", 2, 30, 2), ("main", 1, 5, 2)]
    assert profile.tables_in_schema(prof, "sales").count() == 2
    assert rows(profile.find_table(prof, "SALES", "orders"), "row_count") == [(10,)]


def test_search_prefers_short_names(spark):
    names = ["CustomerOrders", "Orders", "orderlines", "Products", "AOrders", "BOrders", "OrderItems"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in contains_top_k(df, "n", "ORDER").collect()] == ["Orders", "AOrders", "BOrders", "OrderItems", "orderlines"]
    assert contains_top_k(df, "n", "order", 2).count() == 2


def test_order_and_limits(spark, plan):
    df = spark.range(100)
    assert [r.id for r in top_n(df, 3, [F.desc("id")]).collect()] == [99, 98, 97]
    assert "TakeOrderedAndProject" in plan(top_n(df, 3, [F.desc("id")]))
    assert [r.id for r in ordered(df, [F.desc("id")]).limit(2).collect()] == [99, 98]
    assert row_limit(df, 7).count() == 7


def test_one_limit_for_all_sizes(spark, plan):
    rows = spark.range(0, 1_200_000, 1, 8).repartition(16, "id")
    for n in (1, 999_999, 1_000_001):
        assert row_limit(rows, n).count() == n
    assert row_limit(rows, 2_000_000).count() == 1_200_000
    text = plan(row_limit(rows, 1_000_001))
    assert "CollectLimit" in text and "Window" not in text


def test_exact_percentiles_as_sparks_own(spark):
    at = (0.0, 0.2, 0.25, 0.5, 0.7, 0.999, 1.0)
    wide = spark.range(20_000).select(
        ((F.col("id") * 7919) % 20_011).alias("whole"),
        F.when(F.col("id") % 3 > 0, F.lit(5.5)).otherwise(F.sin("id")).alias("ties"),
        F.when(F.col("id") % 10 == 0, F.col("id") * F.lit(1e300) * F.lit(1e300)).when(F.col("id") % 10 == 1, F.lit(float("nan"))).when(F.col("id") % 10 == 2, F.col("id") / 7).alias("odd"),
        F.lit(None).cast("int").alias("none"),
        F.when(F.col("id") == 3, F.lit(4)).alias("one"),
        (F.col("id") % 2).cast("decimal(9,2)").alias("a b"),
    )
    for rows in (wide, wide.limit(7), wide.limit(2), wide.limit(0)):
        got = {r.column_name: r.percentiles for r in summary.exact_percentiles(rows, rows.columns, at).collect()}
        for c in rows.columns:
            own = rows.agg(*[F.percentile(F.col(f"`{c}`"), p) for p in at]).first()
            assert repr(got[c]) == repr(list(own)), c


def test_snapshot_profile_holds_no_column_in_one_task(spark, tmp_path, plan):
    rows = spark.sql("select id as o_orderkey, id % 97 as o_custkey, 'F' as o_orderstatus, id / 8 as o_totalprice, timestamp'1996-03-01' + make_interval(0, id % 80) as o_orderdate, '1' as o_orderpriority from range(3000)")
    rows.write.parquet(table_path(str(tmp_path), "orders"))
    profiled = catalog.snapshot_profile(spark, str(tmp_path))
    assert {(r.column_name, r.distinct_close, r.quartiles_close) for r in profiled.collect()} == {(c, True, True) for c in rows.columns}
    assert "percentile(" not in plan(profiled)
