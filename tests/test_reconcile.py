import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drayline.operators import reconcile as r
from drayline.operators import summary

SIDE = "id int, a string, b double"


def test_counts(spark, rows):
    full, part = spark.range(10), spark.range(7)
    report = r.verify_counts({"t": full, "u": full, "w": full}, {"t": full, "u": part, "w": None})
    assert rows(report) == [
        ("t", 10, 10, 0, "MATCH", "row counts match: 10"),
        ("u", 10, 7, -3, "MISMATCH", "row counts differ: source=10, target=7, difference=-3"),
        ("w", 10, None, None, "MISMATCH", None),
    ]


def test_rows_matching_missing_and_differing(spark, rows):
    source = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", 3.0), (4, None, 4.0)], SIDE)
    target = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.5), (5, "w", 5.0), (4, None, 4.0)], SIDE)
    report = r.reconcile_rows(source, target, ["id"], ["a", "b"])
    assert rows(report.drop("source_rows", "target_rows")) == [
        (1, "x", "x", 1.0, 1.0, "MATCH"),
        (2, "y", "y", 2.0, 2.5, "MISMATCH"),
        (3, "z", None, 3.0, None, "MISMATCH"),
        (4, None, None, 4.0, 4.0, "MISMATCH"),
        (5, None, "w", None, 5.0, "MISMATCH"),
    ]
    safe = r.reconcile_rows(source, target, ["id"], ["a", "b"], null_safe=True)
    assert rows(safe.where("id = 4"), "status") == [("MATCH",)]
    assert rows(r.reconcile_inner(source, target, ["id"], ["a", "b"]), "id") == [(1,), (2,), (4,)]


def test_null_keys_never_match(spark, rows):
    side = spark.createDataFrame([(None, "x", 1.0)], SIDE)
    report = r.reconcile_rows(side, side, ["id"], ["a", "b"], null_safe=True)
    assert rows(report, "source_rows", "target_rows", "status") == [(1, 1, "MISMATCH")]
    assert r.reconcile_inner(side, side, ["id"], ["a", "b"]).count() == 0


def test_repeated_keys_come_out_whole_and_not_in_pairs(spark, rows):
    source = spark.createDataFrame([(1, "x", float(i)) for i in range(300)] + [(2, "same", 0.0)] * 5, SIDE)
    target = spark.createDataFrame([(1, "x", float(i)) for i in range(100, 400)] + [(2, "same", 0.0)] * 3, SIDE)
    report = r.reconcile_rows(source, target, ["id"], ["a", "b"])
    by_key = rows(report.groupBy("id", "status").agg(F.sum("source_rows"), F.sum("target_rows")))
    assert by_key == [(1, "MATCH", 200, 200), (1, "MISMATCH", 100, 100), (2, "MATCH", 3, 3), (2, "MISMATCH", 2, 0)]
    lonely = report.where("id = 1 and status = 'MISMATCH'")
    assert lonely.count() == 200 and lonely.where("b_source < 100 or b_target >= 300").count() == 200


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_on_unique_keys(spark, seed):
    rng = random.Random(seed)

    def side():
        return {k: (rng.choice(["p", "q", None]), rng.choice([0.0, 1.0])) for k in rng.sample(range(60), 40)}

    s, t = side(), side()
    expected = Counter()
    for k in s.keys() | t.keys():
        a, b = s.get(k), t.get(k)
        equal = a is not None and b is not None and None not in a + b and a == b
        expected[(k, *(x for i in (0, 1) for x in (a and a[i], b and b[i])), "MATCH" if equal else "MISMATCH")] += 1
    frames = [spark.createDataFrame([(k, *v) for k, v in d.items()], SIDE) for d in (s, t)]
    report = r.reconcile_rows(*frames, ["id"], ["a", "b"]).drop("source_rows", "target_rows")
    fixed = Counter(
        (k, a or None, b or None, (None if k not in s else s[k][1]), (None if k not in t else t[k][1]), st)
        for k, a, b, _, _, st in (tuple(x) for x in report.collect())
    )
    assert fixed == Counter({(k, a, b, (None if k not in s else s[k][1]), (None if k not in t else t[k][1]), st): n
                             for (k, a, b, _, _, st), n in expected.items()})


def test_reconcile_shuffles_contents_once(spark, tmp_path, plan):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.lit("x").alias("a")).write.parquet(path)
    df = spark.read.parquet(path)
    report = r.reconcile_rows(df, df, ["id"], ["a"])
    report.collect()
    text = plan(report)
    assert text.split("Initial Plan")[0].count("Scan parquet") == 2
    assert "ReusedExchange" in text and "Cartesian" not in text and "Python" not in text
    assert text.split("Initial Plan")[0].count("SortMergeJoin") == 0


def test_null_and_range_compare(spark, rows):
    source = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, None, None)], SIDE)
    target = spark.createDataFrame([(1, "x", 1.5)], SIDE)
    assert rows(r.null_counts_compare(source, target, ["a", "b"])) == [("source", 2, 1), ("target", 0, 0)]
    assert rows(r.range_compare(source, target, ["b"], ["id"])) == [
        ("source", 1.0, 2.0, 1.5, 1, 3),
        ("target", 1.5, 1.5, 1.5, 1, 1),
    ]


def test_schema_diff(spark, rows):
    source = spark.createDataFrame([], "a int, b decimal(18,2), c string").schema
    target = spark.createDataFrame([], "a int, b decimal(18,4), d date").schema
    assert rows(r.schema_diff(spark, source, target), "column_name", "status") == [
        ("a", "ok"),
        ("b", "type_diff"),
        ("c", "missing_in_target"),
        ("d", "missing_in_source"),
    ]


def test_column_stats_is_one_pass(spark, rows, tmp_path, plan):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x", None), (2, None, None)], SIDE).write.parquet(path)
    stats = summary.column_stats(spark.read.parquet(path))
    assert rows(stats) == [("a", "string", 1, 1), ("b", "double", 0, 2), ("id", "int", 2, 0)]
    assert plan(stats).count("(1) Scan parquet") == 1 and "(2) Scan parquet" not in plan(stats)


def test_owner_totals_sum_before_the_join(spark, rows, plan):
    owners = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    orders = spark.range(0, 1000).select(F.lit(1).cast("long").alias("o"), "id", F.lit(0.004).alias("amount"))
    out = summary.order_totals_by_owner(owners, "k", ["name"], orders, "o", "id", "amount", scale=3)
    assert [tuple(x) for x in out.collect()] == [(1, "a", 1000, 4.0), (2, "b", 0, 0.0)]
    unscaled = summary.order_totals_by_owner(owners, "k", ["name"], orders, "o", "id", "amount").first()
    assert abs(unscaled.amount_ordered - 4.0) < 1e-9


def test_totals_keep_every_digit(spark):
    fine = spark.range(1000).selectExpr("cast(1.0049 as decimal(10,4)) as d", "0.004D as f", "20000000000000000L as big")
    row = fine.agg(r.total(fine, "d").cast("string").alias("d"), r.total(fine, "f", scale=3).alias("f"), r.total(fine, "big").alias("big"), r.average(fine, "big").alias("mean")).first()
    assert row.d == "1004.9000" and float(row.f) == 4.0 and int(row.big) == 2 * 10**19 and row.mean == 2e16
    compared = r.range_compare(fine, fine.limit(0), ["big", "d"], []).orderBy("side").collect()
    assert compared[0].avg_big == 2e16 and abs(compared[0].avg_d - 1.0049) < 1e-12 and compared[1].avg_big is None


def test_conditional_summary(spark):
    df = spark.createDataFrame([(1.0, True), (2.5, False), (None, True)], "amount double, on boolean")
    measures = [
        summary.Measure("n", "rows"),
        summary.Measure("n_on", "rows", when=F.col("on")),
        summary.Measure("off_total", "total", "amount", when=~F.col("on")),
        summary.Measure("mean", "average", "amount"),
        summary.Measure("top", "greatest", "amount", when=F.col("on")),
    ]
    assert tuple(summary.conditional_summary(df, measures).first()) == (3, 2, 2.5, 1.75, 1.0)
    assert tuple(summary.conditional_summary(df.limit(0), measures).first()) == (0, 0, None, None, None)
    with pytest.raises(ValueError):
        summary.conditional_summary(df, [summary.Measure("x", "median", "amount")])


def test_columns_named_like_helpers(spark):
    from drayline.operators.reconcile import reconcile_rows

    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "_s int, _t string, _null_key int")
    b = spark.createDataFrame([(1, "x", 5), (2, "z", 6)], "_s int, _t string, _null_key int")
    got = {r._s: (r._t_source, r._t_target, r.status) for r in reconcile_rows(a, b, ["_s"], ["_t", "_null_key"]).collect()}
    assert got == {1: ("x", "x", "MATCH"), 2: ("y", "z", "MISMATCH")}
    stats = {r.column_name: r.non_null_count for r in summary.column_stats(spark.createDataFrame([(1, None)], "_rows int, b int")).collect()}
    assert stats == {"_rows": 1, "b": 0}
