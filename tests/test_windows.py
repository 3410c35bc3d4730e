from datetime import date

import pytest
from pyspark.sql import functions as F

from drayline.functions.windows import (
    date_window,
    int_date_value,
    int_date_window,
    make_window,
    scd2_window,
    window_and_where,
)
from drayline.operators.projection import extract

YEAR = ("2024-01-01", "2024-12-31")


@pytest.fixture
def orders(spark):
    data = [
        (1, "2024-01-15", "Customer A", "100.50"),
        (2, "2024-01-16", "Customer B", "250.75"),
        (3, "2024-01-17", "Customer C", "500.00"),
        (4, "2024-02-01", "Customer D", "150.25"),
        (5, "2024-02-15", "Customer E", "300.00"),
    ]
    raw = spark.createDataFrame(data, "OrderId int, OrderDate string, CustomerName string, Amount string")
    return raw.select("OrderId", F.col("OrderDate").cast("date"), "CustomerName", F.col("Amount").cast("decimal(18,2)"))


@pytest.fixture
def customers(spark):
    data = [
        (1, "A v1", date(2024, 1, 1), date(2024, 2, 1), False),
        (1, "A v2", date(2024, 2, 1), None, True),
        (2, "B v1", date(2024, 1, 15), None, True),
        (3, "C v1", date(2024, 1, 1), date(2024, 3, 1), False),
        (3, "C v2", date(2024, 3, 1), None, True),
    ]
    return spark.createDataFrame(
        data, "CustomerId int, CustomerName string, EffectiveDate date, ExpirationDate date, IsCurrent boolean"
    )


def test_date_window_over_a_year(orders):
    assert extract(orders, date_window("OrderDate", *YEAR)).count() == 5


def test_single_day_is_half_open_and_range_ends_at_midnight(spark):
    times = ["2024-01-05 00:00:00", "2024-01-05 23:59:59.999999", "2024-01-06 00:00:00", "2024-01-06 00:00:00.000001"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz"))
    assert extract(df, date_window("t", "2024-01-05", "2024-01-05")).count() == 2
    assert extract(df, date_window("t", "2024-01-05", "2024-01-06")).count() == 3
    assert extract(df, date_window("t", "2024-01-05", "2024-01-06", end_inclusive_day=True)).count() == 4


def test_int_date_window(spark):
    sales = spark.createDataFrame([(1, 20240115), (2, 20240116), (3, 20240201), (4, 20240215)], "SaleId int, SaleDate int")
    assert extract(sales, int_date_window("SaleDate", *YEAR)).count() == 4
    assert extract(sales, int_date_window("SaleDate", "2024-01-16", "2024-01-16")).count() == 1
    assert int_date_value("2024-02-05", "yyyyMM") == 202402
    with pytest.raises(ValueError):
        int_date_value("2024-02-05", "dd/MM")


def test_scd2_window_keeps_versions_still_open(customers, rows):
    kept = extract(customers, scd2_window("EffectiveDate", *YEAR))
    assert rows(kept, "CustomerName") == [("A v2",), ("B v1",), ("C v2",)]


def test_static_takes_everything(orders):
    assert extract(orders, make_window("static")).count() == 5


@pytest.mark.parametrize(
    "kind, arguments",
    [
        ("date", {"start": "2024-01-01", "end": "2024-01-02"}),
        ("int_date", {"start": "2024-01-01", "end": "2024-01-02"}),
        ("scd2", {"start": "2024-01-01", "end": "2024-01-02"}),
        ("date", {"column": "d"}),
        ("weekly", {"start": "2024-01-01", "end": "2024-01-02"}),
    ],
)
def test_incomplete_windows_are_errors(spark, kind, arguments):
    with pytest.raises(ValueError):
        make_window(kind, **arguments)


def test_window_that_ends_before_it_starts(spark):
    with pytest.raises(ValueError):
        date_window("d", "2024-02-01", "2024-01-01")


def test_or_in_the_predicate_stays_inside_the_window(orders):
    window = date_window("OrderDate", "2024-01-15", "2024-01-16")
    assert orders.where(window_and_where(window, "Amount > 200 OR CustomerName = 'Customer E'")).count() == 1
    assert orders.where(window_and_where(window, "  ")).count() == 2


def test_limit_applies_after_the_filters(orders):
    picked = extract(orders, make_window("static"), "Amount >= 250", ["OrderId"], limit=2, order_by=["OrderId"])
    assert [r.OrderId for r in picked.collect()] == [2, 3]
    with pytest.raises(ValueError):
        extract(orders, make_window("static"), limit=0)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_windows_push_down_for_every_date_type(spark, tmp_path, plan, orders, kind):
    path = str(tmp_path / "orders")
    orders.withColumn("OrderDate", F.col("OrderDate").cast(kind)).write.parquet(path)
    windowed = extract(spark.read.parquet(path), date_window("OrderDate", "2024-01-16", "2024-02-01"))
    assert windowed.count() == 3
    text = plan(windowed)
    assert "GreaterThanOrEqual(OrderDate" in text and "LessThanOrEqual(OrderDate" in text


def test_text_days_and_any_number_format(spark):
    days = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-01-12",), ("2024-01-13",)], "d string")
    assert days.where(date_window("d", "2024-01-05", "2024-01-12")).count() == 3
    assert days.where(date_window("d", "2024-01-05", "2024-01-05")).count() == 1
    versions = days.selectExpr("d", "cast(null as string) as e")
    assert versions.where(scd2_window("d", "2024-01-05", "2024-01-12", "e")).count() == 3
    assert int_date_value("2024-02-05", "ddMMyyyy") == 5022024 and int_date_value("2024-02-05", "yyMMdd") == 240205
    assert int_date_value("2024-02-05", "yyyyMMddHHmmss") == 20240205000000
