"""The registered queries: each operator on the given tables, with the SQL that gives the same rows.

Sinks write under a fresh folder of the shared root and return what they wrote, read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions import scalars
from drayline.functions.types import Field
from drayline.functions.windows import date_window, int_date_window, make_window, scd2_window, window_and_where
from drayline.operators import digest, history, merge, profile, projection, reconcile, summary
from drayline.plans import jobs
from drayline.session import is_local, local_rows, table_path, workspace
from drayline.sources import files, jdbc
from drayline.sources.keyed import HashBuckets, KeyedTable
from drayline.sources.snapshots import SnapshotTable
from drayline.streaming import incremental, streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return files.read_parquet(spark, table_path(sf, name))


# --- Inputs derived from the tables ------------------------------------------------------------

LOADED_BEFORE = "2000-01-01"
CHANGED_SINCE = "1998-01-01"
SYNC_SPLIT = "1998-01-01"


def orders_base(spark: SparkSession, sf: str) -> DataFrame:
    """Orders an earlier load brought."""
    return table(spark, sf, "orders").where(f"o_orderdate < '{LOADED_BEFORE}'")


def orders_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changed orders: part of them loaded before, part of them new."""
    changed = table(spark, sf, "orders").where(f"o_orderdate >= '{CHANGED_SINCE}'")
    return changed.withColumn("o_totalprice", F.col("o_totalprice") + 100.0)


CHANGES_SQL = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 100.0 AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderdate >= TIMESTAMP '{CHANGED_SINCE}'"""
BASE_SQL = f"SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{LOADED_BEFORE}'"
UPSERT_SQL = f"""
WITH base AS ({BASE_SQL}), changes AS ({CHANGES_SQL})
SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.o_orderkey = b.o_orderkey)
UNION ALL SELECT * FROM changes"""
APPEND_SQL = f"""
WITH base AS ({BASE_SQL}), changes AS ({CHANGES_SQL})
SELECT * FROM base
UNION ALL SELECT * FROM changes c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE c.o_orderkey = b.o_orderkey)"""


def sync_source(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a modification time: open orders were changed ten years after they were placed."""
    is_open = F.col("o_orderstatus") == "O"
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(is_open, F.col("o_totalprice") + 100.0).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(is_open, F.expr("o_orderdate + INTERVAL '3650' DAY")).otherwise(F.col("o_orderdate")).alias("modified"),
    )


def sync_source_before(spark: SparkSession, sf: str) -> DataFrame:
    """The same table as the first cycle finds it: early orders, nothing modified yet."""
    early = table(spark, sf, "orders").where(f"o_orderdate <= '{SYNC_SPLIT}'")
    return early.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("modified")
    )


SYNC_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 100.0 ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL '3650' DAY ELSE o_orderdate END AS modified
FROM orders"""


def order_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Validity intervals: open orders have no end, others end after 90 days per priority level."""
    days = F.substring("o_orderpriority", 1, 1).cast("int") * 90
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval(days))
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("EffectiveDate"), end.alias("ExpirationDate")
    )


VERSIONS_SQL = """
SELECT o_orderkey, o_custkey, o_orderdate AS "EffectiveDate",
       CASE WHEN o_orderstatus <> 'O'
            THEN o_orderdate + to_days(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 90) END AS "ExpirationDate"
FROM orders"""


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose only date is an integer."""
    placed = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        scalars.int_date(placed).alias("order_day"),
        scalars.int_date(placed, "yyyyMM").alias("order_month"),
    )


ORDER_DAYS_SQL = """
SELECT o_orderkey, o_totalprice, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS order_day,
       CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS order_month
FROM orders"""


def part_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with missing sizes and brands."""
    return table(spark, sf, "part").select(
        "p_partkey",
        "p_name",
        F.nullif(F.col("p_brand"), F.lit("Brand#2")).alias("p_brand"),
        F.nullif(F.col("p_size"), F.lit(11)).alias("p_size"),
        "p_retailprice",
    )


PART_GAPS_SQL = """
SELECT p_partkey, p_name, nullif(p_brand, 'Brand#2') AS p_brand, nullif(p_size, 11) AS p_size, p_retailprice FROM part"""


def work_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}


def database(spark: SparkSession) -> jdbc.Database:
    """The database named by ``spark.drayline.jdbc.url``.

    Where none is named and the master is local, a Derby database in the memory of this process stands in.
    Executors on other machines could not see it, so a cluster has to name one.
    """
    url = spark.conf.get("spark.drayline.jdbc.url", None)
    if url:
        return jdbc.Database(url, spark.conf.get("spark.drayline.jdbc.driver", None))
    if not is_local(spark):
        raise ValueError("set spark.drayline.jdbc.url: executors cannot reach a database inside the driver process")
    return jdbc.Database(f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver")


def database_table(db: jdbc.Database, rows: DataFrame, name: str, key: str | None = None, empty: bool = False) -> str:
    """A new database table with the columns of ``rows``, filled unless ``empty``; returns its name."""
    fresh = f"{name}_{uuid.uuid4().hex[:8]}".upper()
    jdbc.append_rows(rows.limit(0) if empty else rows, db, fresh, text_length=128)
    if key:
        jdbc.execute(rows.sparkSession, db, f"CREATE UNIQUE INDEX {fresh}_KEY ON {fresh} ({jdbc.quoted(key)})")
    return fresh


# --- Scans -------------------------------------------------------------------------------------


@query("jdbc_scan", "SELECT * FROM orders")
def jdbc_scan(spark, sf):
    db = database(spark)
    name = database_table(db, table(spark, sf, "orders"), "orders")
    return jdbc.read_table(spark, db, name, jdbc.Split("o_orderkey", 4))


@query(
    "jdbc_query_scan",
    "SELECT o_orderkey, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000",
)
def jdbc_query_scan(spark, sf):
    db = database(spark)
    name = database_table(db, table(spark, sf, "orders"), "orders")
    sql = (
        f'SELECT "o_orderkey", "o_totalprice" AS "amount" FROM {name} '
        "WHERE \"o_orderstatus\" = 'F' AND \"o_totalprice\" > 1000"
    )
    return jdbc.read_query(spark, db, sql, jdbc.Split("o_orderkey", 4))


def _far_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose keys grow fast, and one key far from the rest: even steps over them leave nearly all in one part."""
    orders = table(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey") * F.col("o_orderkey"))
    far = table(spark, sf, "orders").where("o_orderkey = 7").withColumn("o_orderkey", F.lit(9_000_000_000_000_000))
    return orders.unionByName(far)


@query(
    "jdbc_scan_balanced",
    """SELECT o_orderkey * o_orderkey AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
       UNION ALL SELECT 9000000000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey = 7""",
)
def jdbc_scan_balanced(spark, sf):
    db = database(spark)
    name = database_table(db, _far_orders(spark, sf), "orders_far", key="o_orderkey")
    return jdbc.read_table(spark, db, name, jdbc.Split("o_orderkey", 4, balanced=True))


@query(
    "jdbc_balanced_parts",
    "SELECT count(*) + 1 AS total_rows, 4 AS parts, true AS like_size FROM orders",
)
def jdbc_balanced_parts(spark, sf):
    """How many rows each parallel read brought: none more than a tenth above the mean."""
    per_part = jdbc_scan_balanced(spark, sf).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    return per_part.agg(
        F.sum("n").alias("total_rows"), F.count(F.lit(1)).cast("int").alias("parts"), (F.max("n") <= 1.1 * F.avg("n")).alias("like_size")
    )


@query("parquet_scan", "SELECT * FROM lineitem")
def parquet_scan(spark, sf):
    return table(spark, sf, "lineitem")


@query(
    "partition_pruned_scan",
    """SELECT event_id, ts, user_id, event_type, value, props, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month,
              strftime(ts, '%d') AS day
       FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'""",
)
def partition_pruned_scan(spark, sf):
    path, events = workspace(spark, "day-folders"), table(spark, sf, "events")
    files.write_data_date(events, path, "ts")
    return files.read_day_range(spark, path, "2024-01-05", "2024-01-09", events.schema)


TYPED_CUSTOMER = [
    Field("c_uuid", "uniqueidentifier", required=True),
    Field("c_custkey", "bigint", required=True),
    Field("c_note", "nvarchar(100)"),
    Field("c_name", "nvarchar(50)", required=True),
    Field("c_acctbal", "float"),
]


@query(
    "typed_parquet_scan",
    """SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
              || substr(h, 21, 12) AS c_uuid,
              c_custkey, CAST(NULL AS VARCHAR) AS c_note, c_name, c_acctbal
       FROM (SELECT *, md5(c_name) AS h FROM customer)""",
)
def typed_parquet_scan(spark, sf):
    path = workspace(spark, "typed")
    raw = table(spark, sf, "customer").withColumn("c_uuid", F.unhex(F.md5("c_name")))
    files.write_parquet(raw, path)
    return files.read_typed_parquet(spark, path, TYPED_CUSTOMER)


@query("json_rows_source", "SELECT event_id, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k FROM events")
def json_rows_source(spark, sf):
    arrays = table(spark, sf, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("rows_json"))
    return files.explode_json_rows(arrays, "rows_json", T.StructType([T.StructField("k", T.LongType())]), ("event_id",))


@query(
    "json_array_file",
    """SELECT c_custkey, c_name || ' "{[\\' || c_mktsegment || '}],' AS note, c_acctbal,
              '{"nation":' || c_nationkey || ',"tags":["}","]"]}' AS detail FROM customer""",
)
def json_array_file(spark, sf):
    """All customers as one JSON array in one file, read by many tasks. The strings hold quotes, escapes, braces and brackets."""
    path, customer = workspace(spark, "json-array"), table(spark, sf, "customer")
    note = F.concat("c_name", F.lit(' "{[\\'), "c_mktsegment", F.lit("}],"))
    detail = F.struct(F.col("c_nationkey").alias("nation"), F.array(F.lit("}"), F.lit("]")).alias("tags"))
    rows = customer.select("c_custkey", note.alias("note"), "c_acctbal", detail.alias("detail"))
    # One file is what a single task writes; reading it is not.
    first, last = rows.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    begins, ends = F.when(F.col("c_custkey") == first, "[").otherwise(","), F.when(F.col("c_custkey") == last, "]").otherwise("")
    lines = rows.select("c_custkey", F.concat(begins, F.to_json(F.struct("*")), ends).alias("value"))
    lines.coalesce(1).sortWithinPartitions("c_custkey").select("value").write.text(path)
    schema = T.StructType.fromDDL("c_custkey long, note string, c_acctbal double, detail string")
    return files.read_json_rows(spark, path, schema)


@query(
    "json_rows_sink",
    """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":'
              || CAST(o_totalprice AS VARCHAR) || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f')
              || '","o_note":null}' AS row_json
       FROM orders""",
)
def json_rows_sink(spark, sf):
    path = workspace(spark, "json-rows")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.lit(None).cast("string").alias("o_note")
    )
    files.write_json_lines(rows, path)
    return spark.read.text(path).select(F.col("value").alias("row_json"))


def _orders_log(spark: SparkSession, sf: str) -> SnapshotTable:
    """A snapshot table of all orders in three loads, by order date."""
    log, orders = SnapshotTable(spark, workspace(spark, "orders-log")), table(spark, sf, "orders")
    log.create(orders.where("o_orderdate < '1997-01-01'"))
    log.append(orders.where("o_orderdate >= '1997-01-01' AND o_orderdate < '2000-01-01'"))
    log.append(orders.where("o_orderdate >= '2000-01-01'"))
    return log


@query("snapshot_current", "SELECT * FROM orders")
def snapshot_current(spark, sf):
    return _orders_log(spark, sf).read()


@query("snapshot_as_of", "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def snapshot_as_of(spark, sf):
    return _orders_log(spark, sf).read_as_of(2)


def _evolving_log(spark: SparkSession, sf: str) -> SnapshotTable:
    """Orders in three loads: before the second a column is renamed and one widened, before the third two columns are added, one under
    the name that was given up."""
    log, orders = SnapshotTable(spark, workspace(spark, "evolving")), table(spark, sf, "orders")
    rows = orders.select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderstatus", "o_orderdate")
    log.create(rows.where("o_orderdate < '1997-01-01'"))
    log.evolve(rename={"o_orderstatus": "state"}, widen={"o_custkey": T.LongType()})
    later = rows.withColumnRenamed("o_orderstatus", "state").withColumn("o_custkey", F.col("o_custkey") + 3_000_000_000)
    log.append(later.where("o_orderdate >= '1997-01-01' AND o_orderdate < '2000-01-01'"))
    newest = later.withColumns({"o_orderstatus": F.lit("new"), "half": F.col("o_orderkey") / 2})
    log.append_evolving(newest.where("o_orderdate >= '2000-01-01'"))
    return log


_EVOLVED_SQL = """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN o_custkey ELSE o_custkey + 3000000000 END AS o_custkey,
       o_orderstatus AS state, o_orderdate, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'new' END AS o_orderstatus,
       CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN o_orderkey / 2 END AS half FROM orders"""


@query("snapshot_evolved_current", _EVOLVED_SQL)
def snapshot_evolved_current(spark, sf):
    return _evolving_log(spark, sf).read()


@query("snapshot_evolved_as_of", f"SELECT o_orderkey, o_custkey, state, o_orderdate FROM ({_EVOLVED_SQL}) WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def snapshot_evolved_as_of(spark, sf):
    """The first two loads, in today's columns; those that came later are empty, and left out of the result."""
    return _evolving_log(spark, sf).read_as_of(3).where("half IS NULL AND o_orderstatus IS NULL").drop("half", "o_orderstatus")


# --- Sinks -------------------------------------------------------------------------------------


@query("parquet_sink", "SELECT * FROM lineitem")
def parquet_sink(spark, sf):
    path, lineitem = workspace(spark, "parquet"), table(spark, sf, "lineitem")
    files.write_parquet(lineitem, path, compression="gzip")
    return files.read_parquet(spark, path, lineitem.schema)


@query("run_date_partition_sink", "SELECT *, '2024' AS year, '03' AS month, '07' AS day FROM customer")
def run_date_partition_sink(spark, sf):
    path, customer = workspace(spark, "run-date"), table(spark, sf, "customer")
    for _ in range(2):
        files.write_run_date(customer, path, "2024-03-07")
    return files.read_day_range(spark, path, "2024-03-07", "2024-03-07", customer.schema)


@query(
    "data_date_partition_sink",
    "SELECT *, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day FROM events",
)
def data_date_partition_sink(spark, sf):
    path, events = workspace(spark, "data-date"), table(spark, sf, "events")
    files.write_data_date(events, path, "ts")
    return files.read_day_range(spark, path, "2024-01-01", "2024-12-31", events.schema)


@query("jdbc_append", "SELECT * FROM customer")
def jdbc_append(spark, sf):
    db, customer = database(spark), table(spark, sf, "customer")
    name = database_table(db, customer.where("c_acctbal < 0"), "customer")
    jdbc.append_rows(customer.where("c_acctbal >= 0"), db, name)
    jdbc.append_new_rows(customer, db, name, ["c_custkey"])
    return jdbc.read_table(spark, db, name)


@query("jdbc_truncate_load", "SELECT * FROM supplier")
def jdbc_truncate_load(spark, sf):
    db, supplier = database(spark), table(spark, sf, "supplier")
    name = database_table(db, supplier.withColumn("s_acctbal", F.lit(0.0)), "supplier")
    jdbc.truncate_load(supplier, db, name)
    return jdbc.read_table(spark, db, name)


@query("snapshot_create", "SELECT * FROM customer")
def snapshot_create(spark, sf):
    log = SnapshotTable(spark, workspace(spark, "created"))
    log.create(table(spark, sf, "customer"))
    return log.read()


@query("snapshot_append", "SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_acctbal > 5000")
def snapshot_append(spark, sf):
    log, customer = SnapshotTable(spark, workspace(spark, "appended")), table(spark, sf, "customer")
    log.create(customer)
    log.append(customer.where("c_acctbal > 5000"))
    log.append(customer.where("c_custkey < 0"))
    return log.read()


@query(
    "file_rolling",
    "SELECT count(*) AS total_rows, true AS within_limit, true AS several_files FROM lineitem",
)
def file_rolling(spark, sf):
    path = workspace(spark, "rolled")
    files.write_parquet(table(spark, sf, "lineitem"), path, max_records_per_file=25_000)
    return files.file_stats(spark, path).agg(
        F.sum("record_count").alias("total_rows"),
        (F.max("record_count") <= 25_000).alias("within_limit"),
        (F.count(F.lit(1)) >= F.ceil(F.sum("record_count") / 25_000)).alias("several_files"),
    )


@query("csv_export", "SELECT * FROM part")
def csv_export(spark, sf):
    path, part = workspace(spark, "csv"), table(spark, sf, "part")
    files.write_csv(part, path, ["p_partkey"])
    return files.read_csv(spark, path, part.schema)


# --- Windows, projections, casts ---------------------------------------------------------------


@query(
    "date_window_single_day",
    "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'",
)
def date_window_single_day(spark, sf):
    return projection.extract(table(spark, sf, "events"), date_window("ts", "2024-01-05", "2024-01-05"))


@query(
    "date_window_range",
    """SELECT strftime(ts, '%Y-%m-%d') AS event_day, count(*) AS events,
              round(sum(value), 2) AS total_value
       FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12' GROUP BY 1""",
)
def date_window_range(spark, sf):
    rows = projection.extract(table(spark, sf, "events"), date_window("ts", "2024-01-05", "2024-01-12"))
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("event_day")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total_value")
    )


@query("int_date_window", f"SELECT * FROM ({ORDER_DAYS_SQL}) WHERE order_day BETWEEN 19960115 AND 19960331")
def int_date(spark, sf):
    return projection.extract(order_days(spark, sf), int_date_window("order_day", "1996-01-15", "1996-03-31"))


@query("int_month_window", f"SELECT * FROM ({ORDER_DAYS_SQL}) WHERE order_month = 199803")
def int_month(spark, sf):
    return projection.extract(order_days(spark, sf), int_date_window("order_month", "1998-03-05", "1998-03-20", "yyyyMM"))


@query(
    "scd2_window",
    f"""SELECT * FROM ({VERSIONS_SQL})
        WHERE "EffectiveDate" >= TIMESTAMP '1996-01-01' AND "EffectiveDate" <= TIMESTAMP '1997-12-31'
          AND ("ExpirationDate" > TIMESTAMP '1997-12-31' OR "ExpirationDate" IS NULL)""",
)
def scd2(spark, sf):
    return projection.extract(order_versions(spark, sf), scd2_window("EffectiveDate", "1996-01-01", "1997-12-31"))


@query("static_extract", "SELECT * FROM part")
def static_extract(spark, sf):
    return projection.extract(table(spark, sf, "part"), make_window("static"))


@query(
    "window_and_where",
    """SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'
       AND (o_orderstatus = 'F' OR o_totalprice > 400000)""",
)
def window_where(spark, sf):
    window = make_window("date", column="o_orderdate", start="1997-01-01", end="1997-12-31")
    return table(spark, sf, "orders").where(window_and_where(window, "o_orderstatus = 'F' OR o_totalprice > 400000"))


@query(
    "project_filter_sort",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
       WHERE c_acctbal > 1000 AND c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey""",
)
def project_filter_sort(spark, sf):
    return projection.project_filter_sort(
        table(spark, sf, "customer"),
        {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal"},
        "c_acctbal > 1000 AND c_mktsegment = 'MACHINERY'",
        [F.desc("balance"), F.asc("id")],
    )


DECLARED_ORDERS = [
    Field("o_orderkey", "bigint", required=True),
    Field("o_custkey", "int", required=True),
    Field("o_orderstatus", "char(1)", required=True),
    Field("o_totalprice", "decimal(18,2)"),
    Field("o_orderdate", "date"),
    Field("o_orderpriority", "nvarchar(20)"),
]


@query(
    "canonical_types",
    """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
              CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice,
              strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS o_orderdate, o_orderpriority
       FROM orders""",
)
def canonical_types(spark, sf):
    typed = projection.canonicalise(table(spark, sf, "orders"), DECLARED_ORDERS)
    # Shown as text: decimals and dates reach a client in different forms.
    return typed.withColumns({c: F.col(c).cast("string") for c in ("o_totalprice", "o_orderdate")})


@query(
    "align_schema",
    """SELECT o_totalprice, o_orderkey, CAST(NULL AS VARCHAR) AS o_clerk, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
)
def align_schema(spark, sf):
    target = T.StructType.fromDDL("o_totalprice double, o_orderkey bigint, o_clerk string, o_custkey string")
    return projection.align(table(spark, sf, "orders"), target)


REQUIRED_PART = [
    Field("p_partkey", "bigint", required=True),
    Field("p_name", "nvarchar(100)", required=True),
    Field("p_brand", "nvarchar(20)", required=True),
    Field("p_size", "int", required=True),
    Field("p_retailprice", "float"),
]


@query(
    "required_fill",
    f"""SELECT p_partkey, p_name, coalesce(p_brand, '') AS p_brand, coalesce(p_size, 0) AS p_size, p_retailprice
        FROM ({PART_GAPS_SQL})""",
)
def required_fill(spark, sf):
    return projection.fill_required(part_gaps(spark, sf), REQUIRED_PART)


@query("to_utc", "SELECT event_id, ts + INTERVAL '5' HOUR AS ts_utc FROM events")
def to_utc(spark, sf):
    # All events are in January, so New York is five hours behind.
    return table(spark, sf, "events").select("event_id", projection.to_utc(F.col("ts"), "America/New_York").alias("ts_utc"))


@query(
    "row_limit",
    "SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def row_limit(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return projection.row_limit(rows, 100, [F.desc("o_totalprice"), F.asc("o_orderkey")])


# --- Joins and merges --------------------------------------------------------------------------


@query("merge_append", APPEND_SQL)
def merge_append(spark, sf):
    return merge.merge(orders_base(spark, sf), orders_changes(spark, sf), ["o_orderkey"], "append")


@query("merge_upsert", UPSERT_SQL)
def merge_upsert(spark, sf):
    return merge.merge(orders_base(spark, sf), orders_changes(spark, sf), ["o_orderkey"], "upsert")


@query("keyed_table_append", APPEND_SQL)
def keyed_table_append(spark, sf):
    target = KeyedTable(spark, workspace(spark, "keyed-append"), ["o_orderkey"], HashBuckets(8))
    target.create(orders_base(spark, sf))
    target.merge(orders_changes(spark, sf), "append")
    return target.read()


@query("keyed_table_upsert", UPSERT_SQL)
def keyed_table_upsert(spark, sf):
    target = KeyedTable(spark, workspace(spark, "keyed-upsert"), ["o_orderkey"], HashBuckets(8))
    target.create(orders_base(spark, sf))
    target.merge(orders_changes(spark, sf), "upsert")
    return target.read()


def revised_base(spark: SparkSession, sf: str) -> DataFrame:
    return orders_base(spark, sf).withColumn("revision", F.lit(5).cast("long"))


def late_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of which about half are older revisions than what an earlier load brought, and a tenth the same ones."""
    return orders_changes(spark, sf).withColumn("revision", F.col("o_orderkey") % 10)


LATE_SQL = f"""
WITH base AS (SELECT *, CAST(5 AS BIGINT) AS revision FROM ({BASE_SQL})),
     changes AS (SELECT *, o_orderkey % 10 AS revision FROM ({CHANGES_SQL})),
     applied AS (SELECT c.* FROM changes c LEFT JOIN base b ON b.o_orderkey = c.o_orderkey WHERE b.revision IS NULL OR c.revision >= b.revision)
SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM applied a WHERE a.o_orderkey = b.o_orderkey)
UNION ALL SELECT * FROM applied"""


@query("merge_upsert_late", LATE_SQL)
def merge_upsert_late(spark, sf):
    return merge.merge(revised_base(spark, sf), late_changes(spark, sf), ["o_orderkey"], "upsert", latest_by="revision")


@query(
    "merge_action_counts",
    f"""WITH base AS ({BASE_SQL}), changes AS ({CHANGES_SQL})
        SELECT CASE WHEN b.o_orderkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action, count(*) AS row_count
        FROM changes c LEFT JOIN base b ON b.o_orderkey = c.o_orderkey GROUP BY 1""",
)
def merge_action_counts(spark, sf):
    return merge.merge_action_counts(orders_base(spark, sf), orders_changes(spark, sf), ["o_orderkey"])


@query(
    "staged_import",
    """SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS c_nationkey,
              CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment
       FROM customer""",
)
def staged_import(spark, sf):
    db, customer = database(spark), table(spark, sf, "customer")
    name = database_table(db, customer.where("c_acctbal > 0"), "customer", key="c_custkey")
    building = F.col("c_mktsegment") == "BUILDING"
    changes = customer.where(building).withColumn("c_acctbal", F.col("c_acctbal") + 1.0).drop("c_nationkey")
    jdbc.merge_rows(changes, db, name, ["c_custkey"], "upsert")
    jdbc.merge_rows(customer, db, name, ["c_custkey"], "append")
    return jdbc.read_table(spark, db, name)


RECONCILE_SQL = f"""
WITH s AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{LOADED_BEFORE}'), t AS ({CHANGES_SQL}
    UNION ALL SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{CHANGED_SINCE}' AND o_orderstatus <> 'P')
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
       s.o_orderstatus AS o_orderstatus_source, t.o_orderstatus AS o_orderstatus_target,
       s.o_totalprice AS o_totalprice_source, t.o_totalprice AS o_totalprice_target,
       CASE WHEN s.o_orderkey IS NULL THEN 0 ELSE 1 END AS source_rows,
       CASE WHEN t.o_orderkey IS NULL THEN 0 ELSE 1 END AS target_rows,
       CASE WHEN s.o_orderstatus = t.o_orderstatus AND s.o_totalprice = t.o_totalprice THEN 'MATCH' ELSE 'MISMATCH' END AS status
FROM s {{join}} JOIN t ON s.o_orderkey = t.o_orderkey"""


def _reconcile_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    early = table(spark, sf, "orders").where(f"o_orderdate < '{CHANGED_SINCE}' AND o_orderstatus <> 'P'")
    return orders_base(spark, sf), orders_changes(spark, sf).unionByName(early)


def _int_counts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("int") for c in ("source_rows", "target_rows")})


@query("reconcile_rows", RECONCILE_SQL.format(join="FULL OUTER"))
def reconcile_rows(spark, sf):
    source, target = _reconcile_sides(spark, sf)
    return _int_counts(reconcile.reconcile_rows(source, target, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]))


@query("reconcile_inner", RECONCILE_SQL.format(join="INNER"))
def reconcile_inner(spark, sf):
    source, target = _reconcile_sides(spark, sf)
    return _int_counts(reconcile.reconcile_inner(source, target, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]))


def drifted_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A copy of the orders that has drifted in two places: changed prices, a missing one, and rows that are gone or too many."""
    key, orders = F.col("o_orderkey"), table(spark, sf, "orders")
    changed = key.between(200, 230)
    price = F.when(key != 205, F.when(changed, F.col("o_totalprice") + 1.0).otherwise(F.col("o_totalprice")))
    copy = orders.where(~key.between(900, 909)).withColumn("o_totalprice", price)
    return copy.unionByName(orders.where(key.between(310, 312)).withColumn("o_orderkey", -key))


DRIFT_SQL = """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                  CASE WHEN o_orderkey = 205 THEN NULL WHEN o_orderkey BETWEEN 200 AND 230 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice
           FROM orders WHERE o_orderkey NOT BETWEEN 900 AND 909
           UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey BETWEEN 310 AND 312)
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
       s.o_orderstatus AS o_orderstatus_source, t.o_orderstatus AS o_orderstatus_target,
       s.o_totalprice AS o_totalprice_source, t.o_totalprice AS o_totalprice_target,
       CASE WHEN s.o_orderkey IS NULL THEN 0 ELSE 1 END AS source_rows,
       CASE WHEN t.o_orderkey IS NULL THEN 0 ELSE 1 END AS target_rows, 'MISMATCH' AS status
FROM orders s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey
WHERE (s.o_orderstatus = t.o_orderstatus AND s.o_totalprice = t.o_totalprice) IS NOT TRUE"""


@query("reconcile_by_digest", DRIFT_SQL)
def reconcile_by_digest(spark, sf):
    source, target = digest.FrameSide(table(spark, sf, "orders")), digest.FrameSide(drifted_orders(spark, sf))
    return _int_counts(digest.reconcile_by_digest(source, target, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], leaf_rows=100)[0])


@query("reconcile_by_digest_database", DRIFT_SQL)
def reconcile_by_digest_database(spark, sf):
    """The copy is a database table, which sums itself up."""
    db, texts = database(spark), {"o_totalprice": digest.hundredths()}
    spelled = digest.DERBY if ":derby:" in db.url else digest.SQL_SERVER
    for function in spelled.functions:
        jdbc.execute(spark, db, function)
    name = database_table(db, drifted_orders(spark, sf), "orders_drift")
    source = digest.FrameSide(table(spark, sf, "orders"), texts)
    target = digest.DatabaseSide(spark, db, name, spelled, texts)
    return _int_counts(digest.reconcile_by_digest(source, target, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], leaf_rows=100)[0])


@query(
    "customer_order_summary",
    """SELECT c.c_custkey, c.c_name, c.c_acctbal, count(o.o_orderkey) AS orders_placed,
              coalesce(round(sum(o.o_totalprice), 2), 0.0) AS amount_ordered
       FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
       GROUP BY c.c_custkey, c.c_name, c.c_acctbal ORDER BY amount_ordered DESC, c.c_custkey""",
)
def customer_order_summary(spark, sf):
    totals = summary.order_totals_by_owner(
        table(spark, sf, "customer"),
        "c_custkey",
        ["c_name", "c_acctbal"],
        table(spark, sf, "orders"),
        "o_custkey",
        "o_orderkey",
        "o_totalprice",
    )
    return _rounded(totals, amount_ordered=2)


# --- History and differences -------------------------------------------------------------------


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    """An audit log of customers: the status of each order as that of its customer, sent again whenever there is an order."""
    return table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")


INTERVALS_SQL = """
WITH v AS (SELECT o_custkey, o_orderdate AS t, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2),
     c AS (SELECT *, lag(s) OVER (PARTITION BY o_custkey ORDER BY t) AS p FROM v)
SELECT o_custkey, s AS o_orderstatus, t AS valid_from, lead(t) OVER (PARTITION BY o_custkey ORDER BY t) AS valid_to
FROM c WHERE p IS DISTINCT FROM s"""


@query("validity_intervals", INTERVALS_SQL)
def validity_intervals(spark, sf):
    return history.validity_intervals(status_log(spark, sf), ["o_custkey"], "o_orderdate", bucket="year")


@query(
    "as_of_join",
    f"""WITH i AS ({INTERVALS_SQL}), f AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL '45' DAY AS due FROM orders
                                            UNION ALL SELECT o_orderkey, o_custkey, TIMESTAMP '1990-01-01' FROM orders WHERE o_orderstatus = 'P')
        SELECT f.*, i.o_orderstatus, i.valid_from, i.valid_to
        FROM f LEFT JOIN i ON i.o_custkey = f.o_custkey AND f.due >= i.valid_from AND (i.valid_to IS NULL OR f.due < i.valid_to)""",
)
def as_of_join(spark, sf):
    """Orders with the status their customer had 45 days later, and some from before there was any."""
    orders = table(spark, sf, "orders")
    due = orders.select("o_orderkey", "o_custkey", F.expr("o_orderdate + INTERVAL '45' DAY").alias("due"))
    early = orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", F.lit("1990-01-01").cast("timestamp_ntz").alias("due"))
    versions = history.validity_intervals(status_log(spark, sf), ["o_custkey"], "o_orderdate", bucket="year")
    return history.as_of_join(due.unionByName(early), versions, ["o_custkey"], "due")


_DRIFTED_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey = 205 THEN NULL WHEN o_orderkey BETWEEN 200 AND 230 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority FROM orders WHERE o_orderkey NOT BETWEEN 900 AND 909
UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 310 AND 312"""


@query(
    "state_difference",
    f"""WITH z AS ({_DRIFTED_SQL})
        SELECT z.*, CASE WHEN a.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS change FROM z LEFT JOIN orders a ON a.o_orderkey = z.o_orderkey
        WHERE a.o_orderkey IS NULL OR a.o_totalprice IS DISTINCT FROM z.o_totalprice
        UNION ALL SELECT a.*, 'delete' FROM orders a WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.o_orderkey = a.o_orderkey)""",
)
def state_difference(spark, sf):
    return history.state_difference(table(spark, sf, "orders"), drifted_orders(spark, sf), ["o_orderkey"])


@query("change_feed_applied", _DRIFTED_SQL)
def change_feed_applied(spark, sf):
    """The difference of two loads, merged into a keyed table that holds the first."""
    orders = table(spark, sf, "orders")
    target = KeyedTable(spark, workspace(spark, "feed"), ["o_orderkey"], HashBuckets(8))
    target.create(orders)
    feed = history.state_difference(orders, drifted_orders(spark, sf), ["o_orderkey"])
    target.merge(feed, deleted=F.col(history.CHANGE) == history.DELETE)
    return target.read()


@query(
    "snapshot_change_feed",
    f"""WITH base AS ({BASE_SQL}), changes AS ({CHANGES_SQL})
        SELECT c.*, 2 AS revision, CASE WHEN EXISTS (SELECT 1 FROM base b WHERE b.o_orderkey = c.o_orderkey) THEN 'update' ELSE 'insert' END AS change
        FROM changes c""",
)
def snapshot_change_feed(spark, sf):
    """What three further loads of a log changed, net: drafts, changes, and repeats of what was there."""
    log, changes = SnapshotTable(spark, workspace(spark, "log-feed")), orders_changes(spark, sf)
    base = orders_base(spark, sf).withColumn("revision", F.lit(0))
    log.create(base)
    log.append(changes.withColumns({"o_totalprice": F.lit(0.0), "revision": F.lit(1)}))
    log.append(changes.withColumn("revision", F.lit(2)))
    log.append(base.where(f"o_orderdate < '{CHANGED_SINCE}'"))
    return history.log_difference(log, ["o_orderkey"], "revision", 1, 4)


# --- Aggregates --------------------------------------------------------------------------------


@query(
    "filtered_count",
    """SELECT count(*) AS row_count FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AND (o_totalprice > 100000)""",
)
def filtered_count(spark, sf):
    return summary.filtered_count(
        table(spark, sf, "orders"), date_window("o_orderdate", "1996-01-01", "1996-12-31"), "o_totalprice > 100000"
    )


@query(
    "dry_run_count",
    "SELECT 'lineitem' AS table_name, count(*) AS row_count FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' "
    "AND l_shipdate <= TIMESTAMP '1997-06-30'",
)
def dry_run_count(spark, sf):
    window = date_window("l_shipdate", "1997-01-01", "1997-06-30")
    return summary.filtered_count(table(spark, sf, "lineitem"), window).select(F.lit("lineitem").alias("table_name"), "row_count")


def _verify_sql(tables: dict[str, str]) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS s, (SELECT count(*) FROM {name} WHERE {kept}) AS t"
        for name, kept in tables.items()
    )
    return f"""
SELECT table_name, s AS source_count, t AS target_count, t - s AS difference,
       CASE WHEN s = t THEN 'MATCH' ELSE 'MISMATCH' END AS status,
       CASE WHEN s = t THEN 'row counts match: ' || s
            ELSE 'row counts differ: source=' || s || ', target=' || t || ', difference=' || (t - s) END AS message
FROM ({counts})"""


VERIFIED_TABLES = {"customer": "c_acctbal >= 0", "orders": "o_orderdate < TIMESTAMP '2000-01-01'", "part": "true", "lineitem": "true"}


def _verify(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    source = {n: table(spark, sf, n) for n in names}
    target = {n: df.where(VERIFIED_TABLES[n]) for n, df in source.items()}
    return reconcile.verify_counts(source, target)


@query("verify_counts", _verify_sql({"orders": VERIFIED_TABLES["orders"]}))
def verify_counts(spark, sf):
    return _verify(spark, sf, ["orders"])


@query("verify_counts_all", _verify_sql(VERIFIED_TABLES))
def verify_counts_all(spark, sf):
    return _verify(spark, sf, list(VERIFIED_TABLES))


@query(
    "account_summary",
    """SELECT min(c_acctbal) AS least, max(c_acctbal) AS greatest, round(sum(c_acctbal), 2) AS held,
              round(avg(c_acctbal), 6) AS mean, round(sum(c_acctbal) FILTER (WHERE c_acctbal <= 0), 2) AS owed,
              count(*) FILTER (WHERE c_acctbal > 0) AS in_credit, count(*) FILTER (WHERE c_acctbal <= 0) AS in_debt, count(*) AS rows
       FROM customer""",
)
def account_summary(spark, sf):
    balance = F.col("c_acctbal")
    measures = [
        summary.Measure("least", "least", "c_acctbal"),
        summary.Measure("greatest", "greatest", "c_acctbal"),
        summary.Measure("held", "total", "c_acctbal"),
        summary.Measure("mean", "average", "c_acctbal"),
        summary.Measure("owed", "total", "c_acctbal", when=balance <= 0),
        summary.Measure("in_credit", "rows", when=balance > 0),
        summary.Measure("in_debt", "rows", when=balance <= 0),
        summary.Measure("rows", "rows"),
    ]
    return _rounded(summary.conditional_summary(table(spark, sf, "customer"), measures), held=2, mean=6, owed=2)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums and averages of doubles, shown to the digits that do not depend on the order of addition."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "orders_summary",
    """SELECT min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, round(avg(o_totalprice), 6) AS mean_price,
              round(sum(o_totalprice), 2) AS price_sum, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders, count(*) AS orders
       FROM orders""",
)
def orders_summary(spark, sf):
    measures = [
        summary.Measure("first_day", "least", "o_orderdate"),
        summary.Measure("last_day", "greatest", "o_orderdate"),
        summary.Measure("mean_price", "average", "o_totalprice"),
        summary.Measure("price_sum", "total", "o_totalprice"),
        summary.Measure("open_orders", "rows", when=F.col("o_orderstatus") == "O"),
        summary.Measure("orders", "rows"),
    ]
    return _rounded(summary.conditional_summary(table(spark, sf, "orders"), measures), mean_price=6, price_sum=2)


@query(
    "null_counts_compare",
    f"""SELECT 'source' AS side, 0 AS p_brand_nulls, 0 AS p_size_nulls, 0 AS p_name_nulls
        UNION ALL SELECT 'target', count(*) FILTER (WHERE p_brand IS NULL), count(*) FILTER (WHERE p_size IS NULL),
               count(*) FILTER (WHERE p_name IS NULL) FROM ({PART_GAPS_SQL})""",
)
def null_counts_compare(spark, sf):
    return reconcile.null_counts_compare(table(spark, sf, "part"), part_gaps(spark, sf), ["p_brand", "p_size", "p_name"])


_RANGE = """SELECT '{side}' AS side, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice,
       round(avg(o_totalprice), 6) AS avg_o_totalprice,
       min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate FROM ({rows})"""


@query(
    "range_compare",
    _RANGE.format(side="source", rows=BASE_SQL) + " UNION ALL " + _RANGE.format(side="target", rows=CHANGES_SQL),
)
def range_compare(spark, sf):
    return _rounded(reconcile.range_compare(orders_base(spark, sf), orders_changes(spark, sf), ["o_totalprice"], ["o_orderdate"]), avg_o_totalprice=6)


# The columns of part_gaps and their types.
_GAP_COLUMNS = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_size": "int", "p_retailprice": "double"}


@query(
    "column_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null_count, count(*) - count({c}) AS null_count "
        f"FROM ({PART_GAPS_SQL})"
        for c, t in _GAP_COLUMNS.items()
    ),
)
def column_stats(spark, sf):
    return summary.column_stats(part_gaps(spark, sf))


@query(
    "snapshot_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS rows, count(*) AS non_null_count, CAST(0 AS BIGINT) AS null_count, true AS distinct_close,
            {f"CAST(min({c}) AS DOUBLE)" if n else "CAST(NULL AS DOUBLE)"} AS least, {f"CAST(max({c}) AS DOUBLE)" if n else "CAST(NULL AS DOUBLE)"} AS greatest,
            true AS quartiles_close FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'"""
        for c, n in (("o_orderkey", 1), ("o_custkey", 1), ("o_orderstatus", 0), ("o_totalprice", 1), ("o_orderdate", 0), ("o_orderpriority", 0))
    ),
)
def snapshot_profile(spark, sf):
    """The profile of a table's first two loads, merged from what was kept when they were written, beside exact figures of the rows."""
    log, orders = SnapshotTable(spark, workspace(spark, "profiled"), profiled=True), table(spark, sf, "orders")
    log.create(orders.where("o_orderdate < '1997-01-01'"))
    log.append(orders.where("o_orderdate >= '1997-01-01' AND o_orderdate < '2000-01-01'"))
    log.append(orders.where("o_orderdate >= '2000-01-01'"))
    rows, numbers = orders.where("o_orderdate < '2000-01-01'"), ["o_orderkey", "o_custkey", "o_totalprice"]
    at = (0.2, 0.3, 0.45, 0.55, 0.7, 0.8)
    distinct = reconcile.union_all([rows.agg(F.lit(c).alias("column_name"), F.count_distinct(c).alias("distinct")) for c in orders.columns])
    percentiles = summary.exact_percentiles(rows, numbers, at).select("column_name", *[F.get("percentiles", F.lit(i)).alias(f"p{p}") for i, p in enumerate(at)])
    exact = distinct.join(percentiles, "column_name", "left")
    between = [F.coalesce(F.col(f"quantile_{q}").between(F.col(f"`p{a}`"), F.col(f"`p{b}`")), F.lit(True)) for q, a, b in ((25, 0.2, 0.3), (50, 0.45, 0.55), (75, 0.7, 0.8))]
    return log.profile(2).join(exact, "column_name").select(
        "column_name",
        "rows",
        "non_null_count",
        "null_count",
        (F.abs(F.col("distinct_estimate") - F.col("distinct")) <= 0.08 * F.col("distinct")).alias("distinct_close"),
        "least",
        "greatest",
        (between[0] & between[1] & between[2]).alias("quartiles_close"),
    )


# The schema each table is filed under, and its column count.
TABLE_SCHEMAS = {
    "region": "geo",
    "nation": "geo",
    "customer": "sales",
    "supplier": "stock",
    "part": "stock",
    "orders": "sales",
    "lineitem": "sales",
    "events": "logs",
}
_COLUMN_COUNTS = {
    "region": 2,
    "nation": 3,
    "customer": 5,
    "supplier": 4,
    "part": 6,
    "orders": 6,
    "lineitem": 11,
    "events": 6,
}
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{TABLE_SCHEMAS[n]}' AS schema_name, '{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count, "
    f"CAST({c} AS BIGINT) AS column_count"
    for n, c in _COLUMN_COUNTS.items()
)


@query("table_profile", PROFILE_SQL)
def table_profile(spark, sf):
    return profile.table_profile(spark, work_tables(spark, sf), TABLE_SCHEMAS)


@query(
    "database_profile",
    " UNION ALL ".join(
        f"SELECT 'APP' AS schema_name, upper('{n}') AS table_name, (SELECT count(*) FROM {n}) AS row_count, CAST({_COLUMN_COUNTS[n]} AS BIGINT) AS column_count"
        for n in ("region", "nation", "supplier")
    ),
)
def database_profile(spark, sf):
    db = database(spark)
    made = {database_table(db, table(spark, sf, n), n): n.upper() for n in ("region", "nation", "supplier")}
    found = {name: rows for name, rows in jdbc.discover(spark, db, ["APP"]).items() if name.partition(".")[2] in {m.upper() for m in made}}
    names = F.create_map(*[F.lit(x) for made_name, n in made.items() for x in (made_name.upper(), n)])
    return profile.database_profile(spark, found).withColumn("table_name", names[F.upper("table_name")])


@query(
    "schema_totals",
    f"""SELECT schema_name, count(*) AS total_tables, CAST(sum(row_count) AS BIGINT) AS total_rows,
               CAST(sum(column_count) AS BIGINT) AS total_columns FROM ({PROFILE_SQL}) GROUP BY 1""",
)
def schema_totals(spark, sf):
    return profile.schema_totals(profile.table_profile(spark, work_tables(spark, sf), TABLE_SCHEMAS))


@query("find_table", f"SELECT * FROM ({PROFILE_SQL}) WHERE schema_name = 'sales' AND table_name = 'orders'")
def find_table(spark, sf):
    return profile.find_table(profile.table_profile(spark, work_tables(spark, sf), TABLE_SCHEMAS), "SALES", "Orders")


# The dated column of each advised table, if any, and the window it suggests.
_DATED = {
    "region": None,
    "nation": None,
    "customer": None,
    "supplier": None,
    "part": None,
    "orders": ("o_orderdate", "date"),
    "lineitem": ("l_shipdate", "date"),
    "events": ("ts", "date"),
    "order_days": ("order_day", "int_date"),
}


def _advice_sql(name: str, dated: tuple[str, str] | None) -> str:
    source = f"({ORDER_DAYS_SQL})" if name == "order_days" else name
    kind, column, confidence = ("'static'", "NULL", 0.6) if dated is None else (f"'{dated[1]}'", f"'{dated[0]}'", 0.8)
    return f"""SELECT '{name}' AS table_name, n AS row_count,
        CASE WHEN n < 10000 THEN 'static' ELSE {kind} END AS window_type,
        CASE WHEN n < 10000 THEN NULL ELSE {column} END AS column_name,
        CAST(NULL AS VARCHAR) AS effective_column, CAST(NULL AS VARCHAR) AS expiration_column,
        CAST(CASE WHEN n < 10000 THEN 0.85 ELSE {confidence} END AS DOUBLE) AS confidence
        FROM (SELECT count(*) AS n FROM {source})"""


@query(
    "partition_advice",
    " UNION ALL ".join(_advice_sql(n, d) for n, d in _DATED.items())
    + """ UNION ALL SELECT 'order_versions', count(*), 'scd2', NULL, 'EffectiveDate', 'ExpirationDate', CAST(0.9 AS DOUBLE)
          FROM orders""",
)
def partition_advice(spark, sf):
    tables = {**work_tables(spark, sf), "order_days": order_days(spark, sf), "order_versions": order_versions(spark, sf)}
    return profile.partition_advice(spark, tables)


@query(
    "file_stats",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS record_count, true AS has_bytes FROM {n}" for n in TABLE_SCHEMAS),
)
def file_stats(spark, sf):
    per_file = reconcile.union_all(
        [files.file_stats(spark, table_path(sf, n)).withColumn("table_name", F.lit(n)) for n in TABLE_SCHEMAS]
    )
    return per_file.groupBy("table_name").agg(
        F.sum("record_count").alias("record_count"), (F.min("file_size") > 0).alias("has_bytes")
    )


@query(
    "data_files",
    """SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 1 WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 2 ELSE 3 END
              AS snapshot_id, count(*) AS record_count, true AS has_bytes FROM orders GROUP BY 1""",
)
def data_files(spark, sf):
    """The data files of a snapshot table, newest first, summed up by snapshot: names and times differ from run to run."""
    listed = files.newest_first(_orders_log(spark, sf).files())
    return listed.groupBy(F.col("snapshot_id").cast("int").alias("snapshot_id")).agg(
        F.sum("record_count").alias("record_count"), (F.min("file_size") > 0).alias("has_bytes")
    )


@query(
    "snapshot_history",
    """WITH added AS (
         SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 1 WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 2 ELSE 3 END
                AS snapshot_id, count(*) AS rows_added FROM orders GROUP BY 1)
       SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, CAST(snapshot_id - 1 AS BIGINT) AS parent_id, rows_added,
              CAST(sum(rows_added) OVER (ORDER BY snapshot_id) AS BIGINT) AS total_rows FROM added""",
)
def snapshot_history(spark, sf):
    history = _orders_log(spark, sf).history()
    return history.select("snapshot_id", F.coalesce("parent_id", F.lit(0)).alias("parent_id"), "rows_added", "total_rows")


# --- Dedup, order, search, set operations ------------------------------------------------------


@query(
    "latest_per_key",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
              l_returnflag, l_linestatus
       FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
                 l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
                 l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def latest_per_key(spark, sf):
    return merge.latest_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate")


@query("ordered_scan", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey")
def ordered_scan(spark, sf):
    return projection.ordered(table(spark, sf, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")])


@query("top_n", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_n(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return projection.top_n(rows, 5, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(
    "contains_top_k",
    """SELECT p_name FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), 'red')
       ORDER BY length(p_name), p_name LIMIT 5""",
)
def contains_top_k(spark, sf):
    return projection.contains_top_k(table(spark, sf, "part").select("p_name").distinct(), "p_name", "RED")


@query(
    "table_counts_union",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLE_SCHEMAS),
)
def table_counts_union(spark, sf):
    return reconcile.table_counts(work_tables(spark, sf))


@query(
    "schema_diff",
    """SELECT d.*, CASE WHEN d.source_type IS NULL THEN NULL ELSE n END AS source_non_null,
              CASE WHEN d.target_type IS NULL THEN NULL WHEN d.column_name = 'o_clerk' THEN 0 ELSE n END AS target_non_null
       FROM (VALUES
         ('o_clerk', NULL, 'string', 'missing_in_source'),
         ('o_custkey', 'bigint', 'int', 'type_diff'),
         ('o_orderdate', 'timestamp_ntz', 'date', 'type_diff'),
         ('o_orderkey', 'bigint', 'bigint', 'ok'),
         ('o_orderpriority', 'string', NULL, 'missing_in_target'),
         ('o_orderstatus', 'string', 'string', 'ok'),
         ('o_totalprice', 'double', 'decimal(18,2)', 'type_diff')
       ) AS d(column_name, source_type, target_type, status), (SELECT count(*) AS n FROM orders)""",
)
def schema_diff(spark, sf):
    orders = table(spark, sf, "orders")
    target = projection.canonicalise(orders, DECLARED_ORDERS[:-1]).withColumn("o_clerk", F.lit(None).cast("string"))
    return summary.schema_report(orders, target)


# --- Scalar functions --------------------------------------------------------------------------


@query(
    "fn_date_parts",
    """SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
              'year=' || strftime(ts, '%Y') || '/month=' || strftime(ts, '%m') || '/day=' || strftime(ts, '%d') AS path
       FROM events""",
)
def fn_date_parts(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", *scalars.date_parts(ts), scalars.partition_path(ts).alias("path"))


@query("fn_int_date", ORDER_DAYS_SQL)
def fn_int_date(spark, sf):
    return order_days(spark, sf)


@query("fn_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_text FROM events")
def fn_iso_text(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.iso_text(F.col("ts")).alias("ts_text"))


@query(
    "fn_epoch_days",
    """SELECT event_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS epoch_day,
              strftime(CAST(ts AS DATE) + 30, '%Y-%m-%d') AS due_day,
              round(value, 1) AS value_rounded, coalesce(nullif(event_type, 'error'), 'none') AS kind,
              CASE WHEN ends_with(lower(event_type), 'ck') THEN true ELSE false END AS is_click
       FROM events""",
)
def fn_epoch_days(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        scalars.epoch_days(F.col("ts")).alias("epoch_day"),
        scalars.add_days(F.col("ts"), 30).cast("string").alias("due_day"),
        F.round("value", 1).alias("value_rounded"),
        F.coalesce(F.nullif(F.col("event_type"), F.lit("error")), F.lit("none")).alias("kind"),
        scalars.ends_with_ci(F.col("event_type"), "CK").alias("is_click"),
    )


# --- Incremental and streaming -----------------------------------------------------------------


@query("incremental_first", "SELECT * FROM events")
def incremental_first(spark, sf):
    return incremental.extract_changes(table(spark, sf, "events"), "ts", None)


@query("incremental_changes", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 12:30:00.250000'")
def incremental_changes(spark, sf):
    return incremental.extract_changes(table(spark, sf, "events"), "ts", "2024-01-15 12:30:00.25")


@query("incremental_by_id", "SELECT * FROM orders WHERE o_orderkey > 999")
def incremental_by_id(spark, sf):
    return incremental.extract_changes(table(spark, sf, "orders"), "o_orderkey", 999)


@query(
    "watermark_advance",
    """SELECT 'events' AS table_name, max(ts) AS last_sync_timestamp,
              count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-16')) AS row_count
       FROM events""",
)
def watermark_advance(spark, sf):
    marks, events = incremental.MarkStore(spark, workspace(spark, "marks")), table(spark, sf, "events")
    for source in (events.where("ts < '2024-01-16'"), events):
        before = marks.get("events")
        batch = incremental.extract_changes(source, "ts", before.value if before else None)
        high, rows = batch.agg(F.max("ts").cast("string"), F.count(F.lit(1))).first()
        marks.set("events", incremental.Mark(timestamp=high, rows=rows))
    return marks.read(["events"]).select("table_name", "last_sync_timestamp", "row_count")


def _sync_orders(spark: SparkSession, sf: str) -> tuple[KeyedTable, list[incremental.SyncResult]]:
    """Three cycles: a first load, a change set of updates and inserts, and nothing new."""
    root = workspace(spark, "sync")
    log, marks = SnapshotTable(spark, f"{root}/log"), incremental.MarkStore(spark, f"{root}/marks")
    target = KeyedTable(spark, f"{root}/target", ["o_orderkey"], HashBuckets(8))
    sources = [sync_source_before(spark, sf), sync_source(spark, sf), sync_source(spark, sf)]
    return target, [incremental.run_sync(s, "orders", log, target, marks, "modified") for s in sources]


@query("sync_cycle_target", SYNC_SQL)
def sync_cycle_target(spark, sf):
    return _sync_orders(spark, sf)[0].read()


@query(
    "sync_cycle_counts",
    f"""WITH mark AS (SELECT max(o_orderdate) AS m FROM orders WHERE o_orderdate <= TIMESTAMP '{SYNC_SPLIT}'),
        changed AS (SELECT s.o_orderkey, o.o_orderdate FROM ({SYNC_SQL}) s JOIN orders o ON o.o_orderkey = s.o_orderkey
                    WHERE s.modified > (SELECT m FROM mark)),
        first_load AS (SELECT count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '{SYNC_SPLIT}'),
        next_load AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '{SYNC_SPLIT}') AS u FROM changed)
        SELECT 1 AS cycle, 'orders' AS table_name, n AS extracted, n AS appended, n AS inserted, 0 AS updated FROM first_load
        UNION ALL SELECT 2, 'orders', n, n, n - u, u FROM next_load
        UNION ALL SELECT 3, 'orders', 0, 0, 0, 0""",
)
def sync_cycle_counts(spark, sf):
    return incremental.sync_results(spark, _sync_orders(spark, sf)[1]).drop("snapshot_id")


@query(
    "sync_multi_table",
    """SELECT 'orders' AS table_name, count(*) AS extracted, count(*) AS inserted, max(o_orderdate) AS last_sync_timestamp,
              CAST(NULL AS BIGINT) AS last_sync_id FROM orders
       UNION ALL SELECT 'events', count(*), count(*), max(ts), NULL FROM events
       UNION ALL SELECT 'customer', count(*), count(*), NULL, max(c_custkey) FROM customer""",
)
def sync_multi_table(spark, sf):
    root = workspace(spark, "sync-multi")
    marks = incremental.MarkStore(spark, f"{root}/marks")
    keyed = {"orders": ("o_orderkey", "o_orderdate"), "events": ("event_id", "ts"), "customer": ("c_custkey", "c_custkey")}
    tasks = [
        incremental.SyncTask(
            table(spark, sf, n),
            n,
            SnapshotTable(spark, f"{root}/{n}/log"),
            KeyedTable(spark, f"{root}/{n}/target", [key], HashBuckets(8)),
            mark,
        )
        for n, (key, mark) in keyed.items()
    ]
    results = incremental.sync_results(spark, incremental.run_syncs(tasks, marks)).select("table_name", "extracted", "inserted")
    state = marks.read(list(keyed)).select("table_name", "last_sync_timestamp", "last_sync_id")
    return results.join(state, "table_name")


@query("sync_to_database", SYNC_SQL)
def sync_to_database(spark, sf):
    """The sync job between two database tables, with the log between them."""
    root, db = workspace(spark, "sync-db"), database(spark)
    log, marks = SnapshotTable(spark, f"{root}/log"), incremental.MarkStore(spark, f"{root}/marks")
    into = database_table(db, sync_source(spark, sf), "orders_copy", key="o_orderkey", empty=True)
    target = jdbc.DatabaseTable(db, into, ["o_orderkey"])
    for rows in (sync_source_before(spark, sf), sync_source(spark, sf)):
        source = jdbc.read_table(spark, db, database_table(db, rows, "orders_source"), jdbc.Split("o_orderkey", 4))
        incremental.run_sync(source, "orders", log, target, marks, "modified")
    return jdbc.read_table(spark, db, into)


@query("stream_append_log", "SELECT * FROM events")
def stream_append_log(spark, sf):
    root, events = workspace(spark, "stream-log"), table(spark, sf, "events")
    log = SnapshotTable(spark, f"{root}/log")
    for _ in range(2):
        arriving = streams.arriving_parquet(spark, table_path(sf, "events"), events.schema)
        streams.drain(streams.stream_to_log(arriving, log, f"{root}/checkpoint", f"log-{uuid.uuid4().hex}"))
    return log.read()


@query("stream_once_each", "SELECT * FROM events")
def stream_once_each(spark, sf):
    """Events of which many stand in several files; the runs are restarts of one stream."""
    root, events = workspace(spark, "stream-once"), table(spark, sf, "events")
    log = SnapshotTable(spark, f"{root}/log")
    arrivals = [events.where("ts < '2024-01-16'"), events.where("ts >= '2024-01-10'"), events.where("event_id % 3 = 0")]
    for i, rows in enumerate(arrivals):
        files.write_parquet(rows, f"{root}/arrivals/{i}")
        arriving = streams.arriving_parquet(spark, f"{root}/arrivals", events.schema)
        once = streams.once_each(arriving, ["event_id"], "ts", "40 days")
        streams.drain(streams.stream_to_log(once, log, f"{root}/checkpoint", f"once-{uuid.uuid4().hex}"))
    return log.read()


@query("stream_upsert", UPSERT_SQL)
def stream_upsert(spark, sf):
    root = workspace(spark, "stream-upsert")
    target = KeyedTable(spark, f"{root}/target", ["o_orderkey"], HashBuckets(8))
    changes = orders_changes(spark, sf)
    drafts = changes.withColumn("o_totalprice", F.lit(0.0)).withColumn("revision", F.lit(1))
    arrivals = [
        orders_base(spark, sf).withColumn("revision", F.lit(0)),
        drafts.unionByName(changes.withColumn("revision", F.lit(2))),
    ]
    for i, rows in enumerate(arrivals):
        files.write_parquet(rows, f"{root}/arrivals/{i}")
        arriving = streams.arriving_parquet(spark, f"{root}/arrivals", rows.schema)
        streams.drain(streams.stream_upsert(arriving, target, "revision", f"{root}/checkpoint", f"upsert-{uuid.uuid4().hex}"))
    return target.read().drop("revision")


def _stream_late(spark: SparkSession, sf: str, root: str, target: KeyedTable | jdbc.DatabaseTable) -> None:
    """Three runs of a stream: a load, changes with older revisions among them, and drafts that are older than everything."""
    base, changes = revised_base(spark, sf), late_changes(spark, sf)
    drafts = base.unionByName(changes).withColumns({"o_totalprice": F.lit(0.0), "revision": F.lit(-1).cast("long")})
    for i, rows in enumerate([base, changes, drafts]):
        files.write_parquet(rows, f"{root}/arrivals/{i}")
        arriving = streams.arriving_parquet(spark, f"{root}/arrivals", rows.schema)
        streams.drain(streams.stream_upsert(arriving, target, "revision", f"{root}/checkpoint", f"late-{uuid.uuid4().hex}"))


@query("stream_upsert_late", LATE_SQL)
def stream_upsert_late(spark, sf):
    root = workspace(spark, "stream-late")
    target = KeyedTable(spark, f"{root}/target", ["o_orderkey"], HashBuckets(8))
    _stream_late(spark, sf, root, target)
    return target.read()


@query("stream_upsert_late_database", LATE_SQL)
def stream_upsert_late_database(spark, sf):
    db = database(spark)
    into = database_table(db, revised_base(spark, sf), "orders_late", key="o_orderkey", empty=True)
    _stream_late(spark, sf, workspace(spark, "stream-late-db"), jdbc.DatabaseTable(db, into, ["o_orderkey"]))
    return jdbc.read_table(spark, db, into)


# --- Transfer jobs -----------------------------------------------------------------------------


@query(
    "transfer_table",
    "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' AND (o_totalprice > 1000)",
)
def transfer_table(spark, sf):
    db, orders = database(spark), table(spark, sf, "orders")
    source = jdbc.read_table(spark, db, database_table(db, orders, "orders_source"), jdbc.Split("o_orderkey", 4))
    into = database_table(db, orders, "orders_copy", empty=True)
    selection = jobs.Selection(date_window("o_orderdate", "1996-01-01", "1997-12-31"), "o_totalprice > 1000")
    jobs.transfer_table(source, workspace(spark, "transfer"), "2024-03-07", db, into, selection)
    return jdbc.read_table(spark, db, into)


@query(
    "transfer_counts",
    """SELECT count(*) AS rows_extracted, count(*) AS rows_loaded, count(*) AS source_count, count(*) AS dest_count,
              true AS counts_match FROM customer WHERE c_acctbal > 0""",
)
def transfer_counts(spark, sf):
    db, customer = database(spark), table(spark, sf, "customer")
    into = database_table(db, customer, "customer_copy", empty=True)
    selection = jobs.Selection(where="c_acctbal > 0")
    done = jobs.transfer_table(customer, workspace(spark, "transfer"), "2024-03-07", db, into, selection, key=["c_custkey"])
    return local_rows(
        spark,
        [(done.rows_extracted, done.rows_loaded, done.source_count, done.dest_count, done.counts_match)],
        "rows_extracted long, rows_loaded long, source_count long, dest_count long, counts_match boolean",
    )


@query("transfer_to_parquet", "SELECT * FROM lineitem")
def transfer_to_parquet(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    folder, _ = jobs.to_parquet(lineitem, workspace(spark, "to-parquet"), "2024-03-07")
    return files.read_parquet(spark, folder, lineitem.schema)


@query("transfer_from_parquet", "SELECT * FROM customer")
def transfer_from_parquet(spark, sf):
    db = database(spark)
    into = database_table(db, table(spark, sf, "customer"), "customer_copy", empty=True)
    jobs.from_parquet(spark, table_path(sf, "customer"), db, into)
    return jdbc.read_table(spark, db, into)


@query(
    "transfer_to_snapshot",
    """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
              CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice,
              strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS o_orderdate, o_orderpriority
       FROM orders""",
)
def transfer_to_snapshot(spark, sf):
    log = SnapshotTable(spark, workspace(spark, "to-snapshot"))
    jobs.to_snapshot(table(spark, sf, "orders"), log, DECLARED_ORDERS)
    return log.read().withColumns({c: F.col(c).cast("string") for c in ("o_totalprice", "o_orderdate")})


@query(
    "transfer_from_snapshot",
    """SELECT c_custkey, c_name, CASE WHEN c_acctbal > 5000 THEN c_acctbal + 1.0 ELSE c_acctbal END AS c_acctbal,
              CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS revision
       FROM customer""",
)
def transfer_from_snapshot(spark, sf):
    db = database(spark)
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("revision"))
    changed = customer.where("c_acctbal > 5000").withColumns({"c_acctbal": F.col("c_acctbal") + 1.0, "revision": F.lit(2)})
    log = SnapshotTable(spark, workspace(spark, "from-snapshot"))
    log.create(customer)
    log.append(changed)
    into = database_table(db, customer.where("c_acctbal > 0"), "customer_copy", key="c_custkey")
    jobs.from_snapshot(log, db, into, ["c_custkey"], "revision")
    return jdbc.read_table(spark, db, into)


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """Four tables with different windows, one of which does not exist."""
    root = workspace(spark, "batch")
    window = {
        "orders": date_window("o_orderdate", "1996-01-01", "1996-12-31"),
        "events": date_window("ts", "2024-01-05", "2024-01-05"),
        "part": make_window("static"),
        "missing_table": make_window("static"),
    }

    def job(name: str) -> jobs.Job:
        def run() -> jobs.Transferred:
            selection, source = jobs.Selection(window[name]), table(spark, sf, name)
            _, done = jobs.to_parquet(source, f"{root}/{name}", "2024-03-07", selection)
            return jobs.Transferred(done.rows_extracted, done.rows_extracted, selection.count(source), done.rows_extracted)

        return jobs.Job(name, "table_to_parquet", run)

    run_id = jobs.run_batch(spark, [job(n) for n in window], f"{root}/run_log")
    return jobs.read_run_log(spark, f"{root}/run_log", run_id)


BATCH_SQL = """
SELECT 'orders' AS table_name, count(*) AS rows_extracted, count(*) AS source_count, true AS success
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'
UNION ALL SELECT 'events', count(*), count(*), true FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'
UNION ALL SELECT 'part', count(*), count(*), true FROM part
UNION ALL SELECT 'missing_table', 0, 0, false"""


@query("transfer_batch_log", BATCH_SQL)
def transfer_batch_log(spark, sf):
    zero = F.lit(0).cast("long")
    return _batch(spark, sf).select(
        "table_name",
        F.coalesce("rows_extracted", zero).alias("rows_extracted"),
        F.coalesce("source_count", zero).alias("source_count"),
        "success",
    )


@query(
    "batch_resume",
    """SELECT 'orders' AS table_name, 1 AS attempts, count(*) AS rows_extracted, true AS success FROM orders
       UNION ALL SELECT 'part', 1, count(*), true FROM part
       UNION ALL SELECT 'customer', 2, count(*), true FROM customer""",
)
def batch_resume(spark, sf):
    """A batch in which one table was not there yet, and its resumption, which takes that table alone."""
    root = workspace(spark, "resume")

    def job(name: str, source: str) -> jobs.Job:
        return jobs.Job(name, "table_to_parquet", lambda: jobs.to_parquet(table(spark, sf, source), f"{root}/{name}", "2024-03-07")[1])

    early = [job("orders", "orders"), job("part", "part"), job("customer", "not_yet")]
    run_id = jobs.run_batch(spark, early, f"{root}/log", pool="{table}")
    jobs.run_batch(spark, [*early[:2], job("customer", "customer")], f"{root}/log", pool="{table}", resume=run_id)
    log = jobs.read_run_log(spark, f"{root}/log", run_id)
    attempts = log.groupBy("table_name").agg(F.count(F.lit(1)).cast("int").alias("attempts"))
    return jobs.latest_outcomes(log).select("table_name", "rows_extracted", "success").join(attempts, "table_name")


@query(
    "run_log_stats",
    f"""SELECT count(*) AS total_transfers, count(*) FILTER (WHERE success) AS successful_transfers,
               count(*) FILTER (WHERE NOT success) AS failed_transfers,
               CAST(sum(rows_extracted) AS BIGINT) AS rows_transferred, true AS has_duration FROM ({BATCH_SQL})""",
)
def run_log_stats(spark, sf):
    return jobs.run_log_stats(_batch(spark, sf)).withColumn("has_duration", F.col("avg_seconds") >= 0).drop("avg_seconds")


@query(
    "validate_snapshot",
    """SELECT * FROM (
         SELECT 'table_has_columns' AS check_name, CAST(6 AS BIGINT) AS value, true AS passed
         UNION ALL SELECT 'current_snapshot_exists', 3, true
         UNION ALL SELECT 'snapshot_ids_dense', 3, true
         UNION ALL SELECT 'scanned_equals_committed', count(*), true FROM orders
         UNION ALL SELECT 'snapshots_differing', 0, true)""",
)
def validate_snapshot(spark, sf):
    return _orders_log(spark, sf).validate()


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Source and target orders reconciled row by row, summed up by outcome."""
    source, target = _reconcile_sides(spark, sf)
    rows = reconcile.reconcile_rows(source, target, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows")
    )
