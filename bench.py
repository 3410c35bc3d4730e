"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then ``$BENCH_RUNS`` times; the best run counts. Rows go to a no-op sink, so
a lazy query is executed whole. Loading the database that stands in for the source is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from drayline.functions.windows import static_window
from drayline.operators.projection import extract
from drayline.plans import catalog, jobs
from drayline.session import build_session, table_path, workspace
from drayline.sources import files, jdbc
from drayline.sources.keyed import HashBuckets, KeyedTable
from drayline.sources.snapshots import SnapshotTable
from drayline.streaming import incremental

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

# Registered queries that are timed as they are.
REGISTERED = [
    "date_window_range",
    "scd2_window",
    "latest_per_key",
    "merge_append",
    "merge_upsert",
    "merge_action_counts",
    "reconcile_rows",
    "customer_order_summary",
    "column_stats",
    "table_profile",
    "partition_advice",
    "data_date_partition_sink",
    "snapshot_current",
    "snapshot_as_of",
    "keyed_table_upsert",
    "sync_cycle_target",
    "stream_upsert",
    "transfer_to_snapshot",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    action()
    best = float("inf")
    for _ in range(RUNS):
        started = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - started)
    return round(best, 4)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", {"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}

    def measure(name, action, rows: int | None = None) -> None:
        seconds[name] = timed(action)
        if rows:
            rates[name] = round(rows / seconds[name])

    for name in REGISTERED:
        measure(name, lambda: consume(catalog.QUERIES[name](spark, SF_DIR)))

    # The published measurement: 10,000 rows of four columns, database to Parquet to database.
    db = catalog.database(spark)
    ten = spark.range(10_000).selectExpr(
        "cast(id + 1 as int) as Id",
        "concat('Name ', id) as Name",
        "cast(id * 1.5 as decimal(18,2)) as Amount",
        "date_add(date'2024-01-01', cast(id % 365 as int)) as CreatedDate",
    )
    orders = spark.read.parquet(table_path(SF_DIR, "orders"))
    n_orders = orders.count()
    lineitem = spark.read.parquet(table_path(SF_DIR, "lineitem"))
    n_lines = lineitem.count()
    ten_in = catalog.database_table(db, ten, "ten_in")
    orders_in = catalog.database_table(db, orders.repartition(8), "orders_in")

    def end_to_end(source, split, like):
        into = catalog.database_table(db, like, "out", empty=True)

        def run():
            rows = jdbc.read_table(spark, db, source, split)
            folder, _ = jobs.to_parquet(rows, workspace(spark, "bench"), "2024-03-07")
            jdbc.append_rows(files.read_parquet(spark, folder, rows.schema), db, into)

        return run

    measure("end_to_end_10k", end_to_end(ten_in, None, ten), 10_000)
    measure("end_to_end_orders", end_to_end(orders_in, jdbc.Split("o_orderkey", 8), orders), n_orders)
    measure("jdbc_extract_orders", lambda: consume(jdbc.read_table(spark, db, orders_in, jdbc.Split("o_orderkey", 8))), n_orders)
    measure("parquet_write_lineitem", lambda: files.write_parquet(lineitem, workspace(spark, "bench")), n_lines)
    measure("parquet_read_lineitem", lambda: consume(extract(lineitem, static_window())), n_lines)
    load_into = catalog.database_table(db, orders, "load", empty=True)
    measure("jdbc_bulk_load_orders", lambda: jdbc.append_rows(orders.repartition(8), db, load_into), n_orders)

    def first_sync_10k():
        root = workspace(spark, "bench-sync")
        incremental.run_sync(
            ten,
            "ten",
            SnapshotTable(spark, f"{root}/log"),
            KeyedTable(spark, f"{root}/target", ["Id"], HashBuckets(8)),
            incremental.MarkStore(spark, f"{root}/marks"),
            "CreatedDate",
        )

    measure("first_sync_10k", first_sync_10k, 10_000)
    key = catalog.database_table(db, ten.limit(0), "import_10k", key="Id")
    measure("import_merge_10k", lambda: jdbc.merge_rows(ten, db, key, ["Id"]), 10_000)

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
