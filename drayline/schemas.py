"""Schemas of the small tables the jobs keep beside the data."""

from __future__ import annotations

from pyspark.sql import types as T

COMMITS = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType(), False),
        T.StructField("parent_id", T.LongType(), True),
        T.StructField("committed_at", T.TimestampType(), False),
        T.StructField("rows_added", T.LongType(), False),
        T.StructField("files_added", T.LongType(), False),
        T.StructField("bytes_added", T.LongType(), False),
        T.StructField("total_rows", T.LongType(), False),
        T.StructField("total_files", T.LongType(), False),
        # The schema its files are written in, with field ids; the first snapshot that has it, and the last id given so far.
        T.StructField("schema_json", T.StringType(), False),
        T.StructField("schema_since", T.LongType(), False),
        T.StructField("last_field_id", T.IntegerType(), False),
        T.StructField("txn", T.StringType(), True),
    ]
)

# One row per piece in force, and one with a NULL bucket that carries the schema, the key and bucket rule, and the last batch name.
PIECES = T.StructType(
    [
        T.StructField("bucket", T.LongType(), True),
        T.StructField("version", T.LongType(), False),
        T.StructField("rows", T.LongType(), False),
        T.StructField("schema_json", T.StringType(), True),
        T.StructField("layout", T.StringType(), True),
        T.StructField("txn", T.StringType(), True),
        T.StructField("committed_at", T.TimestampType(), False),
    ]
)

WATERMARKS = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("last_sync_timestamp", T.TimestampNTZType(), True),
        T.StructField("last_sync_id", T.LongType(), True),
        T.StructField("last_snapshot", T.LongType(), True),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("transfer_type", T.StringType(), False),
        T.StructField("start_time", T.TimestampType(), False),
        T.StructField("end_time", T.TimestampType(), False),
        T.StructField("rows_extracted", T.LongType(), True),
        T.StructField("rows_loaded", T.LongType(), True),
        T.StructField("source_count", T.LongType(), True),
        T.StructField("dest_count", T.LongType(), True),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("error", T.StringType(), True),
    ]
)

# One row per snapshot and column: counts and mergeable sketches.
PROFILE = T.StructType(
    [
        T.StructField("field_id", T.IntegerType(), False),
        T.StructField("rows", T.LongType(), False),
        T.StructField("non_null", T.LongType(), False),
        T.StructField("distinct_sketch", T.BinaryType(), True),
        T.StructField("least", T.DoubleType(), True),
        T.StructField("greatest", T.DoubleType(), True),
        T.StructField("quantile_sketch", T.BinaryType(), True),
    ]
)
