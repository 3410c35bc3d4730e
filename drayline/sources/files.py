"""Parquet, JSON row and CSV datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.scalars import date_parts, iso_text
from drayline.functions.types import Field, canonical
from drayline.functions.windows import Day, as_day
from drayline.session import local_rows, matching_paths, path_exists, workspace
from drayline.sources.json_arrays import array_elements

# Codecs a Parquet sink accepts.
CODECS = ("snappy", "gzip", "none")

MAX_RECORDS_PER_FILE = 1_000_000

DAY_COLUMNS = ("year", "month", "day")


# --- Parquet -----------------------------------------------------------------------------------


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A missing path is an error. With a schema no file is opened while planning."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_typed_parquet(spark: SparkSession, path: str, fields: list[Field]) -> DataFrame:
    """Declared columns in declared order; a column the files lack is NULL, a uuid becomes text."""
    files = read_parquet(spark, path)
    stored = {f.name: f.dataType for f in files.schema}
    return files.select(
        [
            canonical(F.col(f.name), f, stored[f.name]) if f.name in stored else F.lit(None).cast(f.spark_type).alias(f.name)
            for f in fields
        ]
    )


def read_day_range(spark: SparkSession, path: str, start: Day, end: Day, schema: T.StructType) -> DataFrame:
    """Rows of the day folders ``start``..``end``, both included. Only partition columns are compared.

    The folder's ``year``, ``month`` and ``day`` are columns of the result, as text. Where the data has a column of such a
    name, the data's own columns are all there is, and the folders are picked from the folder listing.
    """
    first, last = as_day(start), as_day(end)
    if {f.name.lower() for f in schema.fields} & set(DAY_COLUMNS) and _data_has_day_columns(spark, path):
        folders = [f for f, day in _day_folders(spark, path) if first.strftime("%Y%m%d") <= day <= last.strftime("%Y%m%d")]
        return spark.read.schema(schema).parquet(*folders) if folders else local_rows(spark, [], schema)
    text_days = T.StructType(
        [f for f in schema.fields if f.name not in DAY_COLUMNS] + [T.StructField(d, T.StringType()) for d in DAY_COLUMNS]
    )
    folder_day = F.concat(*DAY_COLUMNS)
    # The bounds on year alone are redundant, but they are a plain comparison that also prunes listing in a catalog.
    return (
        spark.read.schema(text_days)
        .parquet(path)
        .where(F.col("year").between(f"{first.year:04d}", f"{last.year:04d}"))
        .where(folder_day.between(first.strftime("%Y%m%d"), last.strftime("%Y%m%d")))
    )


def _day_folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, yyyyMMdd) of every day folder, in order."""
    found = []
    for folder in matching_paths(spark, f"{path}/year=*/month=*/day=*"):
        found.append((folder, "".join(part.rpartition("=")[2] for part in folder.rstrip("/").split("/")[-3:])))
    return sorted(found, key=lambda x: x[1])


def _data_has_day_columns(spark: SparkSession, path: str) -> bool:
    """Whether the files of the newest day folder hold a column named like a part of the folder."""
    folders = _day_folders(spark, path)
    return bool(folders) and bool({c.lower() for c in spark.read.parquet(folders[-1][0]).columns} & set(DAY_COLUMNS))


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    compression: str = "snappy",
    max_records_per_file: int = MAX_RECORDS_PER_FILE,
) -> None:
    if compression not in CODECS:
        raise ValueError(f"compression {compression!r} is not one of {CODECS}")
    if max_records_per_file <= 0:
        raise ValueError("max_records_per_file must be positive")
    df.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", max_records_per_file).parquet(path)


def write_run_date(df: DataFrame, path: str, run_date: Day, compression: str = "snappy") -> str:
    """The whole batch under its run date. A rerun of the same date replaces that day only; returns its folder."""
    folder = f"{path}/" + as_day(run_date).strftime("year=%Y/month=%m/day=%d")
    write_parquet(df, folder, compression=compression)
    return folder


def write_data_date(df: DataFrame, path: str, date_column: str | None, date: Column | None = None) -> None:
    """Each row under its own date (or one ``static`` folder), replacing only the days present in ``df``.

    Rows are gathered by day first, so a day becomes a few full files rather than one per task; the rebalance
    hint lets adaptive execution split a day that holds far more rows than the others.
    """
    if date_column is None and date is None:
        write_parquet(df, f"{path}/static")
        return
    taken = sorted({c.lower() for c in df.columns} & set(DAY_COLUMNS))
    if taken:
        raise ValueError(f"columns {taken} have the names of the day folders; rename them first")
    dated = df.select("*", *date_parts(F.col(date_column) if date is None else date))
    (
        dated.hint("rebalance", *DAY_COLUMNS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(*DAY_COLUMNS)
        .parquet(path)
    )


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes, modification time and rows of each data file. No column is decoded."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return files.groupBy("file_path", "file_size", "file_modification_time").agg(F.count(F.lit(1)).alias("record_count"))


def newest_first(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("file_modification_time"), "file_path")


# --- JSON rows ---------------------------------------------------------------------------------


def explode_json_rows(df: DataFrame, text: str, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a text column that holds a JSON array of flat objects.

    ``[]`` and a NULL text give no row, a null field gives NULL; a text that is not an array, or a value that does not fit, fails the job.
    Read a field as string to keep a nested value as its raw text.
    """
    t = F.col(text)
    array = (
        F.when(t.isNull(), None)
        .when(F.startswith(F.ltrim(t), F.lit("[")), F.from_json(t, T.ArrayType(schema), {"mode": "FAILFAST"}))
        .otherwise(F.raise_error(F.concat(F.lit("not a JSON array: "), F.substring(t, 1, 80))))
    )
    return df.select(*keep, F.explode(array).alias("_row")).select(*keep, "_row.*")


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Files that each hold one JSON array of flat objects; anything else fails the job. Large files are read in byte ranges.

    Without a schema the types are inferred from all rows, never from the first; a nested value is then its raw text.
    """
    elements = array_elements(spark, path)
    if schema is None:
        lines = workspace(spark, "json-elements")
        elements.select(F.regexp_replace("value", r"[\r\n]", " ")).write.text(lines)
        inferred = spark.read.option("samplingRatio", "1.0").option("mode", "FAILFAST").json(lines).schema
        nested = (T.StructType, T.ArrayType, T.MapType)
        schema = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, nested) else f.dataType) for f in inferred.fields])
        elements = spark.read.text(lines)
    return elements.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_row")).select("_row.*")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; files split, so this is the form to use for large data."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def to_json_rows(df: DataFrame, name: str = "row_json") -> DataFrame:
    """One JSON object per row. NULL fields stay, timestamps become ISO-8601 text with microseconds."""
    times = (T.TimestampType, T.TimestampNTZType)
    columns = [iso_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, times) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))


def write_json_lines(df: DataFrame, path: str) -> None:
    to_json_rows(df, "value").write.mode("overwrite").text(path)


# --- CSV ---------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, order_by: list[str]) -> None:
    """Range-partitioned export: files in name order are the rows in key order, each with a header."""
    df.orderBy(*order_by).write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)
