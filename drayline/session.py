"""Session construction and the shared folder that jobs write their tables under."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def build_session(app_name: str = "drayline", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library is tuned for.

    Shuffle width is left to the cluster: adaptive execution coalesces from whatever
    ``spark.sql.shuffle.partitions`` says. Only a local master gets a small default.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    distribute_package(session)
    return session


def distribute_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context.

    Nothing that is Python runs on executors but the operators over texts; their functions are modules of this package,
    which workers could otherwise import only where it is installed or on their path.
    """
    context = spark.sparkContext
    if getattr(context, "_drayline_sent", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="drayline-code-"), "drayline_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._drayline_sent = True


def is_local(spark: SparkSession) -> bool:
    """Whether executors are threads of this process; those of ``local-cluster`` are processes of their own."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="drayline-")
    return _local_root


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created until a job writes to it."""
    return f"{shared_root(spark)}/drayline/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    system, hadoop_path = _hadoop(spark, path)
    return system.exists(hadoop_path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a small folder; none when it does not exist."""
    system, hadoop_path = _hadoop(spark, path)
    return [s.getPath().getName() for s in system.listStatus(hadoop_path)] if system.exists(hadoop_path) else []


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with wildcards, from one listing."""
    system, hadoop_path = _hadoop(spark, pattern)
    return [s.getPath().toString() for s in system.globStatus(hadoop_path) or []]


def files_and_bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and total bytes of the Parquet files in a folder, from its listing; nothing is opened."""
    system, hadoop_path = _hadoop(spark, path)
    files = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*.parquet"))
    return len(files), system.getContentSummary(hadoop_path).getLength()


def delete_path(spark: SparkSession, path: str) -> None:
    system, hadoop_path = _hadoop(spark, path)
    system.delete(hadoop_path, True)


def table_path(folder: str, table: str) -> str:
    return os.path.join(folder, f"{table}.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows of metadata as a frame. They go over as Arrow, so no Python worker is started to read them."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
