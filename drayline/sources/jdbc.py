"""Database tables over JDBC.

Tables are read through a JDBC catalog, so filters, counts, minima and, where the dialect has them, limits and
top-n run inside the database. Spark parallelises the rows.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.operators.merge import latest_per_key, merge_mode
from drayline.operators.projection import align

BATCH_ROWS = 10_000


@dataclass(frozen=True)
class Database:
    """Where a database is and how to log in. ``options`` are passed to the JDBC source as they are."""

    url: str
    driver: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def reader_options(self) -> dict[str, str]:
        named = {"url": self.url, "preferTimestampNTZ": "true", "fetchsize": str(BATCH_ROWS), **self.options}
        return {**named, "driver": self.driver} if self.driver else named

    def catalog(self, spark: SparkSession) -> str:
        """Name of the session's catalog of this database, registered on first use."""
        options = self.reader_options()
        name = "drayline_" + hashlib.sha256(repr(sorted(options.items())).encode()).hexdigest()[:16]
        prefix = f"spark.sql.catalog.{name}"
        if spark.conf.get(prefix, None) is None:
            for key, value in options.items():
                spark.conf.set(f"{prefix}.{key}", value)
            spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        return name


@dataclass(frozen=True)
class Split:
    """How to cut rows into parallel reads: at even steps of a numeric, date or timestamp column, or at given values.

    Even steps leave nearly all rows in one part where a key lies far from the rest. ``balanced`` asks the database for cuts that leave
    about as many rows in each part (see ``balanced_cuts``); ``cuts`` are the caller's own.
    """

    column: str
    parts: int = 0
    cuts: tuple = ()
    balanced: bool = False

    def predicates(self) -> list[str]:
        """Conditions in the database's SQL that are disjoint and complete, NULLs in the first."""
        c, values = quoted(self.column), [_literal(v) for v in self.cuts]
        if not values:
            return ["1 = 1"]
        between = [f"{c} >= {low} AND {c} < {high}" for low, high in zip(values, values[1:])]
        return [f"{c} < {values[0]} OR {c} IS NULL", *between, f"{c} >= {values[-1]}"]


def _literal(value) -> str:
    if isinstance(value, bool) or value is None:
        raise ValueError(f"rows cannot be cut at {value!r}")
    return str(value) if isinstance(value, (int, float, Decimal)) else "'" + str(value).replace("'", "''") + "'"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_table(spark: SparkSession, db: Database, table: str, split: Split | None = None) -> DataFrame:
    """The whole table (``TABLE`` or ``SCHEMA.TABLE``). With a split, the parts are read in parallel.

    The bounds are asked of the database. They only place the cuts; rows outside them, and NULLs, still arrive
    with the first or last part.
    """
    name = ".".join(f"`{part}`" for part in [db.catalog(spark), *table.split(".")])
    whole = spark.table(name)
    split = _with_cuts(spark, db, table, split)
    if split is not None and split.cuts:
        return read_slices(spark, db, table, split.predicates())
    if split is None or split.parts <= 1:
        return whole
    bounds = whole.agg(F.min(split.column).cast("string"), F.max(split.column).cast("string"))
    low, high = bounds.first()
    if low is None:
        return whole
    return (
        spark.read.option("partitionColumn", split.column)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", split.parts)
        .table(name)
    )


def read_query(spark: SparkSession, db: Database, sql: str, split: Split | None = None) -> DataFrame:
    """Rows of the caller's own SELECT, which runs in the database. With a split it runs once per part, each time for the
    rows of that part only; the split's column is one of the result."""
    reader = spark.read.format("jdbc").options(**db.reader_options())
    if split is None or not (split.cuts or split.parts > 1):
        return reader.option("query", sql).load()
    inner = f"({sql}) q"
    split = _with_cuts(spark, db, inner, split)
    if split.cuts:
        return read_slices(spark, db, inner, split.predicates())
    column = quoted(split.column)
    bounds = reader.option("query", f'SELECT MIN({column}) AS "low", MAX({column}) AS "high" FROM {inner}').load()
    low, high = bounds.select(F.col("low").cast("string"), F.col("high").cast("string")).first()
    if low is None:
        return reader.option("query", sql).load()
    cut = {"partitionColumn": split.column, "lowerBound": low, "upperBound": high, "numPartitions": split.parts}
    return spark.read.format("jdbc").options(**db.reader_options(), **cut).option("dbtable", inner).load()


def read_slices(spark: SparkSession, db: Database, table: str, predicates: list[str]) -> DataFrame:
    """One parallel read per predicate, for keys too uneven to cut by bounds. They must be disjoint and complete."""
    properties = {k: v for k, v in db.reader_options().items() if k != "url"}
    return spark.read.jdbc(db.url, table, predicates=predicates, properties=properties)


#: Ranges that a range is divided into at each look.
CUT_FANOUT = 256
CUT_LEVELS = 8


def _with_cuts(spark: SparkSession, db: Database, table: str, split: Split | None) -> Split | None:
    if split is None or not split.balanced or split.cuts or split.parts <= 1:
        return split
    cuts = balanced_cuts(spark, db, table, split.column, split.parts)
    return replace(split, cuts=cuts, parts=split.parts if cuts else 0, balanced=False)


def balanced_cuts(spark: SparkSession, db: Database, table: str, column: str, parts: int, tolerance: float = 0.05) -> tuple:
    """Values that cut a table (or a subquery with an alias) into parts of like size; found inside the database.

    A count per range of the column, ``CUT_FANOUT`` ranges at a time, shows where the cuts must lie; only the ranges that hold one
    are divided and counted again, until they hold little beside a part's size. One key far from the rest costs
    a few more looks, the last ones over few rows. A single value stays in one part, whatever it holds. For columns that are no
    numbers, Spark reads the column and takes quantiles of it.
    """
    c = quoted(column)
    reader = spark.read.format("jdbc").options(**db.reader_options())
    kind = reader.option("query", f"SELECT {c} FROM {table}").load().schema[0].dataType
    if not isinstance(kind, T.NumericType):
        return _quantile_cuts(reader.option("query", f"SELECT {c} FROM {table}").load(), column, parts)
    whole = isinstance(kind, T.IntegralType)
    number = f"CAST({c} AS BIGINT)" if whole else f"CAST({c} AS DOUBLE PRECISION)"
    sql = f'SELECT MIN({number}) AS "low", MAX({number}) AS "high", COUNT({c}) AS "n" FROM {table}'
    low, high, n = reader.option("query", sql).load().first()
    if not n or low == high:
        return ()
    span = high - low + 1 if whole else high - low
    width = 1 if whole else span / CUT_FANOUT
    while whole and width * CUT_FANOUT < span:
        width *= CUT_FANOUT
    targets = {n * i / parts: (low, high, 0) for i in range(1, parts)}  # rows that should be below: (from, to, rows below from)
    cuts: set = set()
    for level in range(CUT_LEVELS):
        within = " OR ".join(f"({c} >= {_literal(a)} AND {c} <= {_literal(b)})" for a, b, _ in sorted(set(targets.values())))
        bucket = f"({number} - {low}) / {width}" if whole else f"CAST(FLOOR(({number} - ({low!r})) / {width!r}) AS BIGINT)"
        counted = f'SELECT "bucket", COUNT(*) AS "n" FROM (SELECT {bucket} AS "bucket" FROM {table} WHERE {within}) b GROUP BY "bucket"'
        counts = sorted((int(r["bucket"]), int(r["n"])) for r in reader.option("query", counted).load().collect())
        last, narrower = level == CUT_LEVELS - 1 or whole and width == 1, {}
        for target, (a, b, below) in targets.items():
            for number_of, rows in counts:
                start = low + number_of * width
                if start + width <= a or start > b:
                    continue
                if below + rows >= target:
                    if last or rows <= tolerance * n / parts:
                        cuts.add(start if target - below < rows / 2 else start + width)
                    else:
                        narrower[target] = (start, start + width - (1 if whole else 0), below)
                    break
                below += rows
        targets = narrower
        if not targets:
            break
        width = width // CUT_FANOUT if whole else width / CUT_FANOUT
    return tuple(sorted(v for v in cuts if low < v <= high))


def _quantile_cuts(values: DataFrame, column: str, parts: int) -> tuple:
    """Cuts at quantiles that Spark takes of one column, of dates or times."""
    wanted = [i / parts for i in range(1, parts)]
    found = values.agg(F.percentile_approx(column, wanted, 10_000).alias("cuts")).select(F.col("cuts").cast("array<string>")).first()[0]
    return tuple(sorted(set(found or ())))


def count_rows(spark: SparkSession, db: Database, table: str, where: str | None = None) -> DataFrame:
    """The count, taken inside the database."""
    rows = read_table(spark, db, table)
    return (rows.where(where) if where else rows).agg(F.count(F.lit(1)).alias("row_count"))


def _writer(df: DataFrame, db: Database, table: str, text_length: int, parts: int | None):
    writer = df.write.format("jdbc").options(**db.reader_options()).option("dbtable", table).option("batchsize", BATCH_ROWS)
    texts = [f"{f.name} VARCHAR({text_length})" for f in df.schema if isinstance(f.dataType, T.StringType)]
    if texts:
        writer = writer.option("createTableColumnTypes", ", ".join(texts))
    return writer.option("numPartitions", parts) if parts else writer


def append_rows(df: DataFrame, db: Database, table: str, text_length: int = 4000, parts: int | None = None) -> None:
    """Bulk append, columns matched by name. ``parts`` bounds the connections opened at once.

    Each task commits once at its end, so a task that is retried after committing writes its rows twice.
    Where executors may be lost, load through ``append_new_rows`` or count afterwards.
    """
    _writer(df, db, table, text_length, parts).mode("append").save()


def append_new_rows(df: DataFrame, db: Database, table: str, key: list[str], parts: int | None = None) -> int:
    """Append only rows whose key the table lacks; a rerun after a partial load completes it. Returns the rows added.

    The rows go to a staging table and the database picks the new ones, so the target's keys are not read out.
    """
    return merge_rows(df, db, table, key, "append", parts).inserted


def truncate_load(df: DataFrame, db: Database, table: str, text_length: int = 4000, parts: int | None = None) -> None:
    """Empty the table, keep its definition, and load. ``df`` must not be read from that same table."""
    _writer(df, db, table, text_length, parts).mode("overwrite").option("truncate", "true").save()


def execute(spark: SparkSession, db: Database, *statements: str) -> list[int]:
    """Run statements in the database, in one transaction; returns the affected row count of each, or the number that a
    query gives."""
    jvm = spark._jvm
    if db.driver:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(db.driver)
    properties = jvm.java.util.Properties()
    for name, value in db.options.items():
        properties.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(db.url, properties)
    try:
        connection.setAutoCommit(False)
        counts = []
        for sql in statements:
            statement = connection.createStatement()
            if statement.execute(sql):
                result = statement.getResultSet()
                result.next()
                counts.append(result.getLong(1))
                result.close()
            else:
                counts.append(statement.getUpdateCount())
        connection.commit()
        return counts
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


@dataclass(frozen=True)
class Merged:
    inserted: int
    updated: int
    stale: int = 0  # changes that were older than the stored row


def _is_sql_server(db: Database) -> bool:
    return db.url.startswith("jdbc:sqlserver:")


def stage_sql(db: Database, stage: str, table: str) -> str:
    """An empty table with the columns and types of another."""
    if _is_sql_server(db):
        return f"SELECT TOP 0 * INTO {stage} FROM {table}"
    return f"CREATE TABLE {stage} AS SELECT * FROM {table} WITH NO DATA"


def not_newer_sql(latest_by: str) -> str:
    """Condition that the stored row is not above the staged one; a NULL is below all others."""
    c = quoted(latest_by)
    return f"(t.{c} IS NULL OR s.{c} >= t.{c})"


def merge_sql(db: Database, stage: str, table: str, columns: list[str], key: list[str], mode: str, latest_by: str | None = None) -> str:
    """The statement that applies a staged change set, in the database's dialect."""
    on = " AND ".join(f"t.{quoted(c)} = s.{quoted(c)}" for c in key)
    names, values = ", ".join(map(quoted, columns)), ", ".join(f"s.{quoted(c)}" for c in columns)
    if mode == "append":
        return f"INSERT INTO {table} ({names}) SELECT {values} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {on})"
    others = [c for c in columns if c not in key]
    updates = ", ".join(f"{quoted(c)} = s.{quoted(c)}" for c in others)
    guard = f" AND {not_newer_sql(latest_by)}" if latest_by else ""
    matched = f"WHEN MATCHED{guard} THEN UPDATE SET {updates} " if others else ""
    end = ";" if _is_sql_server(db) else ""
    return f"MERGE INTO {table} t USING {stage} s ON {on} {matched}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values}){end}"


def merge_rows(
    df: DataFrame, db: Database, table: str, key: list[str], mode: str = "upsert", parts: int | None = None, latest_by: str | None = None
) -> Merged:
    """Stage a change set beside the table and let the database merge it.

    Only the changes travel. They take the table's columns and types, so a column they lack becomes NULL on update.
    ``upsert`` needs one row per key; with ``latest_by`` a change below the stored row's value leaves that row as it is, one at
    an equal value replaces it. The staged count is checked first, so a retried staging task cannot slip its rows in
    twice; matches are counted in the transaction of the merge.
    """
    spark, mode = df.sparkSession, merge_mode(mode)
    target = read_table(spark, db, table)
    stage = f"{table}_STAGE_{uuid.uuid4().hex[:8].upper()}"
    on = " AND ".join(f"t.{quoted(c)} = s.{quoted(c)}" for c in key)
    seen = Observation()
    execute(spark, db, stage_sql(db, stage, table))
    try:
        append_rows(align(df, target.schema).observe(seen, F.count(F.lit(1)).alias("rows")), db, stage, parts=parts)
        expected = seen.get["rows"]
        if execute(spark, db, f"SELECT COUNT(*) FROM {stage}")[0] != expected:
            raise RuntimeError(f"staging {table} was written more than once; run the merge again")
        matches = f"SELECT COUNT(*) FROM {stage} s JOIN {table} t ON {on}"
        current = f"{matches} AND {not_newer_sql(latest_by)}" if latest_by and mode == "upsert" else matches
        matched, updated, changed = execute(spark, db, matches, current, merge_sql(db, stage, table, target.columns, key, mode, latest_by))
        return Merged(changed, 0) if mode == "append" else Merged(expected - matched, updated, matched - updated)
    finally:
        execute(spark, db, f"DROP TABLE {stage}")


@dataclass(frozen=True)
class DatabaseTable:
    """A database table as the target of a sync or an upserting stream. Repeating a merge changes nothing."""

    db: Database
    table: str
    key: list[str]
    parts: int | None = None

    def exists(self) -> bool:
        return True

    def merge(
        self, changes: DataFrame, mode: str = "upsert", latest_by: str | None = None, txn: str | None = None, in_order: bool = False
    ) -> Merged:
        """As ``KeyedTable.merge``; the database compares the staged rows with its own in any case."""
        latest = latest_per_key(changes, self.key, latest_by) if latest_by else changes
        return merge_rows(latest, self.db, self.table, self.key, mode, self.parts, latest_by)


# --- Discovery ---------------------------------------------------------------------------------

#: Schemas that databases keep for themselves.
SYSTEM_SCHEMAS = ("sys", "information_schema", "pg_catalog", "nullid", "sqlj", "syscat", "syscs_diag", "syscs_util", "sysfun", "sysibm", "sysproc", "sysstat")


def list_tables(spark: SparkSession, db: Database, schemas: list[str] | None = None) -> list[tuple[str, str]]:
    """(schema, table) of the user tables of a database, in order, from its own catalog."""
    catalog = db.catalog(spark)
    wanted = None if schemas is None else {s.lower() for s in schemas}
    names = [r[0] for r in spark.sql(f"SHOW NAMESPACES IN `{catalog}`").collect()]
    kept = [n.strip("`") for n in names]
    kept = [n for n in kept if (n.lower() in wanted if wanted is not None else n.lower() not in SYSTEM_SCHEMAS)]
    return sorted((n, r["tableName"]) for n in kept for r in spark.sql(f"SHOW TABLES IN `{catalog}`.`{n}`").collect())


def discover(spark: SparkSession, db: Database, schemas: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a database by ``SCHEMA.TABLE``; only their definitions are read."""
    return {f"{schema}.{table}": read_table(spark, db, f"{schema}.{table}") for schema, table in list_tables(spark, db, schemas)}
