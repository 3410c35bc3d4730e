"""Append-only tables with snapshots and time travel, on Parquet.

``data/drayline_snapshot=<n>/`` holds what snapshot ``n`` added and the commit log holds one row per snapshot.
Data is written first and the commit row last. Ids are dense: snapshot ``n+1`` is only written after ``n`` is
committed, and a failed attempt at ``n+1`` is overwritten by the next one. So "committed" is the plain
partition predicate ``drayline_snapshot <= current``; reads need no join and prune folders while planning.
One writer at a time is assumed.

Columns have ids that stay (see ``functions.evolution``). ``evolve`` renames, widens or adds columns as a snapshot without rows; files are not
rewritten. Each snapshot's files are read in the schema they were written in and brought into the current one by id,
with one scan per schema that the wanted snapshots have.

A table opened with ``profiled`` keeps counts and sketches of every column with each snapshot, taken in the stage that writes it;
``profile`` merges them for any as-of, by column id, without reading data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.evolution import as_current, changes_for, evolved, with_field_ids
from drayline.operators.projection import align
from drayline.operators.reconcile import union_all
from drayline.operators.sketches import column_sketches, merged_profile, sketch_rows
from drayline.schemas import COMMITS, PROFILE
from drayline.session import files_and_bytes, list_names, local_rows
from drayline.sources.files import MAX_RECORDS_PER_FILE, file_stats, write_parquet
from drayline.sources.ledger import CommitLog


#: The partition column of the data; a table's own columns may have any other name.
SNAPSHOT = "drayline_snapshot"
SKETCH = "drayline_sketch_"


@dataclass(frozen=True)
class Appended:
    snapshot_id: int | None
    rows: int
    metrics: dict[str, str | None]


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, profiled: bool = False):
        self.spark, self.path, self.profiled = spark, path, profiled
        self.data = f"{path}/data"
        self.log = CommitLog(spark, f"{path}/commits", COMMITS, "snapshot_id")

    # --- state ---------------------------------------------------------------------------------

    def exists(self) -> bool:
        return not self.log.is_empty()

    def find_head(self) -> Row | None:
        """The commit in force, or None when there is no table."""
        return self.log.head()

    def head(self) -> Row:
        head = self.find_head()
        if head is None:
            raise ValueError(f"no snapshot table at {self.path}")
        return head

    def commits(self) -> DataFrame:
        self.head()
        return self.log.read()

    def schema(self) -> T.StructType:
        return _schema(self.head())

    # --- writes --------------------------------------------------------------------------------

    def create(self, df: DataFrame, txn: str | None = None, metrics: dict | None = None, **how) -> Appended:
        """First snapshot. A table that exists, a frame without columns or one without rows is an error."""
        if self.exists():
            raise ValueError(f"a snapshot table already exists at {self.path}")
        if not df.columns:
            raise ValueError("a snapshot table needs at least one column")
        appended = self._write(df, None, txn, metrics or {}, **how)
        if appended.snapshot_id is None:
            raise ValueError("a snapshot table needs at least one row")
        return appended

    def append(self, df: DataFrame, txn: str | None = None, metrics: dict | None = None, **how) -> Appended:
        """A new snapshot in the table's schema. No rows means success and no snapshot.

        ``txn`` names the batch: appending the one already at the head changes nothing, so retries are safe.
        ``metrics`` are further aggregates to take of the rows while they are written, returned as text.
        """
        return self.append_after(self.head(), df, txn, metrics, **how)

    def append_or_create(self, df: DataFrame, txn: str | None = None, metrics: dict | None = None, **how) -> Appended:
        """For repeated runs: the first batch with rows creates the table."""
        return self.append_after(self.find_head(), df, txn, metrics, **how)

    def append_after(self, head: Row | None, df: DataFrame, txn: str | None = None, metrics: dict | None = None, **how) -> Appended:
        """As ``append_or_create``, for a caller that has just looked up the head."""
        if head is None:
            return self._write(df, None, txn, metrics or {}, **how)
        if txn is not None and head.txn == txn:
            return Appended(head.snapshot_id, head.rows_added, {})
        return self._write(align(df, _schema(head)), head, txn, metrics or {}, **how)

    def _write(
        self,
        df: DataFrame,
        head: Row | None,
        txn: str | None,
        metrics: dict,
        max_records_per_file: int = MAX_RECORDS_PER_FILE,
    ) -> Appended:
        if SNAPSHOT in (c.lower() for c in df.columns):
            raise ValueError(f"the column name {SNAPSHOT!r} is reserved")
        snapshot_id = head.snapshot_id + 1 if head else 1
        folder = f"{self.data}/{SNAPSHOT}={snapshot_id}"
        schema, last = (_schema(head), head.last_field_id) if head else with_field_ids(df.schema)
        sketches = column_sketches(schema) if self.profiled else {}
        # The metrics are taken in the writing stage itself, whose retried tasks are counted once.
        seen = Observation()
        observed = df.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            *[m.cast("string").alias(n) for n, m in metrics.items()],
            *[m.alias(f"{SKETCH}{n}") for n, m in sketches.items()],
        )
        write_parquet(observed, folder, max_records_per_file=max_records_per_file)
        taken = dict(seen.get)
        rows = taken.pop("rows")
        sketched = {n: taken.pop(f"{SKETCH}{n}") for n in sketches}
        if rows == 0:
            return Appended(None, 0, taken)
        files, size = files_and_bytes(self.spark, folder)
        if self.profiled:
            # Before the commit, under the number it will have; the profile of an attempt that fails is overwritten by the next.
            profile = local_rows(self.spark, sketch_rows(schema, rows, sketched), PROFILE)
            profile.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/profiles/{SNAPSHOT}={snapshot_id}")
        self._commit(head, txn, schema, head.schema_since if head else 1, last, rows, files, size)
        return Appended(snapshot_id, rows, taken)

    def _commit(self, head: Row | None, txn: str | None, schema: T.StructType, since: int, last: int, rows: int = 0, files: int = 0, size: int = 0) -> int:
        commit = Row(
            snapshot_id=head.snapshot_id + 1 if head else 1,
            parent_id=head.snapshot_id if head else None,
            rows_added=rows,
            files_added=files,
            bytes_added=size,
            total_rows=rows + (head.total_rows if head else 0),
            total_files=files + (head.total_files if head else 0),
            schema_json=schema.json(),
            schema_since=since,
            last_field_id=last,
            txn=txn,
        )
        fields = T.StructType([f for f in COMMITS.fields if f.name != "committed_at"])
        row = local_rows(self.spark, [tuple(commit[n] for n in fields.names)], fields)
        self.log.append(row.withColumn("committed_at", F.current_timestamp()), commit.snapshot_id)
        return commit.snapshot_id

    def evolve(
        self, add: list[T.StructField] = (), rename: dict[str, str] | None = None, widen: dict[str, T.DataType] | None = None
    ) -> int:
        """Rename, then widen (by the new names), then add columns; returns the id of the snapshot that has the new schema.

        Rows written before are NULL in an added column. A type may only be widened to one that holds all its values.
        """
        head = self.head()
        schema, last = evolved(_schema(head), head.last_field_id, add, rename, widen)
        if SNAPSHOT in (c.lower() for c in schema.names):
            raise ValueError(f"the column name {SNAPSHOT!r} is reserved")
        return self._commit(head, None, schema, head.snapshot_id + 1, last)

    def append_evolving(self, df: DataFrame, txn: str | None = None, metrics: dict | None = None, **how) -> Appended:
        """As ``append``, but columns that the table lacks are added, and types widened, first."""
        head = self.head()
        if txn is not None and head.txn == txn:
            return Appended(head.snapshot_id, head.rows_added, {})
        add, widen = changes_for(_schema(head), df.schema)
        if add or widen:
            self.evolve(add, widen=widen)
        return self.append(df, txn, metrics, **how)

    # --- reads ---------------------------------------------------------------------------------

    def read(self) -> DataFrame:
        """All rows of all snapshots, later versions of a key as further rows."""
        head = self.head()
        return self._rows(head, 1, head.snapshot_id)

    def read_as_of(self, snapshot_id: int) -> DataFrame:
        """Rows as they were at a snapshot, in the current schema."""
        head = self.head()
        self._check_known(snapshot_id, head)
        return self._rows(head, 1, snapshot_id)

    def read_added(self, snapshot_id: int) -> DataFrame:
        """Only the rows one snapshot added."""
        head = self.head()
        self._check_known(snapshot_id, head)
        return self._rows(head, snapshot_id, snapshot_id)

    def read_between(self, first: int, last: int) -> DataFrame:
        """The rows that several snapshots added, both ends included."""
        head = self.head()
        for snapshot_id in (first, last):
            self._check_known(snapshot_id, head)
        return self._rows(head, first, last)

    def _check_known(self, snapshot_id: int, head: Row) -> None:
        if not 1 <= snapshot_id <= head.snapshot_id:
            raise ValueError(f"no snapshot {snapshot_id} in {self.path}")

    def schemas(self, head: Row) -> list[tuple[int, int, T.StructType]]:
        """(first snapshot, last snapshot, schema) of every schema the table has had. Only the commits that began one are looked at, and
        none where the schema never changed."""
        if head.schema_since == 1:
            return [(1, head.snapshot_id, _schema(head))]
        began = self.log.read().where("schema_since = snapshot_id").orderBy("snapshot_id").collect()
        ends = [c.snapshot_id - 1 for c in began[1:]] + [head.snapshot_id]
        return [(c.snapshot_id, end, _schema(c)) for c, end in zip(began, ends)]

    def _rows(self, head: Row, first: int, last: int) -> DataFrame:
        current, scans = _schema(head), []
        for since, until, schema in self.schemas(head):
            a, b = max(first, since), min(last, until)
            if a <= b:
                stored = T.StructType([*schema.fields, T.StructField(SNAPSHOT, T.LongType())])
                snapshot = F.col(SNAPSHOT)
                rows = self.spark.read.schema(stored).parquet(self.data).where((snapshot >= a) & (snapshot <= b))
                scans.append(rows.select(*as_current(schema, current)))
        return union_all(scans)

    def history(self) -> DataFrame:
        """Per snapshot: what it added and the running totals, which each commit carries forward."""
        return self.commits().select(
            "snapshot_id", "parent_id", "committed_at", "rows_added", "files_added", "bytes_added", "total_rows", "total_files"
        )

    def profile(self, snapshot_id: int | None = None) -> DataFrame:
        """One row per current column: rows, non-NULL and NULL counts, distinct values (estimated), least, greatest and quartiles of numbers,
        of the table as of a snapshot. Only the stored profiles are read; a snapshot with rows that has none is an error."""
        head = self.head()
        until = head.snapshot_id if snapshot_id is None else snapshot_id
        self._check_known(until, head)
        stored = T.StructType([*PROFILE.fields, T.StructField(SNAPSHOT, T.LongType())])
        if not list_names(self.spark, f"{self.path}/profiles"):
            raise ValueError(f"no snapshot of {self.path} has a profile; open the table with profiled=True to write them")
        parts = self.spark.read.schema(stored).parquet(f"{self.path}/profiles").where(F.col(SNAPSHOT) <= until)
        have = parts.select(SNAPSHOT).distinct()
        without = self.log.read().where((F.col("snapshot_id") <= until) & (F.col("rows_added") > 0)).join(have, F.col("snapshot_id") == F.col(SNAPSHOT), "left_anti")
        missing = without.select("snapshot_id").first()
        if missing is not None:
            raise ValueError(f"snapshot {missing[0]} of {self.path} was written without a profile")
        return merged_profile(parts.withColumnRenamed(SNAPSHOT, "part"), _schema(head))

    def files(self) -> DataFrame:
        """Path, bytes, rows and snapshot of each committed data file."""
        head = self.head()
        stats = file_stats(self.spark, self.data)
        snapshot = F.regexp_extract("file_path", rf"/{SNAPSHOT}=(\d+)/[^/]*$", 1).cast("long")
        return stats.withColumn("snapshot_id", snapshot).where(F.col("snapshot_id") <= head.snapshot_id)

    def validate(self) -> DataFrame:
        """Checks as rows: the table loads, its ids are dense, and each snapshot holds the rows it committed."""
        committed = self.commits().select("snapshot_id", F.col("rows_added").alias("committed_rows"))
        scanned = self.files().groupBy("snapshot_id").agg(F.sum("record_count").alias("scanned_rows"))
        both = committed.join(scanned, "snapshot_id", "full_outer").agg(
            F.count("committed_rows").alias("snapshots"),
            F.max("snapshot_id").alias("newest"),
            F.coalesce(F.sum("committed_rows"), F.lit(0)).alias("committed"),
            F.coalesce(F.sum("scanned_rows"), F.lit(0)).alias("scanned"),
            F.sum(F.expr("CASE WHEN committed_rows <=> coalesce(scanned_rows, 0) THEN 0 ELSE 1 END")).alias("differing"),
        )
        checks = F.array(
            _check("table_has_columns", F.lit(len(self.schema().fields)).cast("long"), F.lit(len(self.schema().fields) > 0)),
            _check("current_snapshot_exists", F.col("newest"), F.col("newest") > 0),
            _check("snapshot_ids_dense", F.col("snapshots"), F.col("snapshots") == F.col("newest")),
            _check("scanned_equals_committed", F.col("scanned"), F.col("scanned") == F.col("committed")),
            _check("snapshots_differing", F.col("differing"), F.col("differing") == 0),
        )
        return both.select(F.explode(checks).alias("c")).select("c.check_name", "c.value", "c.passed")


def _check(name: str, value, passed):
    return F.struct(F.lit(name).alias("check_name"), value.cast("long").alias("value"), passed.alias("passed"))


def _schema(commit: Row) -> T.StructType:
    return T.StructType.fromJson(json.loads(commit.schema_json))
