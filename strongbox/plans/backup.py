"""Snapshots and increments of a table."""

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.filesystem import folders
from strongbox.operators.joins import join_on
from strongbox.plans.manifest import copies, finished, write_copy
from strongbox.schemas import BACKUP_PARTITIONS, SNAP, SST, UNKNOWN_NUMBER
from strongbox.sources.files import read_backup
from strongbox.workspace import new_folder

ROWS_PER_FILE = 5_000_000
TABLES_AT_A_TIME = 4


def complete(backup: str, **parts: str) -> bool:
    """Whether the copy of a table was written to its end: it has its manifest then."""
    return finished(backup, **parts)


def _write(rows: DataFrame, backup: str, compression: str | None, copy: str = "whole", **parts: str) -> None:
    """Writes a copy into the folder of one partition: backups of other tables may run at the same time."""
    clash = set(BACKUP_PARTITIONS) & set(rows.columns)
    if clash:
        raise ValueError(f"columns named like backup partitions: {sorted(clash)}")
    options = {"maxRecordsPerFile": ROWS_PER_FILE} | ({"compression": compression} if compression else {})
    write_copy(rows, backup, copy, options, **parts)


def next_increment(backup: str, **parts: str) -> str:
    """The name of the increment after the last finished one; what a failed one left behind is replaced."""
    last = max((int(c.rsplit("-", 1)[-1]) for c in copies(backup, **parts)), default=0)
    return f"increment-{last + 1:09d}"


def snapshot_backup(
    rows: DataFrame, backup: str, snapshot: str, keyspace: str, table: str, compression: str | None = None
) -> DataFrame:
    """Copies a whole table under a new snapshot name and returns the manifest of the copy.

    Tasks copy their own input: there is no shuffle of rows. The copy is read back against the digest of
    what was written. A name that exists already is an error, but what a failed copy left behind is
    replaced.
    """
    spark, parts = rows.sparkSession, {"snapshot": snapshot, "backup_type": SNAP, "keyspace": keyspace, "table": table}
    if complete(backup, **parts):
        raise FileExistsError(f"snapshot {snapshot} of {keyspace}.{table} exists")
    _write(rows, backup, compression, **parts)
    return backup_manifest(spark, backup, **parts)


def snapshot_keyspace(tables: Mapping[str, DataFrame], backup: str, snapshot: str, keyspace: str) -> DataFrame:
    """Copies all tables of a keyspace under one snapshot name; returns one manifest.

    Some tables are copied at a time, so that small ones do not leave the cluster idle.
    """
    with ThreadPoolExecutor(TABLES_AT_A_TIME) as pool:
        copies = [pool.submit(snapshot_backup, rows, backup, snapshot, keyspace, table) for table, rows in tables.items()]
    for copy in copies:
        copy.result()
    spark = next(iter(tables.values())).sparkSession
    return backup_manifest(spark, backup, snapshot=snapshot, backup_type=SNAP, keyspace=keyspace, table=list(tables))


def incremental_backup(
    rows: DataFrame,
    backup: str,
    keyspace: str,
    table: str,
    keys: Sequence[str],
    version: str,
    snapshot: str | None = None,
    compression: str | None = None,
) -> DataFrame:
    """Copies the row versions that no backup of the last snapshot holds; returns the manifest.

    Only keys and versions of the backup are read, and only keys and versions are shuffled to find
    what is new. What is new is written down first: its size is then known, and the planner
    broadcasts it if it is small, so whole rows are shuffled only for a large increment. Rows that are
    gone from the table stay in the backup: ``change_backup`` records those. Without a snapshot to attach
    to it is an error.
    """
    spark = rows.sparkSession
    last = snapshot or last_snapshot(backup, keyspace, table)
    if last is None:
        raise ValueError("take a snapshot before an increment")
    names, parts = [*keys, version], {"snapshot": last, "keyspace": keyspace, "table": table}
    known = read_backup(spark, backup, rows.schema, backup_type=[SNAP, SST], **parts).select(*names)
    new = join_on(rows.select(*names), known, names, "left_anti")
    written = new_folder(spark, "new-keys")
    new.distinct().write.parquet(written)
    found = spark.read.schema(new.schema).parquet(written)
    new_rows, parts = join_on(rows, found, names, "left_semi"), parts | {"backup_type": SST}
    _write(new_rows, backup, compression, next_increment(backup, **parts), **parts)
    return backup_manifest(spark, backup, **parts)


def last_snapshot(backup: str, keyspace: str, table: str) -> str | None:
    """The name of the newest complete snapshot of a table, from the names of the folders alone."""
    found = [path.rsplit("/", 1)[-1] for path in folders(backup)]
    names = sorted((unquote(f.removeprefix("snapshot=")) for f in found if f.startswith("snapshot=")), reverse=True)
    return next((n for n in names if complete(backup, snapshot=n, backup_type=SNAP, keyspace=keyspace, table=table)), None)


def backup_manifest(spark: SparkSession, backup: str, **parts: str | Sequence[str]) -> DataFrame:
    """Files of a backup with their row counts; no column is read, so tables may differ."""
    rows = read_backup(spark, backup, T.StructType([]), **parts)
    return rows.groupBy(*BACKUP_PARTITIONS, F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("_metadata.file_size").alias("length")
    )


STATE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("snapshot", "backup_type", "keyspace", "status")]
    + [T.StructField("files_count", T.LongType()), T.StructField("written", T.TimestampType())]
)


def recorded_backup(
    spark: SparkSession, log: str, snapshot: str, backup_type: str, keyspace: str, copy: Callable[[], DataFrame]
) -> DataFrame:
    """Runs a backup between its two states and keeps what it copied.

    ``copy`` makes the backup and returns its manifest. ``log/states`` gets *inprogress* before and
    *complete* after it, ``log/metadata`` the manifest. A backup that fails stays in progress.
    """

    def write_state(status: str, files_count: int) -> None:
        row = (snapshot, backup_type, keyspace, status, files_count)
        state = spark.createDataFrame([row], T.StructType(STATE.fields[:-1])).withColumn("written", F.current_timestamp())
        state.write.mode("append").parquet(f"{log}/states")

    write_state("inprogress", UNKNOWN_NUMBER)
    manifest = copy()
    manifest.write.mode("append").parquet(f"{log}/metadata")
    write_state("complete", manifest.count())
    return manifest


def backup_states(spark: SparkSession, log: str) -> DataFrame:
    """The states written so far."""
    return spark.read.schema(STATE).parquet(f"{log}/states")
