"""Increments that record deletions, and restoring a table as it was at a time, from them and a change log.

An increment is the change set between what the backup holds and the table as it is now, found by keys and
row hashes: no version column is needed, and rows that are gone leave tombstones. Increments are copies of
their own below the last snapshot, numbered, each with its time and its manifest.

A restore to a point in time lays three sources over each other: the snapshot, the increments up to then,
and the entries of a change log up to then. Of every key, whatever came last holds.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.operators.changes import apply_changes, change_set
from strongbox.plans.backup import _write, complete, last_snapshot, next_increment
from strongbox.plans.manifest import read_manifest, refuse_damaged, schemas
from strongbox.plans.restore import SnapshotRows, read_copies
from strongbox.schemas import CL, SNAP, SST

#: The columns of a change increment beside those of the table, and their order among changes.
CHANGE = [T.StructField("change", T.StringType()), T.StructField("changed_at", T.TimestampType()), T.StructField("changed_seq", T.LongType())]
ORDER = ["changed_at", "changed_rank", "changed_seq"]


@dataclass(frozen=True)
class ChangeLog:
    """Where entries of a table's change log are, and how they read: the columns of the table, what was done
    (insert, update or delete; a deletion needs the key only), when, and a number that orders entries of one
    time."""

    schema: T.StructType
    keyspace: str = "changes"
    table: str = "log"
    change: str = "change"
    at: str = "ts"
    seq: str = "seq"


def change_backup(
    rows: DataFrame, backup: str, keyspace: str, table: str, keys: Sequence[str], at: datetime | None = None,
    snapshot: str | None = None, compression: str | None = None,
) -> DataFrame:
    """Records what has changed in a table since the backups of the last snapshot, deletions included;
    returns the files of the increment with their row counts, none if nothing has changed.

    ``rows`` is the whole table as it is now; keys may be null and may repeat. ``at`` is the time it is
    taken for, now by default; it must come after that of earlier increments. Only keys and hashes are
    shuffled to find the changes; whole rows are only where many have changed. An attempt that failed
    left no manifest: it is not part of the backup, and the next one replaces it.
    """
    spark = rows.sparkSession
    taken = snapshot or last_snapshot(backup, keyspace, table)
    if taken is None:
        raise ValueError("take a snapshot before an increment")
    clash = {f.name for f in CHANGE} & set(rows.columns)
    if clash:
        raise ValueError(f"columns named like those of an increment: {sorted(clash)}")
    parts = {"snapshot": taken, "backup_type": SST, "keyspace": keyspace, "table": table}
    at = at or datetime.now(UTC)
    last = _increments(spark, backup, rows.schema, **parts).agg(F.max(F.unix_micros("changed_at"))).first()[0]
    if last is not None and last >= _micros(at):
        raise ValueError(f"an increment of {keyspace}.{table} at or after {at.isoformat()} exists")
    held = restore_changes(spark, backup, rows.schema, snapshot=taken, keyspace=keyspace, table=table, keys=keys)
    copy = next_increment(backup, **parts)
    changes = change_set(held, rows, keys).withColumns(
        {"changed_at": F.timestamp_micros(F.lit(_micros(at))), "changed_seq": F.lit(int(copy.rsplit("-", 1)[-1])).cast("long")}
    )
    if changes.isEmpty():
        copy = "none"
    else:
        _write(changes, backup, compression, copy, **parts)
    return read_manifest(spark, backup, **parts).where(F.col("copy") == copy).select(*parts, "copy", "file", "n_rows", "length")


def _micros(at: datetime) -> int:
    """Microseconds since 1970; a time without a zone is in UTC."""
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def _taken_after(snapshot: str, until: datetime) -> bool:
    """Whether a snapshot's name says that it was taken after a time."""
    try:
        return _micros(datetime.strptime(snapshot, "%Y-%m-%d-%H:%M:%S")) > _micros(until)
    except ValueError:
        return False


def _increments(spark: SparkSession, backup: str, schema: T.StructType, **parts: str) -> DataFrame:
    return read_copies(spark, backup, T.StructType([*schema.fields, *CHANGE]), **parts)


def increment_at(spark: SparkSession, backup: str, at: datetime, **parts: str) -> str | None:
    """The name of a table's finished increment that was taken for a time."""
    rows = _increments(spark, backup, T.StructType([]), **parts).where(F.col("changed_at") == F.timestamp_micros(F.lit(_micros(at))))
    found = rows.agg(F.max("changed_seq")).first()[0]
    return None if found is None else f"increment-{found:09d}"


def restore_changes(
    spark: SparkSession, backup: str, schema: T.StructType, *, snapshot: str, keyspace: str, table: str,
    keys: Sequence[str], until: datetime | None = None, log: ChangeLog | None = None, dest: str | None = None,
) -> DataFrame:
    """The rows of a table after its increments, as of ``until`` if given, written to ``dest`` if given.

    With ``log``, entries of the change log below the same snapshot are replayed on top, up to
    ``until``. Of increments and entries the last of each key by time holds; at the same time an entry
    comes after an increment. Keys that neither names keep their rows of the snapshot, which are not
    shuffled while the changes are few. All rows that a key had in its last increment come back; the
    log holds one row for a key.

    Files are checked against the manifests as ``restore_backup`` does: names and lengths before, and with
    ``dest`` the content of snapshot and increments in the pass that restores them.
    """
    for name, value in {"snapshot": snapshot, "keyspace": keyspace, "table": table}.items():
        if not (value or "").strip():
            raise ValueError(f"a restore needs a {name}")
    if not keys:
        raise ValueError("a restore of changes needs keys")
    parts = {"snapshot": snapshot, "keyspace": keyspace, "table": table}
    if not complete(backup, backup_type=SNAP, **parts):
        raise FileNotFoundError(f"no complete snapshot {snapshot} of {keyspace}.{table} in {backup}")
    if until is not None and _taken_after(snapshot, until):
        raise ValueError(f"snapshot {snapshot} was taken after {until.isoformat()}")
    if any("changed_seq" not in s.names for s in schemas(spark, backup, backup_type=SST, **parts)):
        raise ValueError(f"{keyspace}.{table} has increments by version: restore_backup restores those")
    base = SnapshotRows(spark, backup, schema, dest, **parts)
    increments = _increments(spark, backup, schema, backup_type=SST, **parts)
    changes = increments.withColumn("changed_rank", F.lit(0))
    rows = [changes]
    if log is not None:
        entries = _entries(spark, backup, schema, log, snapshot)
        changes = changes.unionByName(entries)
        # An entry that was logged twice is one entry.
        rows.append(entries.dropDuplicates([*keys, *ORDER]))
    if until is not None:
        before = F.col("changed_at") <= F.timestamp_micros(F.lit(_micros(until)))
        changes, rows = changes.where(before), [r.where(before) for r in rows]
    return base.restored(apply_changes(base.watched, changes, keys, ORDER, rows))


def _entries(spark: SparkSession, backup: str, schema: T.StructType, log: ChangeLog, snapshot: str) -> DataFrame:
    """The entries of a change log as changes. Its files are checked by name and length."""
    parts = {"snapshot": snapshot, "backup_type": CL, "keyspace": log.keyspace, "table": log.table}
    refuse_damaged(spark, backup, **parts)
    rows = read_copies(spark, backup, log.schema, **parts)
    return rows.select(
        *schema.names,
        F.lower(log.change).alias("change"),
        F.col(log.at).cast("timestamp").alias("changed_at"),
        F.col(log.seq).cast("long").alias("changed_seq"),
        F.lit(1).alias("changed_rank"),
    )
