"""Restoring a table from a snapshot and its increments."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.filesystem import delete_folder, folders
from strongbox.operators.joins import join_on
from strongbox.operators.state import last_version
from strongbox.plans.backup import complete
from strongbox.plans.manifest import DamagedBackup, agree, copies, observed, refuse_damaged, refuse_others, schemas
from strongbox.schemas import SNAP, SST
from strongbox.sources.files import read_backup, table_folder


def restore_backup(
    spark: SparkSession,
    backup: str,
    schema: T.StructType,
    *,
    snapshot: str,
    keyspace: str,
    table: str,
    keys: Sequence[str] = (),
    version: str | None = None,
    one_row_per_key: bool = False,
    dest: str | None = None,
) -> DataFrame:
    """The rows of a table as of its last increment, written to ``dest`` if given.

    Snapshot and increments are read from their partitions only. With ``keys`` and ``version``
    the last version of every key is kept, without them all rows. ``one_row_per_key`` states that
    the snapshot holds no key twice, as for a table with a primary key: then snapshot rows that no
    increment touches pass through without being grouped. ``dest`` must not exist. A snapshot that is
    absent, or was not written to its end, is an error; so are files that are missing, of another
    length, or unknown to the manifests. With ``dest`` the content is compared with the manifests too, in
    the pass that restores it; a restore that read something else is deleted and names the files.
    Without ``dest`` the rows are lazy: see ``verify_backup`` for their content. Increments that record
    deletions are restored by ``restore_changes``.
    """
    for name, value in {"snapshot": snapshot, "keyspace": keyspace, "table": table}.items():
        if not (value or "").strip():
            raise ValueError(f"a restore needs a {name}")
    parts = {"snapshot": snapshot, "keyspace": keyspace, "table": table}
    if not complete(backup, backup_type=SNAP, **parts):
        raise FileNotFoundError(f"no complete snapshot {snapshot} of {keyspace}.{table} in {backup}")
    if any("changed_seq" in s.names for s in schemas(spark, backup, backup_type=SST, **parts)):
        raise ValueError(f"{keyspace}.{table} has increments with deletions: restore_changes restores those")
    snapshot_rows = SnapshotRows(spark, backup, schema, dest, **parts)
    base, more = snapshot_rows.watched, read_copies(spark, backup, schema, backup_type=SST, **parts)

    if not keys or version is None:
        restored = base.unionByName(more)
    elif one_row_per_key:
        restored = _overlay(snapshot_rows.plain, more, list(keys), version, base)
    else:
        restored = last_version(base.unionByName(more), list(keys), [version])
    return snapshot_rows.restored(restored.select(*schema.names))


def read_copies(spark: SparkSession, backup: str, schema: T.StructType, **parts: str) -> DataFrame:
    """The rows of a table's finished copies in one partition, and of files that lie there beside copies."""
    rows, done = read_backup(spark, backup, schema, **parts), copies(backup, **parts)
    names = [f.rstrip("/").rsplit("/", 1)[-1] for f in folders(table_folder(backup, **parts))]
    if unfinished := [n for n in names if n not in done]:
        rows = rows.where(~F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1).isin(unfinished))
    return rows.select(*schema.names)


class SnapshotRows:
    """The rows of a snapshot that a restore reads, checked against the manifests.

    Names and lengths of all files are checked at once, and where the restore is written to ``dest``, the
    content of the increments, which it needs twice anyway. The snapshot is read once: ``watched`` are its
    rows with their digest observed in that pass, for one place of a plan where all of them are read
    (``plain`` are the rows for other places), and it is compared when the restore has been written.
    Where the schema differs from that of the backup, the snapshot is checked in a pass of its own.
    """

    def __init__(self, spark: SparkSession, backup: str, schema: T.StructType, dest: str | None, **parts: str):
        self.spark, self.backup, self.schema, self.dest, self.parts = spark, backup, schema, dest, parts | {"backup_type": SNAP}
        in_passing = dest is not None and agree(schema, schemas(spark, backup, **self.parts))
        refuse_damaged(spark, backup, dest is not None and not in_passing, **self.parts)
        refuse_damaged(spark, backup, dest is not None, **parts, backup_type=SST)
        self.plain = read_copies(spark, backup, schema, **self.parts)
        self.watched, self.seen = observed(self.plain) if in_passing else (self.plain, None)

    def restored(self, rows: DataFrame) -> DataFrame:
        """The rows, written to ``dest`` if there is one; deleted again if they came from others than were
        backed up."""
        if self.dest is None:
            return rows
        rows.write.mode("errorifexists").parquet(self.dest)
        if self.seen is not None:
            try:
                refuse_others(self.spark, self.backup, self.seen, **self.parts)
            except DamagedBackup:
                delete_folder(self.dest)
                raise
        return self.spark.read.schema(self.schema).parquet(self.dest)


def _overlay(base: DataFrame, increments: DataFrame, keys: list[str], version: str, base_rows: DataFrame) -> DataFrame:
    """``base``, which holds a key once, with the last of the increments in place of older rows.

    The joins meet keys and versions only. Small increments are broadcast by the planner, which
    knows their size from their files, and the snapshot is then not shuffled at all. A missing
    version counts as the lowest. ``base_rows`` are the rows of ``base`` once more, to be passed on.
    """
    newest = increments.groupBy(*keys).agg(F.max(version).alias("_version"))
    newest = newest.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    old = F.col(version).isNull() | F.coalesce(F.col("_version") >= F.col(version), F.lit(False))
    kept = base_rows.join(newest, same & old, "left_anti")
    stale = base.select(*keys, version).join(newest, same & ~old).select(*keys)
    newer = last_version(increments, keys, [version])
    return kept.unionByName(join_on(newer, stale, keys, "left_anti").select(*base_rows.columns))
