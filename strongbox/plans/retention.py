"""What may go: backups by retention, and staged files whose rows are backed up.

Both work in two phases. A plan says of everything whether it goes or stays and why; it is written down.
Then the plan is carried out at once, not when some frame happens to be evaluated. Carrying a plan out
again, after a failure or not, removes what is left of it and nothing else.
"""

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.filesystem import delete_folder, exists, qualified, resolve, within
from strongbox.functions.keys import name_time
from strongbox.operators.digests import digest, row_hash
from strongbox.plans.manifest import _manifests, read_manifest, refuse_damaged
from strongbox.schemas import BACKUP_PARTITIONS, CL, SNAP, SST
from strongbox.sources.files import read_backup, table_folder

FOLDERS_AT_A_TIME = 16


@dataclass(frozen=True)
class Retention:
    """Which snapshots of a table stay: the ``last`` ones, and the newest of each of the last ``days`` days and
    ``months`` months that have any. The newest always stays."""

    last: int = 1
    days: int = 0
    months: int = 0


# ---- backups --------------------------------------------------------------------------------


def plan_expiry(spark: SparkSession, backup: str, keep: Retention, **parts: str) -> DataFrame:
    """What a retention makes of the finished copies of a backup: a row per partition (snapshot, backup_type,
    keyspace, table) with its copies, files, rows, bytes, ``action`` (keep or expire) and ``reason``.

    Snapshots are kept per table as ``last``, ``day`` or ``month``. What a kept snapshot needs is kept with it
    (``needed``): its increments, and the change logs below its name as long as any table has a kept
    snapshot of that name. Snapshots whose name is no time are never expired (``unnamed``), and neither
    are increments without a snapshot (``unknown``): something else may still write there.
    """
    manifest = read_manifest(spark, backup, **parts)
    held = manifest.groupBy(*BACKUP_PARTITIONS).agg(
        F.countDistinct("copy").alias("copies"), F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"), F.sum("length").alias("length")
    )
    table = ["keyspace", "table"]
    snapshots = held.where(F.col("backup_type") == SNAP).select(*table, "snapshot", name_time("snapshot").alias("_at"))
    named = snapshots.where(F.col("_at").isNotNull())

    def newest(period: str) -> DataFrame:
        """Each table's newest snapshots of its last periods, newest period first."""
        by = named.withColumn("_period", F.date_trunc(period, "_at")).groupBy(*table, "_period").agg(F.max_by("snapshot", "_at").alias("snapshot"))
        # A table has as many rows here as snapshots.
        return by.withColumn("_nth", F.row_number().over(Window.partitionBy(*table).orderBy(F.desc("_period"))))

    recent = named.withColumn("_nth", F.row_number().over(Window.partitionBy(*table).orderBy(F.desc("_at"), F.desc("snapshot"))))
    kept = [
        recent.where(F.col("_nth") <= max(keep.last, 1)).select(*table, "snapshot", F.lit("last").alias("_why"), F.lit(0).alias("_rank")),
        newest("day").where(F.col("_nth") <= keep.days).select(*table, "snapshot", F.lit("day").alias("_why"), F.lit(1).alias("_rank")),
        newest("month").where(F.col("_nth") <= keep.months).select(*table, "snapshot", F.lit("month").alias("_why"), F.lit(2).alias("_rank")),
        snapshots.where(F.col("_at").isNull()).select(*table, "snapshot", F.lit("unnamed").alias("_why"), F.lit(3).alias("_rank")),
    ]
    stays = kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3])
    stays = stays.groupBy("snapshot", *table).agg(F.min_by("_why", "_rank").alias("_why"))
    below = stays.select("snapshot").distinct().withColumn("_below", F.lit(True))
    taken = snapshots.select("snapshot", *table).withColumn("_taken", F.lit(True))
    names = snapshots.select("snapshot").distinct().withColumn("_name", F.lit(True))
    met = held.join(stays, ["snapshot", *table], "left").join(below, "snapshot", "left").join(taken, ["snapshot", *table], "left").join(names, "snapshot", "left")
    kind = F.col("backup_type")
    reason = (
        F.when(kind == SNAP, F.col("_why"))
        .when((kind == SST) & F.col("_why").isNotNull(), "needed")
        .when((kind == SST) & F.col("_taken").isNull(), "unknown")
        .when((kind == CL) & F.col("_below").isNotNull(), "needed")
        .when((kind == CL) & F.col("_name").isNull(), "unknown")
    )
    rows = met.withColumn("_reason", reason)
    return rows.select(
        *BACKUP_PARTITIONS, "copies", "files", "n_rows", "length",
        F.when(F.col("_reason").isNull(), "expire").otherwise("keep").alias("action"),
        F.coalesce("_reason", F.lit("expired")).alias("reason"),
    )


def expire_backups(spark: SparkSession, backup: str, keep: Retention, execute: bool = False, **parts: str) -> DataFrame:
    """The plan of ``plan_expiry``; with ``execute`` what expires is deleted before this returns.

    Rows go before manifests, so a deletion that breaks off is seen, and finished, by the next one.
    Increments and logs go before the snapshots that they need. The plan that was carried out is kept
    below ``<backup>/_expired``.
    """
    plan = plan_expiry(spark, backup, keep, **parts)
    if not execute:
        return plan
    now = datetime.now(UTC)
    place = f"{backup}/_expired/at={now:%Y%m%dT%H%M%S%f}"
    plan.write.parquet(place)
    plan = spark.read.schema(plan.schema).parquet(place)
    # A row per partition of a table; not its files.
    gone = plan.where("action = 'expire'").select(*BACKUP_PARTITIONS).collect()
    for level in (lambda r: r["backup_type"] != SNAP, lambda r: r["backup_type"] == SNAP):
        with ThreadPoolExecutor(FOLDERS_AT_A_TIME) as pool:
            list(pool.map(lambda r: _delete_partition(backup, r.asDict()), [r for r in gone if level(r)]))
    return plan


def _delete_partition(backup: str, parts: dict[str, str]) -> None:
    for root in (backup, _manifests(backup)):
        if exists(table_folder(root, **parts)):
            delete_folder(table_folder(root, **parts))


# ---- staged files -----------------------------------------------------------------------------

PRUNED = "path string, length bigint, modified timestamp, n_rows bigint, backed_up bigint, action string"


def plan_prune(spark: SparkSession, backup: str, staged: str, schema: T.StructType, plan: str, **parts: str) -> DataFrame:
    """Writes to ``plan`` which Parquet files below ``staged`` may go: those with every row in the backup.

    A row per file that has rows: path, length, modified, n_rows, backed_up (how many of its rows a
    finished copy of the table in ``parts`` holds, by the hash of the whole row) and action (remove or
    keep). The copies are checked first, content included: rows that can no longer be read from the backup
    don't count. One join of hashes; the rows of the backup are hashed where they are read.
    """
    refuse_damaged(spark, backup, True, **parts)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(staged)
    # Spark names files by URI; a '+' stands for itself there.
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    file = [path.alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified")]
    hashed = rows.select(*file, row_hash(schema).alias("_hash"))
    held = read_backup(spark, backup, schema, **parts).select(row_hash(schema).alias("_hash")).distinct().withColumn("_held", F.lit(1).cast("bigint"))
    met = hashed.join(held, "_hash", "left").groupBy("path").agg(
        F.max("length").alias("length"), F.max("modified").alias("modified"), digest(F.col("_hash"))[0], F.coalesce(F.sum("_held"), F.lit(0)).alias("backed_up")
    )
    decided = met.select("path", "length", "modified", "n_rows", "backed_up", F.when(F.col("n_rows") == F.col("backed_up"), "remove").otherwise("keep").alias("action"))
    decided.write.mode("errorifexists").parquet(f"{plan}/planned")
    return spark.read.schema(PRUNED).parquet(f"{plan}/planned")


def execute_prune(spark: SparkSession, plan: str) -> DataFrame:
    """Carries out a plan of ``plan_prune`` and returns its rows with ``outcome``: removed (or gone already),
    changed (the file is not the one that was planned for, and stays) or kept.

    Files are deleted by tasks, before this returns; the outcome is kept beside the plan, and calling it
    again gives it back without looking at files that are done.
    """
    planned, done = spark.read.schema(PRUNED).parquet(f"{plan}/planned"), f"{plan}/done"
    schema = T.StructType([*planned.schema.fields, T.StructField("outcome", T.StringType())])
    if not exists(f"{done}/_SUCCESS"):
        base = qualified("/")

        def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                outcomes = []
                for path, length, modified, action in batch[["path", "length", "modified", "action"]].itertuples(index=False, name=None):
                    store, inner = resolve(within(base, path))
                    info = store.get_file_info(inner)
                    if action != "remove":
                        outcomes.append("kept")
                    elif not info.is_file:
                        outcomes.append("removed")
                    elif info.size != length or int(info.mtime.timestamp() * 1000) != int(modified.timestamp() * 1000):
                        outcomes.append("changed")
                    else:
                        store.delete_file(inner)
                        outcomes.append("removed")
                yield batch.assign(outcome=outcomes)

        planned.mapInPandas(remove, schema).write.mode("overwrite").parquet(done)
    return spark.read.schema(schema).parquet(done)
