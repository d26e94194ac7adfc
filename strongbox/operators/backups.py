"""Results, state, metadata and clean-up of backups."""

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongbox.filesystem import qualified, resolve, within
from strongbox.functions.keys import hash_part, metric_name, object_key, removable, snapshot_name
from strongbox.operators.catalog import mark_copied
from strongbox.operators.joins import SMALL_TABLE_ROWS, join_on
from strongbox.schemas import CL, META, SNAP, SST, UNKNOWN_NUMBER

LIST_LIMIT = 10_000


def bounded_lists(rows: DataFrame, keys: Sequence[str], item: str, limit: int = LIST_LIMIT, weight: str | None = None) -> DataFrame:
    """Sorted lists of the items of each key, about ``limit`` items in one.

    A key with more items gets several lists, numbered by ``part``, so no task holds a whole key.
    ``n_items`` counts, and ``total`` adds up ``weight`` over, the key and not the part.
    """
    keys = list(keys)
    count = F.count(F.lit(1))
    weighed = F.sum(weight) if weight else count
    long = rows.groupBy(*keys).agg(count.alias("_n"), weighed.alias("_total")).where(F.col("_n") > limit)
    known = long.limit(SMALL_TABLE_ROWS + 1).collect()
    few = len(known) <= SMALL_TABLE_ROWS
    if known:
        long = rows.sparkSession.createDataFrame(known, long.schema) if few else long
        rows = join_on(rows, long, keys, "left", small=few)
        parts = F.coalesce(F.ceil(F.col("_n") / limit), F.lit(1))
        rows = rows.withColumn("part", hash_part(item, parts))
    else:
        nothing = F.lit(None).cast("bigint")
        rows = rows.withColumns({"_n": nothing, "_total": nothing, "part": F.lit(0).cast("bigint")})
    lists = rows.groupBy(*keys, "part").agg(
        F.coalesce(F.max("_n"), count).alias("n_items"),
        F.coalesce(F.max("_total"), weighed).alias("total"),
        F.sort_array(F.collect_list(item)).alias("items"),
    )
    return lists


def fold_backup_results(manifest: DataFrame) -> DataFrame:
    """Directories and total file count of each host, snapshot, backup type and keyspace.

    Counted per directory first, so only directories are listed, never files.
    """
    backup = ["host_id", "snapshot", "backup_type", "keyspace"]
    directories = manifest.groupBy(*backup, "directory").agg(F.count(F.lit(1)).alias("n_files"))
    return bounded_lists(directories, backup, "directory", weight="n_files").select(
        *backup, F.col("total").alias("files_count"), F.col("n_items").alias("n_directories"), "part", F.col("items").alias("directories")
    )


def write_backup_state(operations: DataFrame, base: str, cluster: str) -> DataFrame:
    """State documents of backups: when one starts, and when it is complete.

    ``operations`` has host_id, keyspace, snapshot, backup_type, backup_format, started,
    finished (null while or if it does not finish) and files_count.
    """
    moments = F.array(
        F.struct(F.lit("inprogress").alias("status"), F.col("started").alias("at"),
                 F.lit(UNKNOWN_NUMBER).cast("bigint").alias("files")),
        F.struct(F.lit("complete").alias("status"), F.col("finished").alias("at"), F.col("files_count").cast("bigint").alias("files")),
    )
    states = operations.withColumn("_m", F.explode(moments)).where(F.col("_m.at").isNotNull())
    key = object_key(base, F.lit(cluster), "host_id", "snapshot", F.lit(META), "keyspace", F.lit("[global]"))
    document = F.struct(
        F.col("snapshot").alias("name"),
        F.lower("backup_format").alias("backupFormat"),
        F.col("_m.status").alias("status"),
        snapshot_name("_m.at").alias("timestamp"),
    )
    return states.withColumns(
        {
            "object_key": F.concat(key, F.lit("/BackupState"), F.col("backup_type"), F.lit(".txt")),
            "document": F.to_json(document),
            "status": F.col("_m.status"),
            "files_count": F.col("_m.files"),
            "written": F.col("_m.at"),
        }
    ).drop("_m")


def write_backup_metadata(manifest: DataFrame, taken: str, limit: int = LIST_LIMIT) -> DataFrame:
    """Metadata documents per host, snapshot, type, keyspace and table: file count and files.

    ``taken`` names the moment of the backup; it is part of the name of increments and change
    logs, of which there may be many below one snapshot.
    """
    table = ["host_id", "snapshot", "backup_type", "keyspace", "table"]
    lists = bounded_lists(manifest.where(F.col("backup_type").isin(SNAP, SST, CL)), table, "file_name", limit)
    name = (
        F.when(F.col("backup_type") == SNAP, "SnapshotMetaData.txt")
        .when(F.col("backup_type") == SST, f"SSTMetaData-{taken}.txt")
        .otherwise(f"ClMetaData-{taken}.txt")
    )
    document = F.to_json(F.struct(F.col("n_items").alias("filesCount"), F.col("items").alias("files")))
    return lists.select(*table, "part", F.col("n_items").alias("files_count"), name.alias("document_name"), document.alias("document"))


def reconcile_counts(source: DataFrame, archived: DataFrame, uploaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """File counts of three listings side by side, and whether they agree.

    Each listing is counted with map-side combine, the counts are added up in one more grouping,
    so no join meets a listing.
    """
    listings = {"source": source, "archived": archived, "uploaded": uploaded}
    counted = None
    for name, listing in listings.items():
        one = listing.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        counted = one if counted is None else counted.unionByName(one, allowMissingColumns=True)
    totals = counted.groupBy(*keys).agg(
        *[F.coalesce(F.sum(f"n_{n}"), F.lit(0).cast("bigint")).alias(f"n_{n}") for n in listings]
    )
    agree = (F.col("n_source") == F.col("n_archived")) & (F.col("n_archived") == F.col("n_uploaded"))
    return totals.withColumn("agree", agree)


def prune_backed_up(files: DataFrame, manifest: DataFrame, key: str, path: str | None = None, execute: bool = False) -> DataFrame:
    """Adds ``action``: sources of increments that the manifest lists are removed, others kept.

    ``execute`` deletes them, in the tasks, and returns what was deleted.
    """
    gone = F.coalesce(removable("backup_type"), F.lit(False)) & F.col("copied")
    decided = mark_copied(files, manifest, key).withColumn("action", F.when(gone, "removed").otherwise("kept")).drop("copied")
    if not execute:
        return decided
    return delete_files(decided.where(F.col("action") == "removed"), path or key)


def delete_files(files: DataFrame, path: str) -> DataFrame:
    """Deletes files and returns their paths. A file that is gone already is not an error."""

    base = qualified("/")

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch[path]:
                store, inner = resolve(within(base, one))
                try:
                    store.delete_file(inner)
                except FileNotFoundError:
                    pass
            yield batch

    return files.select(path).mapInPandas(delete, files.select(path).schema)


def expire_snapshots(snapshots: DataFrame, keyspace: str | None = None) -> DataFrame:
    """Staged snapshots older than the newest one of their host and keyspace."""
    if keyspace is not None:
        snapshots = snapshots.where(F.col("keyspace") == keyspace)
    staged = snapshots.select("host_id", "keyspace", "snapshot").distinct()
    newest = staged.groupBy("host_id", "keyspace").agg(F.max("snapshot").alias("newest"))
    return staged.join(newest, ["host_id", "keyspace"]).where(F.col("snapshot") < F.col("newest"))


def completed_bytes(objects: DataFrame, provider: str) -> DataFrame:
    """Counter of uploaded bytes per backup type, each object counted once."""
    name = F.concat(F.lit("backup."), metric_name("backup_type"), F.lit(f".{provider}.completed_bytes"))
    return objects.groupBy("backup_type").agg(
        F.sum("length").alias("value"), F.count(F.lit(1)).alias("n_objects")
    ).withColumn("name", name)
