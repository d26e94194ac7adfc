"""Finding what there is to back up and what has been backed up."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.schemas import SNAP, SST

# .../<keyspace>/<table>/snapshots/<name>/<file> and .../<keyspace>/<table>/backups/<file>
SNAPSHOT_FOLDER = r"^(.*/[^/]+/[^/]+/snapshots/[^/]+)/.+$"
INCREMENT_FOLDER = r"^(.*/[^/]+/[^/]+/backups)/.+$"


def _folders(files: DataFrame, pattern: str) -> DataFrame:
    """Folders that match, with file count and bytes; names are taken from the folder later."""
    found = files.select(F.regexp_extract("path", pattern, 1).alias("directory"), "length")
    return _count(found.where(F.col("directory") != ""), "directory")


def _from_end(i: int) -> Column:
    return F.split_part("directory", F.lit("/"), F.lit(-i))


def discover_snapshot_dirs(files: DataFrame, snapshot: str | None = None) -> DataFrame:
    """Staged snapshot folders, of one snapshot or of all, with file count and bytes."""
    if snapshot is not None:
        files = files.where(F.col("path").contains(f"/snapshots/{snapshot}/"))
    found = _folders(files, SNAPSHOT_FOLDER).select(
        _from_end(4).alias("keyspace"), _from_end(3).alias("table"), _from_end(1).alias("snapshot"), "directory", "n_files", "n_bytes"
    )
    return found if snapshot is None else found.where(F.col("snapshot") == snapshot)


def discover_increment_dirs(files: DataFrame) -> DataFrame:
    """Folders of increments, with file count and bytes."""
    return _folders(files, INCREMENT_FOLDER).select(
        _from_end(3).alias("keyspace"), _from_end(2).alias("table"), "directory", "n_files", "n_bytes"
    )


def discover_change_log(files: DataFrame, log_dir: str, required: bool = False) -> DataFrame:
    """The change-log folder with its file count and bytes; no row, or an error, without one."""
    log_dir = log_dir.rstrip("/")
    found = files.where(F.col("path").startswith(log_dir + "/")).select(F.lit(log_dir).alias("directory"), "length")
    if required and found.isEmpty():
        raise ValueError(f"no change log in {log_dir}")
    return _count(found, "directory")


def _count(files: DataFrame, *by: str) -> DataFrame:
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def files_per_table(files: DataFrame) -> DataFrame:
    """File count and bytes of every host, backup type, keyspace and table."""
    return _count(files, "host_id", "backup_type", "keyspace", "table")


def list_backup_objects(objects: DataFrame, prefix: str) -> DataFrame:
    """All objects below a prefix that ends at a whole part, so ``a`` does not find ``ab``."""
    prefix = prefix.rstrip("/")
    return objects.where((F.col("object_key") == prefix) | F.col("object_key").startswith(prefix + "/"))


def mark_copied(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Adds ``copied``: whether the manifest lists the file. One join; the manifest may repeat."""
    listed = manifest.select(key).distinct().withColumn("_listed", F.lit(True))
    return files.join(listed, key, "left").withColumn("copied", F.col("_listed").isNotNull()).drop("_listed")


def new_since_backup(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Files that the manifest does not list."""
    return files.join(manifest.select(key), key, "left_anti")


def already_backed_up(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Files that the manifest lists."""
    return files.join(manifest.select(key), key, "left_semi")


def union_backup_types(objects: DataFrame) -> DataFrame:
    """The objects of one restore: snapshot objects (``step`` 0), then increments (``step`` 1)."""
    step = F.when(F.col("backup_type") == SNAP, 0).when(F.col("backup_type") == SST, 1).cast("bigint")
    return objects.where(F.col("backup_type").isin(SNAP, SST)).withColumn("step", step)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot name of each host; the names sort by time."""
    return snapshots.groupBy("host_id").agg(F.max("snapshot").alias("snapshot"))
