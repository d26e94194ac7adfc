"""The catalogue of backup objects as a table clustered by key, and lists as rows of any number.

Objects are written in ranges of their key, sorted within a file, so that a prefix reads the files and row
groups whose smallest and largest keys surround it and skips the others. The catalogue is versioned: a
version that was written to its end replaces the one before, and readers of that one are not disturbed.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.filesystem import delete_folder, exists, folders

#: Objects in one file of the catalogue, about, and bytes of a row group: what a prefix reads at least.
ROWS_PER_FILE, ROW_GROUP_BYTES = 2_000_000, 4 << 20
KEPT_VERSIONS = 2


def write_catalogue(objects: DataFrame, folder: str, key: str = "object_key", rows_per_file: int = ROWS_PER_FILE) -> int:
    """Writes a new version of the catalogue and returns its number. One shuffle, by ranges of the key that
    Spark balances by sampling; keys may repeat. Versions before the last two are deleted."""
    rows = objects.count()
    version = max(_versions(folder), default=0) + 1
    ranged = objects.repartitionByRange(max(1, -(-rows // rows_per_file)), key).sortWithinPartitions(key)
    ranged.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(_place(folder, version))
    for old in _versions(folder)[:-KEPT_VERSIONS]:
        delete_folder(_place(folder, old))
    return version


def update_catalogue(spark: SparkSession, folder: str, schema: T.StructType, added: DataFrame, removed: DataFrame, key: str = "object_key") -> int:
    """A new version with the objects in ``added``, which replace those of the same key, and without the keys
    in ``removed``."""
    gone = added.select(key).unionByName(removed.select(key)).distinct()
    kept = read_catalogue(spark, folder, schema).join(gone, key, "left_anti")
    return write_catalogue(kept.unionByName(added), folder, key)


def read_catalogue(spark: SparkSession, folder: str, schema: T.StructType, prefix: str | None = None, key: str = "object_key") -> DataFrame:
    """The objects of the last whole version, or those below a prefix that ends at a whole part of the key.
    The prefix becomes bounds on the key, which reach the scan."""
    versions = _versions(folder)
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(_place(folder, versions[-1]))
    if prefix is None or not prefix.rstrip("/"):
        return rows
    prefix = prefix.rstrip("/")
    # '0' comes right behind '/': every key below the prefix lies between the two.
    return rows.where((F.col(key) == prefix) | ((F.col(key) >= f"{prefix}/") & (F.col(key) < f"{prefix}0")))


def _place(folder: str, version: int) -> str:
    return f"{folder}/version-{version:09d}"


def _versions(folder: str) -> list[int]:
    """The versions that were written to their end."""
    found = [f.rstrip("/").rsplit("/", 1)[-1] for f in folders(folder)]
    return sorted(int(f.rsplit("-", 1)[-1]) for f in found if f.startswith("version-") and exists(f"{folder}/{f}/_SUCCESS"))


def listed(rows: DataFrame, keys: Sequence[str], item: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The items of each key as two tables that keep their shape however many there are: a row per key with
    n_items and total (of ``weight``, or again of items), and a row per item in the order of key and item.
    Items are ordered across files by ranges, so no key is held in one task."""
    keys = list(keys)
    total = F.sum(weight) if weight else F.count(F.lit(1))
    heads = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), total.alias("total"))
    ranged = rows.select(*keys, item, *([weight] if weight else []))
    return heads, ranged.repartitionByRange(*keys, item).sortWithinPartitions(*keys, item)
