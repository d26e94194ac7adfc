"""Change sets: what turns one state of a table into another, deletions included.

A change set has the columns of the table and ``change``: *insert* or *update* with the whole row,
*delete* with the key alone (a tombstone). Keys may be null, and may have several rows: a key whose rows
differ in anything is updated as a whole, with all rows that it has now.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.operators.digests import digest, row_hash
from strongbox.operators.joins import join_on
from strongbox.workspace import new_folder

# ---- fixed values -------------------------------------------------------------------------

INSERT, UPDATE, DELETE = "insert", "update", "delete"

# ---- operators ----------------------------------------------------------------------------


def changed_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys whose rows differ between two states, and how: keys, change.

    Both sides are hashed where they are read and met in one grouping by key, so that one shuffle of
    keys and hashes, combined on the map side, finds what is inserted, updated and deleted. No
    version column is needed.
    """
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError(f"the two states have other columns: {sorted(set(before.columns) ^ set(after.columns))}")

    def side(rows: DataFrame, is_after: bool) -> DataFrame:
        rest = T.StructType([f for f in rows.schema.fields if f.name not in keys])
        return rows.select(*keys, row_hash(rest).alias("_hash"), F.lit(is_after).alias("_after"))

    def of(is_after: bool, name: str) -> Column:
        own = F.when(F.col("_after") == F.lit(is_after), F.col("_hash"))
        return F.struct(*digest(own)).alias(name)

    both = side(before, False).unionByName(side(after, True))
    met = both.groupBy(*keys).agg(of(False, "_old"), of(True, "_new")).where("_old <> _new")
    kind = F.when(F.col("_old.n_rows") == 0, INSERT).when(F.col("_new.n_rows") == 0, DELETE).otherwise(UPDATE)
    return met.select(*keys, kind.alias("change"))


def change_set(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that turn ``before`` into ``after``: the columns of ``after``, and change.

    The changed keys are written down first. Their size is then known, and the planner broadcasts them if
    they are few, so whole rows are shuffled only where much has changed.
    """
    if not keys:
        raise ValueError("a change set needs keys")
    if "change" in after.columns:
        raise ValueError("columns named like those of a change set: ['change']")
    found = changed_keys(before, after, keys)
    written = new_folder(after.sparkSession, "changed-keys")
    found.write.parquet(written)
    found = after.sparkSession.read.schema(found.schema).parquet(written)
    rows = join_on(after, found.where(F.col("change") != DELETE), keys)
    return rows.unionByName(found.where(F.col("change") == DELETE), allowMissingColumns=True)


def apply_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], rows: Sequence[DataFrame] = ()) -> DataFrame:
    """``base`` after all ``changes``; of each key the change that is last by ``order`` holds.

    ``changes`` has the columns of ``base``, change, and those of ``order``. The last change of each key
    is one grouping with map-side combine over keys and order alone; rows of ``base`` meet those keys
    only, and are not shuffled where few keys have changed. Rows of a key with the same place in the
    order belong together. ``rows`` may be the same changes, from one or more sources.
    """
    last = changes.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    kept = join_on(base, last.select(*keys), keys, "left_anti")
    for part in rows or [changes]:
        newest = join_on(part, last, keys).where(F.struct(*order).eqNullSafe(F.col("_last")) & (F.col("change") != DELETE))
        kept = kept.unionByName(newest.select(*base.columns))
    return kept
