"""Key-value state in which the last write wins."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_version(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest version; combined on the map side."""
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(*version)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def latest_state(writes: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """The last write of each name by time, then by sequence number."""
    return last_version(writes, list(keys), ["date_modified", "seq"])


def upsert_state(state: DataFrame, writes: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """The state after the writes: a known name is replaced, a new one is added."""
    return latest_state(state.unionByName(writes), keys)


def point_lookup(state: DataFrame, name: str) -> DataFrame:
    """The state of one name, or no row. The filter is applied before the last write is sought."""
    return latest_state(state.where(F.col("name") == name)).limit(1)
