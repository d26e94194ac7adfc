"""Deciding which tables, objects and requests are acceptable."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.functions.keys import metric_name, parse_object_key, present, removable
from strongbox.schemas import DENIED_TABLES

SHARES = 64


def drop_denied_tables(files: DataFrame, denied: Mapping[str, Sequence[str] | None] = DENIED_TABLES) -> DataFrame:
    """Files of tables that may be backed up. The rules become one filter that reaches the scan."""
    whole = [keyspace for keyspace, tables in denied.items() if tables is None]
    refused = [F.coalesce(F.col("keyspace").isin(whole), F.lit(False))]
    for keyspace, tables in denied.items():
        if tables is not None:
            refused.append((F.col("keyspace") == keyspace) & F.col("table").isin(list(tables)))
    return files.where(~F.coalesce(reduce(lambda a, b: a | b, refused), F.lit(False)))


def classify_backup_type(files: DataFrame, strict: bool = False) -> DataFrame:
    """Adds the metric name of the backup type and whether its sources may be removed.

    An unknown type is an error if ``strict``, else it has no metric name and is not removable.
    """
    name = metric_name("backup_type")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown backup type "), F.coalesce("backup_type", F.lit("null"))))
        name = F.coalesce(name, unknown.cast("string"))
    return files.withColumns({"metric": name, "removable": F.coalesce(removable("backup_type"), F.lit(False))})


def validate_object_keys(objects: DataFrame, host: str | Column, backup_type: str | Column, strict: bool = False) -> DataFrame:
    """Parsed objects with ``reason``: null, or why the key does not belong to host and type.

    Host and type are compared ignoring case. ``strict`` makes the first bad key an error.
    """
    host, backup_type = (F.lit(v) if isinstance(v, str) else v for v in (host, backup_type))
    reason = (
        F.when(~F.col("valid"), "parts")
        .when(F.lower("host_id") != F.lower(host), "host")
        .when(F.lower("backup_type") != F.lower(backup_type), "type")
    )
    checked = parse_object_key(objects).withColumn("reason", reason)
    if strict:
        failed = F.raise_error(F.concat(F.lit("invalid object key "), F.col("object_key"))).cast("string")
        checked = checked.withColumn("reason", F.when(F.col("reason").isNotNull(), failed))
    return checked


def check_restore_scope(objects: DataFrame, keyspace: str, host: str) -> DataFrame:
    """Objects that must not be restored to this keyspace and host, with the reason."""
    if not (keyspace or "").strip() or not (host or "").strip():
        raise ValueError("a restore needs a keyspace and a host")
    reason = F.when(~F.col("keyspace").eqNullSafe(keyspace), "keyspace").when(~F.col("host_id").eqNullSafe(host), "host")
    return objects.withColumn("reason", reason).where(F.col("reason").isNotNull())


def expand_keyspaces(requests: DataFrame, keyspaces: DataFrame) -> DataFrame:
    """A request for ``*`` becomes one request per known keyspace, others stay as they are."""
    # Each request meets each share of the keyspaces; the planner broadcasts whichever side is small.
    known = keyspaces.select("keyspace").distinct().withColumn("_share", F.pmod(F.xxhash64("keyspace"), F.lit(SHARES)))
    stars = requests.where(F.col("keyspace") == "*").drop("keyspace")
    stars = stars.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))))
    others = requests.where(~F.col("keyspace").eqNullSafe("*"))
    return others.unionByName(stars.join(known, "_share").select(*requests.columns))


def default_host(requests: DataFrame, local_host: str) -> DataFrame:
    """A blank host means the local one; another host is flagged."""
    host = F.coalesce(present("host_id"), F.lit(local_host))
    return requests.withColumns({"host_id": host, "other_host": host != local_host})
