"""Node readings, status documents and counters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.functions.keys import name_time
from strongbox.schemas import (
    CL_STATE,
    MAX_INCREMENT,
    MB,
    NO_BACKUP,
    NODE_STATUS,
    SNAPSHOT_STATE,
    SST_STATE,
    UNKNOWN_NUMBER,
)


def whole_mb(n_bytes: str) -> Column:
    return F.expr(f"`{n_bytes}` div {MB}")


def bytes_to_mb(transfers: DataFrame, n_bytes: str = "bytes") -> DataFrame:
    return transfers.withColumn("mb", whole_mb(n_bytes))


def _decimal_mb(n_bytes: str) -> Column:
    hundredths = F.expr(f"(`{n_bytes}` * 100) div {MB}")
    cents = F.lpad((hundredths % 100).cast("string"), 2, "0")
    return F.concat_ws(".", F.expr(f"(`{n_bytes}` * 100) div {MB} div 100").cast("string"), cents)


def heap_usage(nodes: DataFrame, used: str = "heap_used_bytes", limit: str = "heap_max_bytes") -> DataFrame:
    """Used and largest heap in MB, as ``used/max`` text and as a percentage."""
    return nodes.withColumns(
        {
            "heap_used_mb": F.col(used) / MB,
            "heap_max_mb": F.col(limit) / MB,
            "heap_usage": F.concat_ws("/", _decimal_mb(used), _decimal_mb(limit)),
            "heap_usage_perc": F.col(used) / F.nullif(F.col(limit), F.lit(0)) * 100,
        }
    )


def status_json(nodes: DataFrame) -> DataFrame:
    """One status document per host."""
    return nodes.select("host_id", F.to_json(F.struct(*NODE_STATUS.names)).alias("status"))


def parse_status_json(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("status", NODE_STATUS).alias("s")).select("s.*")


def metric_from_json(document: str | Column, path: str) -> Column:
    """A number inside a nested document, such as ``WriteLatency.mean``; null if it is not there."""
    return F.get_json_object(document, f"$.{path}").try_cast("double")


def split_counter(points: DataFrame, value: str = "value") -> DataFrame:
    """One row per increment, none above the largest increment a collector takes."""
    pieces = F.expr(f"greatest((`{value}` + {MAX_INCREMENT - 1}) div {MAX_INCREMENT}, 1)")
    numbered = points.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    rest = F.col(value) - F.col("piece") * F.lit(MAX_INCREMENT).cast("bigint")
    return numbered.withColumn("increment", F.least(F.lit(MAX_INCREMENT).cast("bigint"), rest))


def age_minutes(text: str | Column, as_of: Column) -> Column:
    """Complete minutes from the time written as text to ``as_of``; null if it is no time."""
    return F.timestamp_diff("MINUTE", name_time(text), as_of)


def backup_age_minutes(state: DataFrame, as_of: str, hosts: str = "host_id", complete_only: bool = True) -> DataFrame:
    """Per host the last snapshot, increment and change log: what, how many files, how old.

    ``state`` holds one row per host and name. A time that is missing or unreadable gives the
    name ``(null)``, and -1 for count and age; so does a snapshot whose status isn't complete, unless
    ``complete_only`` is off.
    """
    names = [*SNAPSHOT_STATE, *SST_STATE, *CL_STATE]
    wide = state.groupBy(hosts).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    now = F.lit(as_of).cast("timestamp")
    snap_name, snap_status, snap_files = SNAPSHOT_STATE
    shown = {
        "snap": (F.concat(snap_name, F.lit("/"), F.coalesce(snap_status, F.lit(""))), F.col(snap_name), snap_files),
        "sst": (F.col(SST_STATE[0]), F.get(F.split(SST_STATE[0], "/"), F.lit(1)), SST_STATE[1]),
        "cl": (F.col(CL_STATE[0]), F.get(F.split(CL_STATE[0], "/"), F.lit(1)), CL_STATE[1]),
    }
    columns = []
    for kind, (text, time, files) in shown.items():
        age = age_minutes(time, now)
        if kind == "snap" and complete_only:
            age = F.when(F.col(snap_status) == "complete", age)
        known = age.isNotNull()
        unknown = F.lit(UNKNOWN_NUMBER).cast("bigint")
        columns += [
            F.when(known, text).otherwise(NO_BACKUP).alias(f"last_{kind}_backup"),
            F.when(known, F.coalesce(F.col(files).try_cast("bigint"), unknown)).otherwise(unknown).alias(f"last_{kind}_backup_filecount"),
            F.coalesce(age, unknown).alias(f"last_{kind}_backup_age_mins"),
        ]
    return wide.select(hosts, *columns)
