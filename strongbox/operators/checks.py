"""Threshold checks of a whole fleet in one job.

``warn`` and ``crit`` are numbers, or names of columns joined in with ``with_thresholds``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.functions.keys import present
from strongbox.functions.thresholds import classify, code, message


def with_thresholds(readings: DataFrame, thresholds: DataFrame, on: str) -> DataFrame:
    """Readings with the columns ``warn`` and ``crit`` of their scope."""
    return readings.join(thresholds.select(on, "warn", "crit"), on, "left")


def _check(readings: DataFrame, label: str, value: Column, warn, crit, **rules) -> DataFrame:
    checked = readings.withColumn("state", classify(value, warn, crit, **rules))
    return checked.withColumns({"code": code("state"), "message": message("state", label, value, warn, crit)})


def check_live_nodes(status: DataFrame, warn, crit) -> DataFrame:
    """Few live nodes are bad."""
    return _check(status, "live nodes count", F.col("live_nodes"), warn, crit, low_is_bad=True)


def _age(status: DataFrame, kind: str, warn, crit) -> DataFrame:
    column = f"last_{kind}_backup_age_mins"
    return _check(status, column, F.col(column), warn, crit, negative_is_critical=True)


def check_sst_backup_age(status: DataFrame, warn, crit) -> DataFrame:
    """An increment that is too old, or that never was."""
    return _age(status, "sst", warn, crit)


def check_snap_backup_age(status: DataFrame, warn, crit) -> DataFrame:
    """A snapshot that is too old, or that never was."""
    return _age(status, "snap", warn, crit)


def check_cl_backup_age(status: DataFrame, warn, crit) -> DataFrame:
    """A change-log copy that is too old, or that never was."""
    return _age(status, "cl", warn, crit)


def check_heap_usage(nodes: DataFrame, warn, crit) -> DataFrame:
    """The whole percentage of heap in use."""
    used = F.when(F.col("heap_usage_perc") >= 0, F.floor("heap_usage_perc")).otherwise(F.ceil("heap_usage_perc"))
    return _check(nodes, "heap_usage_perc", used, warn, crit)


def _latency(tables: DataFrame, label: str, column: str, warn, crit) -> DataFrame:
    named = present("keyspace").isNotNull() & present("cf").isNotNull()
    return _check(tables, label, F.when(named, F.col(column)), warn, crit)


def check_write_latency(tables: DataFrame, warn, crit) -> DataFrame:
    """Mean write latency; unknown without a keyspace, a table or a reading."""
    return _latency(tables, "write_latency", "WriteLatency_mean", warn, crit)


def check_read_latency(tables: DataFrame, warn, crit) -> DataFrame:
    """Mean read latency; unknown without a keyspace, a table or a reading."""
    return _latency(tables, "read_latency", "ReadLatency_mean", warn, crit)
