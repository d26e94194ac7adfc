"""Metrics of operations, objects, tables and nodes."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongbox.functions.status import heap_usage
from strongbox.operators.backups import bounded_lists
from strongbox.operators.ordered import MAX_ROWS, running_in, slice_hot_keys
from strongbox.schemas import TABLE_METRICS

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def execution_times(points: DataFrame, by: Sequence[str], elapsed: str = "elapsed_ms", max_rows: int = MAX_ROWS) -> DataFrame:
    """Count, sum, min, max, mean and exact percentiles of elapsed times.

    Times are whole milliseconds. They are counted per distinct value first, so that a group
    comes down to its histogram; percentiles are then read off the counts up to and from each value,
    whose sum is that of the group: no group has to meet its total in a join.
    """
    by = list(by)
    histogram = points.where(F.col(elapsed).isNotNull()).groupBy(*by, elapsed).agg(F.count(F.lit(1)).alias("_n"))
    sliced = slice_hot_keys(histogram, by, [elapsed], max_rows)
    upto = running_in(sliced, [elapsed], {"_upto": ("sum", F.col("_n"))})
    ranked = running_in(upto, [elapsed], {"_from": ("sum", F.col("_n"))}, descending=True).rows
    placed = ranked.withColumn("_all", F.col("_upto") + F.col("_from") - F.col("_n"))
    picks = []
    for name, share in PERCENTILES.items():
        at = F.lit(share) * (F.col("_all") - 1)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col(elapsed))).alias(f"_{name}_{end}"))
    picked = placed.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.sum(F.col(elapsed) * F.col("_n")).alias("total_ms"),
        F.min(elapsed).alias("min_ms"),
        F.max(elapsed).alias("max_ms"),
        *picks,
    )
    exact = {}
    for name, share in PERCENTILES.items():
        at = F.lit(share) * (F.col("n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        exact[f"{name}_ms"] = low + (high - low) * (at - F.floor(at))
    return picked.withColumn("mean_ms", F.col("total_ms") / F.col("n")).withColumns(exact).select(
        *by, "n", "total_ms", "min_ms", "max_ms", "mean_ms", *exact
    )


def size_histogram(objects: DataFrame, by: Sequence[str] = (), length: str = "length") -> DataFrame:
    """Number of objects and bytes per power of two; ``size_from`` is the lower bound."""
    # The bits of a whole number give its power of two without floating point.
    power = F.when(F.col(length) > 0, F.length(F.bin(F.col(length))) - 1).otherwise(-1).cast("bigint")
    lower = F.when(F.col("power") >= 0, F.expr("shiftleft(bigint(1), cast(power as int))")).otherwise(F.lit(0).cast("bigint"))
    return (
        objects.withColumn("power", power).groupBy(*by, "power")
        .agg(F.count(F.lit(1)).alias("n_objects"), F.sum(length).alias("n_bytes"))
        .withColumn("size_from", lower)
    )


def column_family_metrics(samples: DataFrame, metrics: Sequence[str] = TABLE_METRICS) -> DataFrame:
    """One row per table with the latest value of every metric, and the mean of latencies."""
    metrics = list(metrics)
    newest = F.max_by("value", F.struct("ts", "sample_id"))
    per_metric = samples.where(F.col("metric").isin(metrics)).groupBy("cf", "metric").agg(
        newest.alias("value"), F.avg("value").alias("mean")
    )
    columns = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    columns += [
        F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(f"{m}_mean") for m in metrics if m.endswith("Latency")
    ]
    return per_metric.groupBy("cf").agg(*columns)


def cluster_status(nodes: DataFrame, ages: DataFrame) -> DataFrame:
    """Per data centre: nodes up and down, heap, and the oldest last backup of each kind.

    ``ages`` is the result of ``backup_age_minutes``; hosts that never ran a backup are counted.
    """
    kinds = ("snap", "sst", "cl")
    known = heap_usage(nodes).join(ages, "host_id", "left")
    columns = [
        F.count_if(F.col("live")).alias("live_nodes"),
        F.count_if(~F.col("live")).alias("unreachable_nodes"),
        (F.sum("heap_used_bytes") / F.nullif(F.sum("heap_max_bytes"), F.lit(0)) * 100).alias("heap_usage_perc"),
    ]
    for kind in kinds:
        age = F.coalesce(F.col(f"last_{kind}_backup_age_mins"), F.lit(-1).cast("bigint"))
        columns += [
            F.max(age).alias(f"oldest_{kind}_backup_age_mins"),
            F.count_if(age < 0).alias(f"hosts_without_{kind}_backup"),
        ]
    return known.groupBy("dc").agg(*columns)


def cluster_metadata(nodes: DataFrame, keyspaces: DataFrame, limit: int = 10_000) -> DataFrame:
    """Metadata records per data centre: its hosts with rack, its tokens and the keyspaces.

    Lists are bounded: a longer one continues in the next ``part`` of its kind.
    """
    entries = nodes.select(
        "dc",
        F.explode(
            F.array(
                F.struct(F.lit("hosts").alias("kind"), F.concat_ws("=", "host_id", "rack").alias("entry")),
                F.struct(F.lit("tokens").alias("kind"), F.col("token").alias("entry")),
            )
        ).alias("e"),
    ).select("dc", "e.kind", "e.entry")
    shared = keyspaces.select("dc", F.lit("keyspaces").alias("kind"), F.col("keyspace").alias("entry"))
    lists = bounded_lists(entries.unionByName(shared).distinct(), ["dc", "kind"], "entry", limit)
    return lists.select("dc", "kind", "part", F.col("n_items").alias("n_entries"), F.to_json("items").alias("entries"))


def event_log(events: DataFrame) -> DataFrame:
    """Events with title, text, date, alert type and tags, as they are recorded."""
    alert = F.when(F.col("level") == "error", "error").when(F.col("level") == "success", "success").otherwise("info")
    return events.select("event_id", "title", "text", F.col("ts").alias("date"), alert.alias("alert_type"), "tags")
