"""Documents of mixed values: the metrics of a table, and the status of a node.

A metric is a number, a latency (an object with its last value, mean and count) or a histogram (counts in
buckets that grow by a fifth). A document holds all of a table's metrics, and is read back as a variant:
each value keeps its own type, whatever the other documents hold.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.functions.keys import snapshot_name
from strongbox.functions.status import heap_usage
from strongbox.schemas import TABLE_METRICS

#: Buckets of a histogram; values above the last offset go into one more.
BUCKETS = 90
#: Tasks that write the records of nodes, so that a slow one doesn't hold up the rest.
TASKS_PER_CORE = 8
#: The lists of a node's record, which hold an entry for every node or keyspace of its cluster; the long ones first.
LISTS = ["host_id_map", "live_nodes", "unreachable_nodes", "keyspaces"]
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def bucket_offsets(buckets: int = BUCKETS) -> list[int]:
    """The largest value of each bucket: every one a fifth larger than the one before, and at least by one."""
    out = [1]
    while len(out) < buckets:
        out.append(max(out[-1] + 1, (out[-1] * 12 + 5) // 10))
    return out


def is_histogram(metric: str) -> bool:
    return metric.endswith("Histogram")


def is_latency(metric: str) -> bool:
    return metric.endswith("Latency") and not metric.endswith("TotalLatency")


def metric_documents(samples: DataFrame, by: Sequence[str] = ("cf",), metrics: Sequence[str] = TABLE_METRICS) -> DataFrame:
    """One document per table with every metric, null where there is no sample: the keys and ``document``.

    ``samples`` has the keys, metric, ts, sample_id and value. Numbers and latencies show the last value by
    time. Each metric comes down to one row, and each histogram to a row per bucket, before tables are put
    together, with map-side combine.
    """
    by, names = list(by), list(metrics)
    known = samples.where(F.col("metric").isin(names) & F.col("value").isNotNull())
    graded = known.where(F.col("metric").isin([m for m in names if is_histogram(m)]))
    bucket = F.size(F.filter(F.array(*map(F.lit, bucket_offsets())), lambda o: o < F.col("value")))
    counts = graded.groupBy(*by, "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    held = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
    histogram = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS)), lambda i: F.coalesce(held[i], F.lit(0)))
    histograms = counts.groupBy(*by, "metric").agg(histogram.alias("histogram"))
    numbers = known.where(~F.col("metric").isin([m for m in names if is_histogram(m)])).groupBy(*by, "metric").agg(
        F.max_by("value", F.struct("ts", "sample_id")).alias("value"), F.avg("value").alias("mean"), F.count("*").alias("count")
    )
    both = numbers.unionByName(histograms, allowMissingColumns=True)

    def shown(name: str) -> Column:
        what = F.col("histogram") if is_histogram(name) else F.struct("value", "mean", "count") if is_latency(name) else F.col("value")
        return F.any_value(F.when(F.col("metric") == name, what), True).alias(name)

    return both.groupBy(*by).agg(F.to_json(F.struct(*map(shown, names)), {"ignoreNullFields": "false"}).alias("document"))


def read_metric_documents(documents: DataFrame, by: Sequence[str] = ("cf",)) -> DataFrame:
    """A row per table and metric of its document: the keys, metric, kind (number, text, latency, histogram
    or none), number, text, mean, and the percentiles of a histogram as the offset of their bucket. A
    document that can't be parsed gives one row of kind *unreadable*."""
    given = documents.select(*by, F.try_parse_json("document").alias("_v"))
    each = given.lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    kind = F.schema_of_variant("value")
    rows = each.select(
        *by, F.col("key").alias("metric"), _kind(kind).alias("kind"), F.try_variant_get("value", "$", "double").alias("_number"),
        F.try_variant_get("value", "$", "string").alias("_text"), F.try_variant_get("value", "$.value", "double").alias("_value"),
        F.try_variant_get("value", "$.mean", "double").alias("mean"), F.try_variant_get("value", "$", "array<bigint>").alias("_buckets"),
    )
    of = F.col("kind")
    read = rows.select(
        *by, "metric", "kind",
        F.when(of == "number", F.col("_number")).when(of == "latency", F.col("_value")).alias("number"),
        F.when(of == "text", F.col("_text")).alias("text"), "mean",
        *[F.when(of == "histogram", percentile("_buckets", share)).alias(name) for name, share in PERCENTILES.items()],
    )
    broken = given.where(F.col("_v").isNull()).select(*by, F.lit("unreadable").alias("kind"))
    return read.unionByName(broken, allowMissingColumns=True)


def _kind(schema: Column) -> Column:
    return (
        F.when(schema.startswith("OBJECT"), "latency").when(schema.startswith("ARRAY"), "histogram").when(schema == "STRING", "text")
        .when(schema == "VOID", "none").otherwise("number")
    )


def percentile(buckets: str, share: float) -> Column:
    """The offset of the bucket in which a share of a histogram's counts is reached; null for an empty one.
    Values above all offsets are given as the last of them."""
    counts = F.col(buckets)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n)
    upto = F.transform(F.sequence(F.lit(1), F.size(counts)), lambda i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, n: a + n))
    below = F.size(F.filter(upto, lambda n: n < F.ceil(total * F.lit(share))))
    offsets = F.array(*map(F.lit, bucket_offsets()))
    return F.when(total > 0, F.get(offsets, F.least(below, F.lit(BUCKETS - 1))))


def node_status(nodes: DataFrame, keyspaces: DataFrame, ages: DataFrame, as_of: str) -> DataFrame:
    """The whole status record of every node: host_id and ``status``, a document.

    ``nodes`` has cluster, dc, rack, host_id, live, heap_used_bytes, heap_max_bytes and, where they are known,
    partitioner, schema_version, uptime, current_generation_number, load_string and operations_mode;
    ``keyspaces`` cluster and keyspace; ``ages`` is the result of ``backup_age_minutes``. Lists of nodes are
    those of the cluster, which every record repeats: they are written as text once for each cluster, and
    go into the records as the last step, so no shuffle carries them.
    """
    optional = ["partitioner", "schema_version", "uptime", "current_generation_number", "load_string", "operations_mode"]
    present = heap_usage(nodes).withColumns({c: F.lit(None).cast("string") for c in optional if c not in nodes.columns})

    def hosts(live: bool) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("live") == F.lit(live), F.col("host_id"))))

    addresses = F.map_from_entries(F.sort_array(F.collect_list(F.struct("host_id", F.concat_ws("/", "dc", "rack")))))
    clusters = nodes.groupBy("cluster").agg(hosts(True).alias("live_nodes"), hosts(False).alias("unreachable_nodes"), addresses.alias("host_id_map"))
    spaces = keyspaces.groupBy("cluster").agg(F.sort_array(F.collect_set("keyspace")).alias("keyspaces"))
    lists = clusters.join(spaces, "cluster", "left").select("cluster", _fields("host_id_map", "keyspaces").alias("_names"), _fields("live_nodes", "unreachable_nodes").alias("_nodes"))
    backups = [f"last_{kind}_backup{part}" for kind in ("snap", "sst", "cl") for part in ("", "_filecount", "_age_mins")]
    known = present.join(ages.select("host_id", *backups), "host_id", "left")
    unknown = {b: F.coalesce(b, F.lit("(null)") if b.endswith("backup") else F.lit(-1).cast("bigint")) for b in backups}
    now = snapshot_name(F.lit(as_of).cast("timestamp")).alias("datetime_now")
    place, last = _fields("cluster", "rack", "dc", "host_id"), _fields(now, *[c.alias(n) for n, c in unknown.items()])
    own = known.select(
        "cluster", "host_id", F.concat(F.lit("{"), place).alias("_place"), _fields(*optional, "heap_usage", "heap_usage_perc").alias("_state"),
        F.concat(last, F.lit("}")).alias("_backups"),
    )
    # The rows are few and small before they meet the lists (a row per cluster, which fits into one document)
    # and large after it: they are spread here, by a number that Spark doesn't lower for their size.
    context = nodes.sparkSession.sparkContext
    spread = own.repartition(max(TASKS_PER_CORE * context.defaultParallelism, 1), "host_id")
    whole = spread.join(F.broadcast(lists), "cluster")
    return whole.select("host_id", F.concat_ws(",", "_place", "_names", "_state", "_nodes", "_backups").alias("status"))


def read_node_status(documents: DataFrame, schema: str) -> DataFrame:
    """Records of ``node_status``, read back: host_id, the fields of ``schema`` (DDL), which has all ``LISTS`` and gives
    the number of their entries, own_address as the lists say it, and the number of all ``fields``. A document
    that can't be parsed is an error.

    Records of a cluster repeat its lists, so those of any one record are read first. Every document is compared
    with them byte by byte, and what is equal is not parsed again; a list that is not is parsed where it stands.
    A name with a list after it is found at no other place of a record: quotes within a text are escaped, and
    what host_id_map holds are texts.
    """
    strict = {"mode": "FAILFAST"}
    # Spark would parse a record in every task before it takes one, but for the repartition.
    one = documents.limit(1).repartition(1).select(
        F.from_json("status", ", ".join(f"{n} string" for n in LISTS), strict).alias("_text"), F.from_json("status", schema, strict).alias("_read")
    )

    def sought(name: str) -> Column:
        """The member of that name, if its list has entries: it is then no part of another one. Else an empty text, which replaces nothing."""
        text = F.col("_text")[name]
        return F.when(F.substring(text, 1, 2).isin('{"', '["'), F.concat(F.lit(f'"{name}":'), text)).otherwise("")

    known = one.select(F.col("_read.host_id_map").alias("_map"), *[c for n in LISTS for c in (sought(n).alias(f"_text_{n}"), F.size(F.col("_read")[n]).alias(f"_size_{n}"))])
    # The address is looked up here, so that no row carries the map any further.
    rest = documents.crossJoin(F.broadcast(known)).withColumns({"_rest": F.col("status"), "_address": F.col("_map")[F.col("host_id")]}).drop("_map")
    for n in LISTS:
        rest = rest.withColumn("_cut", F.replace("_rest", f"_text_{n}", F.lit(f'"{n}":null')))
        rest = rest.withColumn(f"_same_{n}", F.octet_length("_cut") < F.octet_length("_rest")).withColumn("_rest", F.col("_cut"))
    read = rest.withColumns({"_read": F.from_json("_rest", schema, strict), "_names": F.json_object_keys("_rest")})

    def field(name: str) -> Column:
        if name not in LISTS:
            return F.col("_read")[name].alias(name)
        return F.when(F.col(f"_same_{name}"), F.col(f"_size_{name}")).otherwise(F.size(F.col("_read")[name])).cast("bigint").alias(name)

    address = F.when(F.col("_same_host_id_map"), F.col("_address")).otherwise(F.col("_read")["host_id_map"][F.col("host_id")])
    names = one.schema["_read"].dataType.names
    return read.select("host_id", *map(field, names), address.alias("own_address"), F.size("_names").cast("bigint").alias("fields"))


def _fields(*columns: Column | str) -> Column:
    """The fields of a JSON object, without its braces."""
    return F.regexp_extract(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", 1)
