"""Documents of mixed values, read back; counters without state, and progress in any order."""

from pyspark.sql import functions as F

from strongbox.operators import documents
from strongbox.queries.operations import INTERVAL_MS, THROTTLED
from strongbox.queries.registry import query, stream, stream_view, view
from strongbox.queries.status import AGES, AS_OF, HEAP, ages
from strongbox.schemas import TABLE_METRICS
from strongbox.streaming import counters, reorder
from strongbox.workspace import new_folder

# The row sizes are given as a histogram, the latencies with their mean, the others as numbers.
GRADED, NAMED = "EstimatedRowSizeHistogram", ["ReadLatency", "WriteLatency", "LiveSSTableCount", "PendingFlushes"]


def _samples(spark, sf_dir):
    name = F.when(F.col("metric") == "MeanRowSize", GRADED).otherwise(F.col("metric"))
    return view(spark, sf_dir, "v_samples").withColumn("metric", name)


@query(
    "metric_documents",
    f"""with offsets as (select 1 as i, cast(1 as bigint) as o
      union all select i + 1, greatest(o + 1, (o * 12 + 5) // 10) from offsets where i < {documents.BUCKETS}),
    names as (select cf, unnest([{", ".join(f"'{m}'" for m in TABLE_METRICS)}]) as metric from (select distinct cf from v_samples)),
    plain as (select cf, metric, arg_max(value, (ts, sample_id)) as number, round(avg(value), 6) as mean from v_samples group by all),
    sorted as (select cf, list_sort(list(value)) as vs, count(*) as n from v_samples where metric = 'MeanRowSize' group by cf),
    graded as (select cf, vs[cast(ceil(n * 0.5) as bigint)] as v50, vs[cast(ceil(n * 0.95) as bigint)] as v95, vs[cast(ceil(n * 0.99) as bigint)] as v99 from sorted),
    placed as (select cf, (select min(o) from offsets where o >= v50) as p50, (select min(o) from offsets where o >= v95) as p95,
      (select min(o) from offsets where o >= v99) as p99 from graded)
    select n.cf, n.metric, case when n.metric = '{GRADED}' then 'histogram' when p.number is null then 'none' when n.metric like '%Latency' then 'latency' else 'number' end as kind,
      p.number, case when n.metric like '%Latency' then p.mean end as mean,
      case when n.metric = '{GRADED}' then p50 end as p50, case when n.metric = '{GRADED}' then p95 end as p95, case when n.metric = '{GRADED}' then p99 end as p99
    from names n left join (select * from plain where metric in ({", ".join(f"'{m}'" for m in NAMED)})) p on p.cf = n.cf and p.metric = n.metric
      left join placed g on g.cf = n.cf""",
    ["v_samples"],
    recursive=True,
)
def metric_documents(spark, sf_dir):
    """All metrics of every table, written as documents and read back."""
    read = documents.read_metric_documents(documents.metric_documents(_samples(spark, sf_dir)))
    return read.withColumns({"mean": F.round("mean", 6), **{p: F.col(p).cast("bigint") for p in documents.PERCENTILES}}).drop("text")


#: What is read of a status record: one typed pass over the text takes less than half of the time that a
#: variant takes.
STATUS = """cluster string, rack string, dc string, host_id_map map<string,string>, keyspaces array<string>, heap_usage string, heap_usage_perc double,
    live_nodes array<string>, unreachable_nodes array<string>, datetime_now string, last_snap_backup string, last_sst_backup_filecount bigint, last_cl_backup_age_mins bigint"""


@query(
    "node_status",
    AGES + HEAP.replace("with heap", ", heap", 1) + f""", fleet as (select count(*) filter (where live) as up, count(*) filter (where not live) as down from v_nodes)
    select h.host_id, 'main' as cluster, rack, dc, heap_usage, round(heap_usage_perc, 6) as heap_usage_perc, up as live_nodes, down as unreachable_nodes,
      (select count(*) from v_keyspaces) as keyspaces, dc || '/' || rack as own_address, '{AS_OF.replace(" ", "-")}' as datetime_now, cast(26 as bigint) as fields,
      coalesce(last_snap_backup, '(null)') as last_snap_backup, coalesce(last_sst_backup_filecount, -1) as last_sst_backup_filecount, coalesce(last_cl_backup_age_mins, -1) as last_cl_backup_age_mins
    from heap h left join ages a on a.host_id = h.host_id, fleet""",
    ["v_nodes", "v_service_state", "v_keyspaces"],
)
def node_status(spark, sf_dir):
    """The whole status record of every node, read back from its document."""
    nodes = view(spark, sf_dir, "v_nodes").withColumn("cluster", F.lit("main"))
    spaces = view(spark, sf_dir, "v_keyspaces").withColumn("cluster", F.lit("main"))
    made = documents.node_status(nodes, spaces, ages(spark, sf_dir), AS_OF)
    read = documents.read_node_status(made, STATUS)
    return read.select(
        "host_id", "cluster", "rack", "dc", "heap_usage", "datetime_now", "last_snap_backup", F.round("heap_usage_perc", 6).alias("heap_usage_perc"),
        "live_nodes", "unreachable_nodes", "keyspaces", "own_address", "last_sst_backup_filecount", "last_cl_backup_age_mins", "fields",
    )


@query(
    "windowed_counters",
    """select date_trunc('hour', ts) as window_start, event_type as name, count(*) as n, round(sum(value), 6) as total, max(value) as largest
    from events group by all""",
)
def windowed_counters(spark, sf_dir):
    """Counters from sums per micro-batch, after a compaction that found one batch and left it."""
    folder = new_folder(spark, "counters")
    points = stream(spark, sf_dir, "events").select("ts", F.col("event_type").alias("name"), "value")
    counters.windowed_counters(points, folder, lateness="1 hour").awaitTermination()
    counters.compact_counters(spark, folder)
    found = counters.read_counters(spark, folder)
    return found.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 6)})


@query("reordered_progress_stream", THROTTLED, ["v_transfers"], recursive=True)
def reordered_progress_stream(spark, sf_dir):
    folder, transfers = new_folder(spark, "lines"), stream_view(spark, sf_dir, "v_transfers")
    reorder.reordered_progress_stream(transfers, folder, "0 seconds", INTERVAL_MS).awaitTermination()
    return reorder.progress_lines(spark, folder).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
