"""State, metrics, node status and threshold checks."""

from pyspark.sql import functions as F

from strongbox.functions.keys import split_state_name as split_names
from strongbox.functions.status import (
    backup_age_minutes as ages_of,
    heap_usage as add_heap_usage,
    metric_from_json as metric,
    parse_status_json,
    status_json as to_status_json,
)
from strongbox.operators import checks, metrics, state
from strongbox.operators.validate import expand_keyspaces
from strongbox.queries.registry import query, table, view

AS_OF = "2024-02-01 00:00:00"

LATEST = """
with latest as (select name, seq, value, date_modified from
  (select *, row_number() over (partition by name order by date_modified desc, seq desc) as rn from v_state) where rn = 1)
"""


@query("latest_state", LATEST + "select * from latest", ["v_state"])
def latest_state(spark, sf_dir):
    return state.latest_state(view(spark, sf_dir, "v_state"))


@query("upsert_state", LATEST + "select * from latest", ["v_state"])
def upsert_state(spark, sf_dir):
    writes = view(spark, sf_dir, "v_state")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    known = state.latest_state(writes.where(F.col("date_modified") < half))
    return state.upsert_state(known, writes.where(F.col("date_modified") >= half))


@query("point_lookup", LATEST + "select * from latest where name = 'click/7'", ["v_state"])
def point_lookup(spark, sf_dir):
    return state.point_lookup(view(spark, sf_dir, "v_state"), "click/7")


@query(
    "split_state_name",
    """select host_id, seq, name, value, split_part(value, '/', 1) as snapshot,
      case when name like 'last_snapshot%' then split_part(value, '/', 1) else nullif(split_part(value, '/', 2), '') end as backup_time
    from v_service_state""",
    ["v_service_state"],
)
def split_state_name(spark, sf_dir):
    return split_names(view(spark, sf_dir, "v_service_state").select("host_id", "seq", "name", "value"))


AGES = f"""
with last_writes as (select host_id, name, value from
    (select *, row_number() over (partition by host_id, name order by date_modified desc, seq desc) as rn from v_service_state) where rn = 1),
  wide as (select host_id, max(value) filter (where name = 'last_snapshot_name') as snap, max(value) filter (where name = 'last_snapshot_status') as snap_status,
    max(value) filter (where name = 'last_snapshot_filecount') as snap_files, max(value) filter (where name = 'last_sst_name') as sst,
    max(value) filter (where name = 'last_sst_filecount') as sst_files, max(value) filter (where name = 'last_cl_name') as cl,
    max(value) filter (where name = 'last_cl_filecount') as cl_files from last_writes group by host_id),
  timed as (select *, case when snap_status = 'complete' then date_sub('minute', try_strptime(snap, '%Y-%m-%d-%H:%M:%S'), timestamp '{AS_OF}') end as snap_age,
    date_sub('minute', try_strptime(split_part(sst, '/', 2), '%Y-%m-%d-%H:%M:%S'), timestamp '{AS_OF}') as sst_age,
    date_sub('minute', try_strptime(split_part(cl, '/', 2), '%Y-%m-%d-%H:%M:%S'), timestamp '{AS_OF}') as cl_age from wide),
  ages as (select host_id,
    case when snap_age is null then '(null)' else snap || '/' || coalesce(snap_status, '') end as last_snap_backup,
    case when snap_age is null then -1 else coalesce(cast(snap_files as bigint), -1) end as last_snap_backup_filecount, coalesce(snap_age, -1) as last_snap_backup_age_mins,
    case when sst_age is null then '(null)' else sst end as last_sst_backup,
    case when sst_age is null then -1 else coalesce(cast(sst_files as bigint), -1) end as last_sst_backup_filecount, coalesce(sst_age, -1) as last_sst_backup_age_mins,
    case when cl_age is null then '(null)' else cl end as last_cl_backup,
    case when cl_age is null then -1 else coalesce(cast(cl_files as bigint), -1) end as last_cl_backup_filecount, coalesce(cl_age, -1) as last_cl_backup_age_mins
    from timed)
"""


def ages(spark, sf_dir):
    last = state.latest_state(view(spark, sf_dir, "v_service_state"), ["host_id", "name"])
    return ages_of(last, AS_OF)


@query("backup_age_minutes", AGES + "select * from ages", ["v_service_state"])
def backup_age_minutes(spark, sf_dir):
    return ages(spark, sf_dir)


def _age_check(kind, warn, crit):
    column = f"last_{kind}_backup_age_mins"
    return AGES + f"""select host_id, {column}, case when {column} < 0 or {column} >= {crit} then 'CRITICAL' when {column} >= {warn} then 'WARNING' else 'OK' end as state,
      cast(case when {column} < 0 or {column} >= {crit} then 2 when {column} >= {warn} then 1 else 0 end as bigint) as code,
      case when {column} < 0 or {column} >= {crit} then 'CRITICAL: {column}: ' || {column} || '/{crit}'
        when {column} >= {warn} then 'WARNING: {column}: ' || {column} || '/{warn}' else 'OK: {column}: ' || {column} || '/{warn}' end as message from ages"""


def _checked_ages(spark, sf_dir, check, kind, warn, crit):
    return check(ages(spark, sf_dir), warn, crit).select("host_id", f"last_{kind}_backup_age_mins", "state", "code", "message")


@query("check_sst_backup_age", _age_check("sst", 3000, 6000), ["v_service_state"])
def check_sst_backup_age(spark, sf_dir):
    return _checked_ages(spark, sf_dir, checks.check_sst_backup_age, "sst", 3000, 6000)


@query("check_snap_backup_age", _age_check("snap", 3000, 6000), ["v_service_state"])
def check_snap_backup_age(spark, sf_dir):
    return _checked_ages(spark, sf_dir, checks.check_snap_backup_age, "snap", 3000, 6000)


@query("check_cl_backup_age", _age_check("cl", 2000, 4000), ["v_service_state"])
def check_cl_backup_age(spark, sf_dir):
    return _checked_ages(spark, sf_dir, checks.check_cl_backup_age, "cl", 2000, 4000)


HEAP = """
with heap as (select *, heap_used_bytes / 1048576 as heap_used_mb, heap_max_bytes / 1048576 as heap_max_mb,
  concat(heap_used_bytes * 100 // 1048576 // 100, '.', lpad(cast(heap_used_bytes * 100 // 1048576 % 100 as varchar), 2, '0'), '/',
    heap_max_bytes * 100 // 1048576 // 100, '.', lpad(cast(heap_max_bytes * 100 // 1048576 % 100 as varchar), 2, '0')) as heap_usage,
  heap_used_bytes / nullif(heap_max_bytes, 0) * 100 as heap_usage_perc from v_nodes)
"""


@query(
    "heap_usage",
    HEAP + "select host_id, round(heap_used_mb, 6) as heap_used_mb, round(heap_max_mb, 6) as heap_max_mb, heap_usage, round(heap_usage_perc, 6) as heap_usage_perc from heap",
    ["v_nodes"],
)
def heap_usage(spark, sf_dir):
    usage = add_heap_usage(view(spark, sf_dir, "v_nodes"))
    rounded = [F.round(c, 6).alias(c) for c in ("heap_used_mb", "heap_max_mb", "heap_usage_perc")]
    return usage.select("host_id", "heap_usage", *rounded)


@query(
    "status_json",
    HEAP + "select host_id, rack, dc, live, heap_usage, round(heap_usage_perc, 6) as heap_usage_perc from heap",
    ["v_nodes"],
)
def status_json(spark, sf_dir):
    documents = to_status_json(add_heap_usage(view(spark, sf_dir, "v_nodes")))
    return parse_status_json(documents).withColumn("heap_usage_perc", F.round("heap_usage_perc", 6))


@query(
    "check_heap_usage",
    HEAP + """, whole as (select host_id, cast(trunc(heap_usage_perc) as bigint) as v from heap)
    select host_id, v as heap_percent, case when v >= 80 then 'CRITICAL' when v >= 50 then 'WARNING' else 'OK' end as state,
      cast(case when v >= 80 then 2 when v >= 50 then 1 else 0 end as bigint) as code,
      case when v >= 80 then 'CRITICAL: heap_usage_perc: ' || v || '/80' when v >= 50 then 'WARNING: heap_usage_perc: ' || v || '/50'
        else 'OK: heap_usage_perc: ' || v || '/50' end as message from whole""",
    ["v_nodes"],
)
def check_heap_usage(spark, sf_dir):
    checked = checks.check_heap_usage(add_heap_usage(view(spark, sf_dir, "v_nodes")), 50, 80)
    return checked.select("host_id", F.col("heap_usage_perc").cast("bigint").alias("heap_percent"), "state", "code", "message")


FLEET = AGES + """, by_dc as (select dc, count(*) filter (where live) as live_nodes, count(*) filter (where not live) as unreachable_nodes,
    round(sum(heap_used_bytes) / sum(heap_max_bytes) * 100, 6) as heap_usage_perc,
    max(coalesce(last_snap_backup_age_mins, -1)) as oldest_snap_backup_age_mins, count(*) filter (where coalesce(last_snap_backup_age_mins, -1) < 0) as hosts_without_snap_backup,
    max(coalesce(last_sst_backup_age_mins, -1)) as oldest_sst_backup_age_mins, count(*) filter (where coalesce(last_sst_backup_age_mins, -1) < 0) as hosts_without_sst_backup,
    max(coalesce(last_cl_backup_age_mins, -1)) as oldest_cl_backup_age_mins, count(*) filter (where coalesce(last_cl_backup_age_mins, -1) < 0) as hosts_without_cl_backup
  from v_nodes left join ages using (host_id) group by dc)
"""


def fleet(spark, sf_dir):
    return metrics.cluster_status(view(spark, sf_dir, "v_nodes"), ages(spark, sf_dir))


@query("cluster_status", FLEET + "select * from by_dc", ["v_nodes", "v_service_state"])
def cluster_status(spark, sf_dir):
    return fleet(spark, sf_dir).withColumn("heap_usage_perc", F.round("heap_usage_perc", 6))


@query(
    "check_live_nodes",
    FLEET + """, thresholds as (select r_name as dc, cast(12 + r_regionkey as bigint) as warn, cast(8 + r_regionkey as bigint) as crit from region where r_regionkey <> 4)
    select dc, live_nodes, case when crit is null then 'UNKNOWN' when live_nodes <= crit then 'CRITICAL' when live_nodes <= warn then 'WARNING' else 'OK' end as state,
      cast(case when crit is null then 3 when live_nodes <= crit then 2 when live_nodes <= warn then 1 else 0 end as bigint) as code,
      case when crit is null then 'UNKNOWN: live nodes count' when live_nodes <= crit then 'CRITICAL: live nodes count: ' || live_nodes || '/' || crit
        when live_nodes <= warn then 'WARNING: live nodes count: ' || live_nodes || '/' || warn
        else 'OK: live nodes count: ' || live_nodes || '/' || warn end as message from by_dc left join thresholds using (dc)""",
    ["v_nodes", "v_service_state"],
)
def check_live_nodes(spark, sf_dir):
    regions = table(spark, sf_dir, "region").where("r_regionkey <> 4")  # one without thresholds
    thresholds = regions.select(
        F.col("r_name").alias("dc"), (F.col("r_regionkey") + 12).cast("bigint").alias("warn"), (F.col("r_regionkey") + 8).cast("bigint").alias("crit")
    )
    readings = checks.with_thresholds(fleet(spark, sf_dir), thresholds, "dc")
    return checks.check_live_nodes(readings, "warn", "crit").select("dc", "live_nodes", "state", "code", "message")


@query(
    "cluster_metadata",
    """with entries as (select dc, 'hosts' as kind, host_id || '=' || rack as entry from v_nodes union select dc, 'tokens', token from v_nodes
      union select r_name, 'keyspaces', keyspace from region, v_keyspaces)
    select dc, kind, cast(0 as bigint) as part, count(*) as n_entries, '["' || string_agg(entry, '","' order by entry) || '"]' as entries from entries group by dc, kind""",
    ["v_nodes", "v_keyspaces"],
)
def cluster_metadata(spark, sf_dir):
    wanted = table(spark, sf_dir, "region").select(F.col("r_name").alias("dc"), F.lit("*").alias("keyspace"))
    return metrics.cluster_metadata(view(spark, sf_dir, "v_nodes"), expand_keyspaces(wanted, view(spark, sf_dir, "v_keyspaces")))


@query("metric_from_json", "select event_id, cast(props->>'$.k' as double) as reading from events")
def metric_from_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", metric("props", "k").alias("reading"))


REPORTED = ["ReadLatency", "WriteLatency", "LiveSSTableCount", "PendingFlushes", "MeanRowSize"]
WIDE = "with wide as (select cf, " + ", ".join(
    f"arg_max(value, (ts, sample_id)) filter (where metric = '{m}') as \"{m}\"" for m in REPORTED
) + """, round(avg(value) filter (where metric = 'ReadLatency'), 6) as "ReadLatency_mean", round(avg(value) filter (where metric = 'WriteLatency'), 6) as "WriteLatency_mean"
  from v_samples group by cf)
"""


def wide_metrics(spark, sf_dir):
    return metrics.column_family_metrics(view(spark, sf_dir, "v_samples"))


@query("column_family_metrics", WIDE + "select * from wide", ["v_samples"])
def column_family_metrics(spark, sf_dir):
    means = [F.round(f"{m}_mean", 6).alias(f"{m}_mean") for m in ("ReadLatency", "WriteLatency")]
    return wide_metrics(spark, sf_dir).select("cf", *REPORTED, *means)


def _latency_check(kind, column, warn, crit):
    return WIDE + f""", t as (select cf, case when cf = 'cf-0' then '' else 'sales' end as keyspace, "{column}" as v from wide)
    select keyspace, cf, case when keyspace = '' or v is null then 'UNKNOWN' when v >= {crit} then 'CRITICAL' when v >= {warn} then 'WARNING' else 'OK' end as state,
      cast(case when keyspace = '' or v is null then 3 when v >= {crit} then 2 when v >= {warn} then 1 else 0 end as bigint) as code,
      case when keyspace = '' or v is null then 'UNKNOWN: {kind}' when v >= {crit} then 'CRITICAL: {kind}: ' || cast(trunc(v) as bigint) || '/{crit}'
        when v >= {warn} then 'WARNING: {kind}: ' || cast(trunc(v) as bigint) || '/{warn}' else 'OK: {kind}: ' || cast(trunc(v) as bigint) || '/{warn}' end as message
    from t"""


def _checked_latency(spark, sf_dir, check, warn, crit):
    keyspace = F.when(F.col("cf") == "cf-0", "").otherwise("sales")
    tables = wide_metrics(spark, sf_dir).withColumn("keyspace", keyspace)
    return check(tables, warn, crit).select("keyspace", "cf", "state", "code", "message")


@query("check_write_latency", _latency_check("write_latency", "WriteLatency_mean", 48, 52), ["v_samples"])
def check_write_latency(spark, sf_dir):
    return _checked_latency(spark, sf_dir, checks.check_write_latency, 48, 52)


@query("check_read_latency", _latency_check("read_latency", "ReadLatency_mean", 48, 52), ["v_samples"])
def check_read_latency(spark, sf_dir):
    return _checked_latency(spark, sf_dir, checks.check_read_latency, 48, 52)


@query(
    "event_log",
    """select event_id, event_type as title, props as text, ts as date,
      case event_type when 'error' then 'error' when 'purchase' then 'success' else 'info' end as alert_type, 'user:' || user_id as tags from events""",
)
def event_log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "success").otherwise("info")
    return metrics.event_log(
        events.select("event_id", F.col("event_type").alias("title"), F.col("props").alias("text"), "ts", level.alias("level"),
                      F.concat(F.lit("user:"), F.col("user_id")).alias("tags"))
    )
