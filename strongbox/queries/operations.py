"""Operations, runs, attempts and transfers."""

from pyspark.sql import functions as F

from strongbox.functions.keys import snapshot_name as name_of
from strongbox.functions.status import bytes_to_mb as to_mb
from strongbox.operators import backups, metrics, runs, transfer
from strongbox.queries.registry import query, view

OPS = """
with ops as (select op_id, host_id, op_type, started, secs, case when finishes then started + to_seconds(secs) end as finished from v_ops)
"""
LOCKED = """
with ops as (select op_id, host_id, op_type, started, secs, started + to_seconds(secs) as ends,
  case when op_type in ('SNAP', 'RESTORE') then 'SNAP+RESTORE' else op_type end as lock_class from v_ops where op_type <> 'NONE')
"""


def operations(spark, sf_dir):
    ops = view(spark, sf_dir, "v_ops")
    end = F.timestamp_add("SECOND", F.col("secs"), F.col("started").cast("timestamp")).cast("timestamp_ntz")
    return ops.select("op_id", "host_id", "op_type", "started", "secs", F.when(F.col("finishes"), end).alias("finished"))


@query("snapshot_name", "select op_id, started, strftime(started, '%Y-%m-%d-%H:%M:%S') as snapshot from v_ops", ["v_ops"])
def snapshot_name(spark, sf_dir):
    return view(spark, sf_dir, "v_ops").select("op_id", "started", name_of("started").alias("snapshot"))


def _attach(spark, sf_dir, complete_only):
    ops = operations(spark, sf_dir)
    increments = ops.where(F.col("op_type").isin("SST", "CL")).select("op_id", "host_id", "op_type", "started")
    snapshots = ops.where(F.col("op_type") == "SNAP").select("host_id", name_of("started").alias("snapshot"), "started", "finished")
    return runs.attach_to_snapshot(increments, snapshots, complete_only)


ATTACHED = """, snaps as (select host_id, {at} as at, max(strftime(started, '%Y-%m-%d-%H:%M:%S')) as snapshot
    from ops where op_type = 'SNAP' and {at} is not null group by all),
    incs as (select op_id, host_id, op_type, started from ops where op_type in ('SST', 'CL'))
    select i.op_id, i.host_id, i.op_type, i.started, s.snapshot, s.snapshot is not null as accepted
    from incs i asof left join snaps s on i.host_id = s.host_id and i.started >= s.at"""


@query("attach_to_snapshot", OPS + ATTACHED.format(at="finished"), ["v_ops"])
def attach_to_snapshot(spark, sf_dir):
    return _attach(spark, sf_dir, True)


@query("attach_to_started_snapshot", OPS + ATTACHED.format(at="started"), ["v_ops"])
def attach_to_started_snapshot(spark, sf_dir):
    return _attach(spark, sf_dir, False)


@query(
    "conflicting_operations",
    LOCKED + """, met as (select b.op_id, b.host_id, b.lock_class, b.started, count(*) as n_running, max(a.ends) as blocked_until
      from ops a join ops b on a.host_id = b.host_id and a.lock_class = b.lock_class and a.secs > 0
        and (a.started < b.started or (a.started = b.started and a.op_id < b.op_id)) and a.ends > b.started group by all)
    select m.op_id, m.host_id, m.lock_class, m.started, m.n_running, max(a.op_id) as blocker_op_id,
      date_sub('second', m.started, m.blocked_until) as blocked_secs
    from met m join ops a on a.host_id = m.host_id and a.lock_class = m.lock_class and a.ends = m.blocked_until
      and (a.started < m.started or (a.started = m.started and a.op_id < m.op_id))
    group by all""",
    ["v_ops"],
)
def conflicting_operations(spark, sf_dir):
    return runs.conflicting_operations(view(spark, sf_dir, "v_ops"))


ADMITTED = LOCKED + """, numbered as (select *, row_number() over (partition by host_id, lock_class order by started, op_id) as rn from ops),
    walk as (select op_id, host_id, lock_class, rn, true as admitted, ends as busy from numbered where rn = 1
      union all select n.op_id, n.host_id, n.lock_class, n.rn, n.started >= w.busy, case when n.started >= w.busy then n.ends else w.busy end
      from walk w join numbered n on n.host_id = w.host_id and n.lock_class = w.lock_class and n.rn = w.rn + 1)
    select n.op_id, n.host_id, n.op_type, n.started, n.secs, n.lock_class, w.admitted from numbered n join walk w on w.op_id = n.op_id"""
DECIDED = ["op_id", "host_id", "op_type", "started", "secs", "lock_class", "admitted"]


@query("admit_exclusive", ADMITTED, ["v_ops"], recursive=True)
def admit_exclusive(spark, sf_dir):
    return runs.admit_exclusive(view(spark, sf_dir, "v_ops")).select(*DECIDED)


@query(
    "execution_times",
    """select op_type, host_id, count(*) as n, cast(sum(elapsed_ms) as bigint) as total_ms, min(elapsed_ms) as min_ms, max(elapsed_ms) as max_ms,
      round(avg(elapsed_ms), 6) as mean_ms, round(quantile_cont(elapsed_ms, 0.5), 6) as p50_ms,
      round(quantile_cont(elapsed_ms, 0.95), 6) as p95_ms, round(quantile_cont(elapsed_ms, 0.99), 6) as p99_ms
    from (select op_type, host_id, secs * 1000 as elapsed_ms from v_ops) group by all""",
    ["v_ops"],
)
def execution_times(spark, sf_dir):
    points = view(spark, sf_dir, "v_ops").withColumn("elapsed_ms", F.col("secs") * 1000)
    times = metrics.execution_times(points, ["op_type", "host_id"])
    return times.withColumns({c: F.round(c, 6) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")})


STATES = OPS + """, backups as (select * from ops where op_type in ('SNAP', 'SST', 'CL')),
    states as (select op_id, host_id, op_type, 'inprogress' as status, started as ts, cast(-1 as bigint) as files_count from backups
      union all select op_id, host_id, op_type, 'complete', finished, secs from backups where finished is not null)
"""


def _backup_operations(spark, sf_dir):
    ops = operations(spark, sf_dir).where(F.col("op_type").isin("SNAP", "SST", "CL"))
    return ops.select(
        "op_id", "host_id", F.col("op_type").alias("backup_type"), F.lit("sales").alias("keyspace"), F.lit("Tgz").alias("backup_format"),
        name_of("started").alias("snapshot"), "started", "finished", F.col("secs").alias("files_count"),
    )


@query(
    "write_backup_state",
    STATES + """select s.op_id, s.host_id, s.op_type as backup_type, s.status, s.ts as written, s.files_count,
      'backups/main/' || s.host_id || '/' || strftime(o.started, '%Y-%m-%d-%H:%M:%S') || '/META/sales/[global]/BackupState' || s.op_type || '.txt' as object_key,
      '{{"name":"' || strftime(o.started, '%Y-%m-%d-%H:%M:%S') || '","backupFormat":"tgz","status":"' || s.status || '","timestamp":"' || strftime(s.ts, '%Y-%m-%d-%H:%M:%S') || '"}}' as document
    from states s join ops o on o.op_id = s.op_id""".replace("{{", "{").replace("}}", "}"),
    ["v_ops"],
)
def write_backup_state(spark, sf_dir):
    states = backups.write_backup_state(_backup_operations(spark, sf_dir), "backups", "main")
    return states.select("op_id", "host_id", "backup_type", "status", "written", "files_count", "object_key", "document")


def _states(spark, sf_dir):
    states = backups.write_backup_state(_backup_operations(spark, sf_dir), "backups", "main")
    return states.select("op_id", "host_id", "backup_type", "status", F.col("written").alias("ts"), (F.col("op_id") * 2 + F.when(F.col("status") == "complete", 1).otherwise(0)).alias("seq"))


@query(
    "backup_runs",
    STATES + """select host_id, op_type as backup_type, op_id, min(ts) filter (where status = 'inprogress') as started,
      min(ts) filter (where status = 'complete') as finished, date_sub('second', min(ts) filter (where status = 'inprogress'), min(ts) filter (where status = 'complete')) as seconds,
      case when count(*) = 2 then 'complete' else 'incomplete' end as outcome from states group by all""",
    ["v_ops"],
)
def backup_runs(spark, sf_dir):
    return runs.backup_runs(_states(spark, sf_dir), ["host_id", "backup_type"], run="op_id")


@query(
    "backup_runs_in_order",
    STATES + """, numbered as (select *, op_id * 2 + case status when 'complete' then 1 else 0 end as seq from states),
    led as (select *, lead(status) over w as next_status, lead(ts) over w as next_ts from numbered
      window w as (partition by host_id, op_type order by ts, seq))
    select host_id, op_type as backup_type, seq, ts as started, case when next_status = 'complete' then next_ts end as finished,
      date_sub('second', ts, case when next_status = 'complete' then next_ts end) as seconds,
      case when next_status = 'complete' then 'complete' else 'incomplete' end as outcome
    from led where status = 'inprogress'""",
    ["v_ops"],
)
def backup_runs_in_order(spark, sf_dir):
    return runs.backup_runs(_states(spark, sf_dir), ["host_id", "backup_type"])


@query(
    "attempt_outcomes",
    """with a as (select upload_id, cast(min(attempt_no) filter (where ok and attempt_no <= 4) as bigint) as won_at,
      cast(max(attempt_no) filter (where attempt_no <= 4) as bigint) as seen from v_attempts group by upload_id)
    select upload_id, won_at, coalesce(won_at, seen, 0) as attempts_made, greatest(coalesce(won_at, seen, 0) - 1, 0) as retries,
      coalesce(won_at is null and seen >= 4, false) as exhausted,
      case when won_at is not null then 'uploaded' when seen >= 4 then 'failed' else 'unfinished' end as outcome from a""",
    ["v_attempts"],
)
def attempt_outcomes(spark, sf_dir):
    return runs.attempt_outcomes(view(spark, sf_dir, "v_attempts"))


@query("bytes_to_mb", "select file_id, seq, bytes, bytes // 1048576 as mb from v_transfers", ["v_transfers"])
def bytes_to_mb(spark, sf_dir):
    return to_mb(view(spark, sf_dir, "v_transfers").select("file_id", "seq", "bytes"))


MOVED = """
with moved as (select *, cast(sum(case when kind in ('BYTES', 'PART') then bytes else 0 end) over w as bigint) as bytes_done,
    max(kind = 'COMPLETED') over w as completed, min(ts) over w as first_ts
  from v_transfers window w as (partition by file_id order by ts, seq rows unbounded preceding))
"""


@query(
    "transfer_progress",
    MOVED + "select file_id, seq, ts, kind, bytes, bytes_done, completed, bytes_done // 1048576 as mb from moved",
    ["v_transfers"],
)
def transfer_progress(spark, sf_dir):
    return transfer.transfer_progress(view(spark, sf_dir, "v_transfers"))


INTERVAL_MS = 6 * 3600 * 1000
THROTTLED = MOVED + f""", numbered as (select *, row_number() over (partition by file_id order by ts, seq) as rn from moved where kind = 'BYTES'),
    walk as (select file_id, seq, rn, ts > first_ts + to_milliseconds({INTERVAL_MS}) as shown,
        case when ts > first_ts + to_milliseconds({INTERVAL_MS}) then ts else first_ts end as last_ts from numbered where rn = 1
      union all select n.file_id, n.seq, n.rn, n.ts > w.last_ts + to_milliseconds({INTERVAL_MS}),
        case when n.ts > w.last_ts + to_milliseconds({INTERVAL_MS}) then n.ts else w.last_ts end
      from walk w join numbered n on n.file_id = w.file_id and n.rn = w.rn + 1)
    select m.file_id, m.seq, m.ts, m.kind, m.bytes, m.bytes_done, m.bytes_done // 1048576 as mb
    from moved m left join walk w on w.file_id = m.file_id and w.seq = m.seq where m.kind <> 'BYTES' or w.shown"""


@query("throttle_progress", THROTTLED, ["v_transfers"], recursive=True)
def throttle_progress(spark, sf_dir):
    return transfer.throttle_progress(view(spark, sf_dir, "v_transfers"), INTERVAL_MS)
