"""What the operators run on, derived from the given tables. The SQL is the same for both engines."""

VIEWS = {
    # Listing of backup objects. P is a change log, which has no keyspace and table; some keys
    # end after the host, as after an upload that broke off.
    "v_objects": """
select o_orderkey as object_id,
  case when o_orderkey % 97 = 0
       then concat_ws('/', 'backups', 'main', concat('host-', cast(o_custkey % 16 as string)))
       else concat_ws('/', 'backups', 'main', concat('host-', cast(o_custkey % 16 as string)),
              concat(cast(cast(date_trunc('month', o_orderdate) as date) as string), '-00:00:00'),
              case o_orderstatus when 'F' then 'SNAP' when 'O' then 'SST' else 'CL' end,
              case when o_orderstatus in ('F', 'O') then 'sales' end,
              case when o_orderstatus in ('F', 'O') then o_orderpriority end,
              concat(cast(o_orderkey as string), '.dat')) end as object_key,
  cast(floor(o_totalprice * 100) as bigint) as length,
  o_orderdate as modified
from {orders}""",
    # Files on the data disks of a host.
    "v_files": """
select concat(
    case when o_orderstatus = 'P' then '/commitlog'
         else concat('/data/d', cast(o_custkey % 2 as string),
                     case when o_custkey % 7 = 0 then '/system/' else '/sales/' end,
                     case when o_custkey % 14 = 0 then 'peers' else o_orderpriority end,
                     case when o_orderstatus = 'F'
                          then concat('/snapshots/', cast(cast(date_trunc('month', o_orderdate) as date) as string), '-00:00:00')
                          else '/backups' end) end,
    '/', cast(o_orderkey as string), '.dat') as path,
  cast(floor(o_totalprice * 100) as bigint) as length,
  o_orderdate as modified
from {orders}""",
    # Operations with start and duration. Those that take too long never finish.
    "v_ops": """
select event_id as op_id, concat('host-', cast(user_id % 16 as string)) as host_id, ts as started,
  cast(floor(value * 60) as bigint) as secs,
  case event_type when 'view' then 'SNAP' when 'click' then 'SST' when 'purchase' then 'CL'
                  when 'signup' then 'RESTORE' else 'NONE' end as op_type,
  value <= 150 as finishes
from {events}""",
    # Key-value writes, the last one wins.
    "v_state": """
select event_id as seq, concat(event_type, '/', cast(user_id as string)) as name,
  cast(event_id as string) as value, ts as date_modified
from {events}""",
    # The state that backups write on every host; errors leave an unreadable change-log time.
    "v_service_state": """
select concat('host-', cast(user_id as string)) as host_id, event_id as seq,
  case event_type when 'view' then 'last_snapshot_name' when 'click' then 'last_sst_name'
       when 'signup' then 'last_snapshot_status' else 'last_cl_name' end as name,
  case event_type
       when 'view' then concat(substr(cast(ts as string), 1, 10), '-', substr(cast(ts as string), 12, 8))
       when 'signup' then 'complete'
       when 'error' then 'junk'
       else concat(substr(cast(ts as string), 1, 10), '-00:00:00/', substr(cast(ts as string), 1, 10), '-', substr(cast(ts as string), 12, 8)) end as value,
  ts as date_modified
from {events}
union all
select concat('host-', cast(user_id as string)) as host_id, event_id as seq,
  case event_type when 'view' then 'last_snapshot_filecount' when 'click' then 'last_sst_filecount'
       else 'last_cl_filecount' end as name,
  cast(event_id % 1000 as string) as value, ts as date_modified
from {events} where event_type in ('view', 'click', 'purchase')""",
    # Metric samples per table.
    "v_samples": """
select event_id as sample_id, concat('cf-', cast(user_id % 10 as string)) as cf, ts,
  case event_type when 'view' then 'ReadLatency' when 'click' then 'WriteLatency'
                  when 'purchase' then 'LiveSSTableCount' when 'signup' then 'PendingFlushes'
                  else 'MeanRowSize' end as metric, value
from {events}""",
    # Progress events per file.
    "v_transfers": """
select user_id as file_id, event_id as seq, ts,
  case event_type when 'signup' then 'STARTED' when 'purchase' then 'PART'
                  when 'error' then 'COMPLETED' else 'BYTES' end as kind,
  cast(floor(value * 1048576) as bigint) as bytes
from {events}""",
    # Upload attempts; some are logged twice.
    "v_attempts": """
select l_orderkey as upload_id, l_linenumber as attempt_no, l_returnflag <> 'R' as ok from {lineitem}""",
    # Readings of every node.
    "v_nodes": """
select concat('host-', cast(s_suppkey as string)) as host_id, n_name as rack, r_name as dc,
  cast(floor(abs(s_acctbal) * 1048576) as bigint) as heap_used_bytes,
  cast(10000 as bigint) * 1048576 as heap_max_bytes,
  s_acctbal >= 0 as live,
  substr(md5(cast(s_suppkey as string)), 1, 8) as token
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    # Keyspaces of the cluster.
    "v_keyspaces": "select distinct lower(c_mktsegment) as keyspace from {customer}",
    # Restore and backup requests.
    "v_requests": """
select o_orderkey as request_id,
  case when o_orderpriority = '1-URGENT' then '*' else lower(o_orderpriority) end as keyspace,
  case o_orderstatus when 'F' then concat('host-', cast(o_custkey % 16 as string)) when 'O' then '  ' end as host_id
from {orders}""",
}
