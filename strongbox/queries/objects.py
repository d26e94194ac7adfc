"""Object keys, listings, manifests and validation."""

from pyspark.sql import functions as F

from strongbox.functions.keys import archive_id, build_object_key as add_object_key, parse_object_key as parse
from strongbox.functions.status import split_counter as split_into_increments
from strongbox.operators import backups, catalog, metrics, validate
from strongbox.queries.registry import query, view

PARSED = """
with split_keys as (select *, string_split(object_key, '/') as p from v_objects),
checked as (select *, len(p) in (6, 8) and p[len(p)] <> '' as valid from split_keys),
parsed as (
  select object_id, object_key, length, modified, cast(len(p) as bigint) as n_parts, valid,
    case when valid then p[2] end as cluster, case when valid then p[3] end as host_id,
    case when valid then p[4] end as snapshot, case when valid then p[5] end as backup_type,
    case when len(p) = 8 then p[6] end as keyspace, case when len(p) = 8 then p[7] end as "table",
    case when valid then p[len(p)] end as file_name
  from checked)
"""


def parsed(spark, sf_dir):
    return parse(view(spark, sf_dir, "v_objects"))


def valid(spark, sf_dir):
    return parsed(spark, sf_dir).where("valid")


@query("parse_object_key", PARSED + "select * from parsed", ["v_objects"])
def parse_object_key(spark, sf_dir):
    return parsed(spark, sf_dir)


@query("build_object_key", PARSED + "select object_id, object_key from parsed where valid", ["v_objects"])
def build_object_key(spark, sf_dir):
    parts = valid(spark, sf_dir).drop("object_key")
    return add_object_key(parts, "backups").select("object_id", "object_key")


@query(
    "archive_id",
    PARSED + """select object_id, substr(sha256(concat_ws(chr(1), host_id, snapshot, coalesce(keyspace, chr(2)), coalesce("table", chr(2)), file_name)), 1, 32) as archive_id
    from parsed where valid""",
    ["v_objects"],
)
def archive_ids(spark, sf_dir):
    return valid(spark, sf_dir).select(
        "object_id", archive_id("host_id", "snapshot", "keyspace", "table", "file_name").alias("archive_id")
    )


@query(
    "validate_object_keys",
    PARSED + """select object_id, object_key, case when not valid then 'parts' when lower(host_id) <> 'host-3' then 'host'
      when lower(backup_type) <> 'snap' then 'type' end as reason from parsed""",
    ["v_objects"],
)
def validate_object_keys(spark, sf_dir):
    checked = validate.validate_object_keys(view(spark, sf_dir, "v_objects"), "HOST-3", "snap")
    return checked.select("object_id", "object_key", "reason")


@query(
    "check_restore_scope",
    PARSED + """select object_id, keyspace, host_id, case when keyspace is distinct from 'sales' then 'keyspace' else 'host' end as reason
    from parsed where keyspace is distinct from 'sales' or host_id is distinct from 'host-3'""",
    ["v_objects"],
)
def check_restore_scope(spark, sf_dir):
    out = validate.check_restore_scope(parsed(spark, sf_dir), "sales", "host-3")
    return out.select("object_id", "keyspace", "host_id", "reason")


SNAPSHOT_DIRS = r"'^(.*/([^/]+)/([^/]+)/snapshots/([^/]+))/.+$'"
INCREMENT_DIRS = r"'^(.*/([^/]+)/([^/]+)/backups)/.+$'"


@query(
    "discover_snapshot_dirs",
    f"""select regexp_extract(path, {SNAPSHOT_DIRS}, 2) as keyspace, regexp_extract(path, {SNAPSHOT_DIRS}, 3) as "table",
      regexp_extract(path, {SNAPSHOT_DIRS}, 4) as snapshot, regexp_extract(path, {SNAPSHOT_DIRS}, 1) as directory,
      count(*) as n_files, cast(sum(length) as bigint) as n_bytes
    from v_files where path like '%/snapshots/%' group by all""",
    ["v_files"],
)
def discover_snapshot_dirs(spark, sf_dir):
    return catalog.discover_snapshot_dirs(view(spark, sf_dir, "v_files"))


@query(
    "discover_increment_dirs",
    f"""select regexp_extract(path, {INCREMENT_DIRS}, 2) as keyspace, regexp_extract(path, {INCREMENT_DIRS}, 3) as "table",
      regexp_extract(path, {INCREMENT_DIRS}, 1) as directory, count(*) as n_files, cast(sum(length) as bigint) as n_bytes
    from v_files where path like '%/backups/%' group by all""",
    ["v_files"],
)
def discover_increment_dirs(spark, sf_dir):
    return catalog.discover_increment_dirs(view(spark, sf_dir, "v_files"))


@query(
    "discover_change_log",
    "select '/commitlog' as directory, count(*) as n_files, cast(sum(length) as bigint) as n_bytes from v_files where path like '/commitlog/%' having count(*) > 0",
    ["v_files"],
)
def discover_change_log(spark, sf_dir):
    return catalog.discover_change_log(view(spark, sf_dir, "v_files"), "/commitlog")


@query(
    "drop_denied_tables",
    """with f as (select path, length, split_part(path, '/', 4) as keyspace, split_part(path, '/', 5) as "table" from v_files where path like '/data/%')
    select * from f where not (keyspace = 'system' and "table" in ('local', 'peers', 'LocationInfo')) and keyspace <> 'OpsCenter'""",
    ["v_files"],
)
def drop_denied_tables(spark, sf_dir):
    files = view(spark, sf_dir, "v_files").where(F.col("path").startswith("/data/")).select(
        "path", "length", F.split_part("path", F.lit("/"), F.lit(4)).alias("keyspace"), F.split_part("path", F.lit("/"), F.lit(5)).alias("table")
    )
    return validate.drop_denied_tables(files)


@query(
    "list_backup_objects",
    "select object_id, object_key, length from v_objects where object_key = 'backups/main/host-1' or object_key like 'backups/main/host-1/%'",
    ["v_objects"],
)
def list_backup_objects(spark, sf_dir):
    found = catalog.list_backup_objects(view(spark, sf_dir, "v_objects"), "backups/main/host-1")
    return found.select("object_id", "object_key", "length")


@query(
    "files_per_table",
    PARSED + """select host_id, backup_type, keyspace, "table", count(*) as n_files, cast(sum(length) as bigint) as n_bytes
    from parsed where valid group by all""",
    ["v_objects"],
)
def files_per_table(spark, sf_dir):
    return catalog.files_per_table(valid(spark, sf_dir))


MANIFEST = "listed as (select object_key from v_objects where modified < timestamp '2000-01-01')"


def manifest(spark, sf_dir):
    """What an earlier listing found."""
    return view(spark, sf_dir, "v_objects").where(F.col("modified") < F.lit("2000-01-01").cast("timestamp_ntz")).select("object_key")


@query(
    "new_since_backup",
    f"with {MANIFEST} select object_id, object_key from v_objects where object_key not in (select object_key from listed)",
    ["v_objects"],
)
def new_since_backup(spark, sf_dir):
    files = view(spark, sf_dir, "v_objects").select("object_id", "object_key")
    return catalog.new_since_backup(files, manifest(spark, sf_dir), "object_key").select("object_id", "object_key")


@query(
    "prune_backed_up",
    PARSED + f""", {MANIFEST} select object_id, object_key, backup_type,
      case when backup_type = 'SST' and object_key in (select object_key from listed) then 'removed' else 'kept' end as action from parsed""",
    ["v_objects"],
)
def prune_backed_up(spark, sf_dir):
    files = parsed(spark, sf_dir).select("object_id", "object_key", "backup_type")
    return backups.prune_backed_up(files, manifest(spark, sf_dir), "object_key").select("object_id", "object_key", "backup_type", "action")


@query(
    "reconcile_counts",
    PARSED + """, src as (select backup_type, keyspace, "table", count(*) as n from parsed where valid group by all),
    arc as (select backup_type, keyspace, "table", count(*) as n from parsed where valid and length > 1000000 group by all),
    upl as (select backup_type, keyspace, "table", count(*) as n from parsed where valid and backup_type <> 'CL' group by all),
    every as (select backup_type, keyspace, "table", n as s, 0 as a, 0 as u from src union all
      select backup_type, keyspace, "table", 0, n, 0 from arc union all select backup_type, keyspace, "table", 0, 0, n from upl)
    select backup_type, keyspace, "table", cast(sum(s) as bigint) as n_source, cast(sum(a) as bigint) as n_archived,
      cast(sum(u) as bigint) as n_uploaded, sum(s) = sum(a) and sum(a) = sum(u) as agree from every group by all""",
    ["v_objects"],
)
def reconcile_counts(spark, sf_dir):
    source = valid(spark, sf_dir)
    archived, uploaded = source.where("length > 1000000"), source.where("backup_type <> 'CL'")
    return backups.reconcile_counts(source, archived, uploaded, ["backup_type", "keyspace", "table"])


@query(
    "union_backup_types",
    PARSED + """select object_id, object_key, backup_type, cast(case backup_type when 'SNAP' then 0 else 1 end as bigint) as step
    from parsed where backup_type in ('SNAP', 'SST')""",
    ["v_objects"],
)
def union_backup_types(spark, sf_dir):
    return catalog.union_backup_types(parsed(spark, sf_dir)).select("object_id", "object_key", "backup_type", "step")


@query(
    "latest_snapshot",
    PARSED + "select host_id, max(snapshot) as snapshot from parsed where backup_type = 'SNAP' group by host_id",
    ["v_objects"],
)
def latest_snapshot(spark, sf_dir):
    return catalog.latest_snapshot(parsed(spark, sf_dir).where("backup_type = 'SNAP'"))


@query(
    "expire_snapshots",
    PARSED + """, staged as (select distinct host_id, keyspace, snapshot from parsed where backup_type = 'SNAP')
    select host_id, keyspace, snapshot, newest from
      (select *, max(snapshot) over (partition by host_id, keyspace) as newest from staged) where snapshot < newest""",
    ["v_objects"],
)
def expire_snapshots(spark, sf_dir):
    return backups.expire_snapshots(parsed(spark, sf_dir).where("backup_type = 'SNAP'")).select("host_id", "keyspace", "snapshot", "newest")


@query(
    "fold_backup_results",
    PARSED + """, dirs as (select host_id, snapshot, backup_type, keyspace, regexp_extract(object_key, '^(.*)/[^/]+$', 1) as directory, count(*) as n
      from parsed where valid group by all)
    select host_id, snapshot, backup_type, keyspace, cast(sum(n) as bigint) as files_count, count(*) as n_directories,
      cast(0 as bigint) as part, string_agg(directory, ',' order by directory) as directories from dirs group by host_id, snapshot, backup_type, keyspace""",
    ["v_objects"],
)
def fold_backup_results(spark, sf_dir):
    files = valid(spark, sf_dir).withColumn("directory", F.expr("left(object_key, length(object_key) - length(file_name) - 1)"))
    return backups.fold_backup_results(files).withColumn("directories", F.array_join("directories", ","))


LIST_SIZE = 100


@query(
    "write_backup_metadata",
    PARSED + f""", sized as (select *, count(*) over (partition by host_id, snapshot, backup_type, keyspace, "table") as n from parsed where valid),
    parts as (select *, cast(('0x' || substr(md5(file_name), 1, 8)) as bigint) % cast(ceil(n / {LIST_SIZE}.0) as bigint) as part from sized)
    select host_id, snapshot, backup_type, keyspace, "table", part, n as files_count,
      case backup_type when 'SNAP' then 'SnapshotMetaData.txt' when 'SST' then 'SSTMetaData-2024-02-01-00:00:00.txt'
        else 'ClMetaData-2024-02-01-00:00:00.txt' end as document_name,
      '{{"filesCount":' || n || ',"files":["' || string_agg(file_name, '","' order by file_name) || '"]}}' as document
    from parts group by host_id, snapshot, backup_type, keyspace, "table", part, n""",
    ["v_objects"],
)
def write_backup_metadata(spark, sf_dir):
    return backups.write_backup_metadata(valid(spark, sf_dir), "2024-02-01-00:00:00", limit=LIST_SIZE)


@query(
    "classify_backup_type",
    PARSED + """select object_id, backup_type, case backup_type when 'SNAP' then 'snapshot' when 'SST' then 'incremental' when 'CL' then 'commitlog' end as metric,
      coalesce(backup_type = 'SST', false) as removable from parsed""",
    ["v_objects"],
)
def classify_backup_type(spark, sf_dir):
    return validate.classify_backup_type(parsed(spark, sf_dir).select("object_id", "backup_type"))


@query(
    "completed_bytes",
    PARSED + """select backup_type, cast(sum(length) as bigint) as value, count(*) as n_objects,
      'backup.' || case backup_type when 'SNAP' then 'snapshot' when 'SST' then 'incremental' else 'commitlog' end || '.object_store.completed_bytes' as name
    from parsed where valid group by backup_type""",
    ["v_objects"],
)
def completed_bytes(spark, sf_dir):
    return backups.completed_bytes(valid(spark, sf_dir), "object_store")


@query(
    "split_counter",
    """with c as (select object_id, length * 1024 as value from v_objects),
    n as (select *, greatest((value + 2147483646) // 2147483647, 1) as pieces from c),
    e as (select object_id, value, unnest(range(cast(pieces as bigint))) as piece from n)
    select object_id, value, piece, least(2147483647, value - piece * 2147483647) as increment from e""",
    ["v_objects"],
)
def split_counter(spark, sf_dir):
    counters = view(spark, sf_dir, "v_objects").select("object_id", (F.col("length") * 1024).alias("value"))
    return split_into_increments(counters)


@query(
    "size_histogram",
    PARSED + """, b as (select backup_type, length, cast(length(bin(length)) - 1 as bigint) as power from parsed where valid)
    select backup_type, case when length > 0 then power else -1 end as power, count(*) as n_objects, cast(sum(length) as bigint) as n_bytes,
      case when length > 0 then cast(pow(2, power) as bigint) else 0 end as size_from from b group by all""",
    ["v_objects"],
)
def size_histogram(spark, sf_dir):
    return metrics.size_histogram(valid(spark, sf_dir), ["backup_type"])


@query(
    "default_host",
    """select request_id, keyspace, coalesce(nullif(trim(host_id), ''), 'host-3') as host_id,
      coalesce(nullif(trim(host_id), ''), 'host-3') <> 'host-3' as other_host from v_requests""",
    ["v_requests"],
)
def default_host(spark, sf_dir):
    return validate.default_host(view(spark, sf_dir, "v_requests"), "host-3")


@query(
    "expand_keyspaces",
    """select r.request_id, coalesce(k.keyspace, r.keyspace) as keyspace from v_requests r
    left join v_keyspaces k on r.keyspace = '*'""",
    ["v_requests", "v_keyspaces"],
)
def expand_keyspaces(spark, sf_dir):
    requests = view(spark, sf_dir, "v_requests").select("request_id", "keyspace")
    return validate.expand_keyspaces(requests, view(spark, sf_dir, "v_keyspaces"))
