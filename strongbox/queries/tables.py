"""Backups, restores, bulk loads, archives and streams: queries that write and read back."""

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strongbox.plans import backup, restore
from strongbox.queries.operations import ADMITTED, DECIDED, INTERVAL_MS, THROTTLED
from strongbox.queries.registry import query, stream, stream_view, table, view
from strongbox.queries.status import LATEST
from strongbox.sources import archives, bulk, files
from strongbox.streaming import jobs
from strongbox.workspace import new_folder

SNAPSHOT = "2000-01-01-00:00:00"
KEYSPACE = "007"  # a name that must not turn into a number


def _first_version(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("version", F.lit(1).cast("bigint"))


def _all_versions(spark, sf_dir):
    """Orders, and a second version of those in progress with another price."""
    first = _first_version(spark, sf_dir)
    second = first.where(F.col("o_orderstatus") == "P").withColumns(
        {"o_totalprice": F.col("o_totalprice") + 1, "version": F.lit(2).cast("bigint")}
    )
    return first.unionByName(second)


def _snapshot_rows(spark, sf_dir):
    return _first_version(spark, sf_dir).where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))


def _backed_up(spark, sf_dir):
    """A snapshot of the orders before 2000 and an increment with everything since."""
    folder = new_folder(spark, "backup")
    backup.snapshot_backup(_snapshot_rows(spark, sf_dir), folder, SNAPSHOT, KEYSPACE, "orders")
    backup.incremental_backup(_all_versions(spark, sf_dir), folder, KEYSPACE, "orders", ["o_orderkey"], "version")
    return folder, _first_version(spark, sf_dir).schema


VERSIONS = f"""
with versions as (select *, cast(1 as bigint) as version from orders
    union all select * replace (o_totalprice + 1 as o_totalprice), cast(2 as bigint) from orders where o_orderstatus = 'P'),
  placed as (select *, '{SNAPSHOT}' as snapshot, case when version = 1 and o_orderdate < timestamp '2000-01-01' then 'SNAP' else 'SST' end as backup_type,
    '{KEYSPACE}' as keyspace, 'orders' as "table" from versions)
"""


@query("snapshot_backup", f"select *, '{SNAPSHOT}' as snapshot, 'SNAP' as backup_type, '{KEYSPACE}' as keyspace, 'orders' as \"table\" from orders")
def snapshot_backup(spark, sf_dir):
    folder, rows = new_folder(spark, "backup"), table(spark, sf_dir, "orders")
    backup.snapshot_backup(rows, folder, SNAPSHOT, KEYSPACE, "orders")
    return files.read_backup(spark, folder, rows.schema, snapshot=SNAPSHOT)


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


@query(
    "snapshot_keyspace",
    " union all ".join(f"select '{SNAPSHOT}' as snapshot, 'SNAP' as backup_type, '{KEYSPACE}' as keyspace, '{t}' as \"table\", count(*) as n_rows from {t}" for t in TABLES),
)
def snapshot_keyspace(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in TABLES}
    manifest = backup.snapshot_keyspace(tables, new_folder(spark, "backup"), SNAPSHOT, KEYSPACE)
    return manifest.groupBy("snapshot", "backup_type", "keyspace", "table").agg(F.sum("n_rows").alias("n_rows"))


@query(
    "recorded_backup",
    f"""select '{SNAPSHOT}' as snapshot, 'SNAP' as backup_type, '{KEYSPACE}' as keyspace, status, status = 'complete' as has_files,
      (select count(*) from orders) as n_rows from (values ('inprogress'), ('complete')) s(status)""",
)
def recorded_backup(spark, sf_dir):
    folder, rows = new_folder(spark, "backup"), table(spark, sf_dir, "orders")
    backup.recorded_backup(
        spark, f"{folder}/log", SNAPSHOT, "SNAP", KEYSPACE,
        lambda: backup.snapshot_backup(rows, f"{folder}/data", SNAPSHOT, KEYSPACE, "orders"),
    )
    kept = spark.read.parquet(f"{folder}/log/metadata").groupBy("snapshot", "backup_type", "keyspace").agg(F.sum("n_rows").alias("n_rows"))
    states = backup.backup_states(spark, f"{folder}/log").join(kept, ["snapshot", "backup_type", "keyspace"])
    return states.select("snapshot", "backup_type", "keyspace", "status", (F.col("files_count") > 0).alias("has_files"), "n_rows")


@query("incremental_backup", VERSIONS + "select * from placed where backup_type = 'SST'")
def incremental_backup(spark, sf_dir):
    folder, schema = _backed_up(spark, sf_dir)
    return files.read_backup(spark, folder, schema, backup_type="SST")


@query("read_backup_objects", VERSIONS + "select * from placed")
def read_backup_objects(spark, sf_dir):
    folder, schema = _backed_up(spark, sf_dir)
    return files.read_backup(spark, folder, schema, snapshot=SNAPSHOT, keyspace=KEYSPACE)


@query(
    "restore_backup",
    VERSIONS + "select * exclude (snapshot, backup_type, keyspace, \"table\") from placed qualify row_number() over (partition by o_orderkey order by version desc) = 1",
)
def restore_backup(spark, sf_dir):
    folder, schema = _backed_up(spark, sf_dir)
    return restore.restore_backup(
        spark, folder, schema, snapshot=SNAPSHOT, keyspace=KEYSPACE, table="orders",
        keys=["o_orderkey"], version="version", one_row_per_key=True, dest=new_folder(spark, "restored"),
    )


@query(
    "backup_manifest",
    VERSIONS + "select snapshot, backup_type, keyspace, \"table\", count(*) as n_rows, true as has_files from placed group by all",
)
def backup_manifest(spark, sf_dir):
    folder, _ = _backed_up(spark, sf_dir)
    manifest = backup.backup_manifest(spark, folder, snapshot=SNAPSHOT)
    return manifest.groupBy("snapshot", "backup_type", "keyspace", "table").agg(
        F.sum("n_rows").alias("n_rows"), (F.min("length") > 0).alias("has_files")
    )


@query(
    "list_table_files",
    "select distinct 'sales' as keyspace, o_orderpriority as \"table\", true as has_files from orders",
)
def list_table_files(spark, sf_dir):
    root = new_folder(spark, "data")
    rows = table(spark, sf_dir, "orders").withColumns({"keyspace": F.lit("sales"), "table": F.col("o_orderpriority")})
    rows.write.partitionBy("keyspace", "table").parquet(root)
    listed = files.list_table_files(spark, [root, f"{root}-absent"], "sales")
    return listed.groupBy("keyspace", "table").agg((F.min("length") > 0).alias("has_files"))


BUCKETS = 16


@query(
    "load_csv_bulk",
    f"select *, cast(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8)) as bigint) // {2**32 // BUCKETS} as bucket from orders",
)
def load_csv_bulk(spark, sf_dir):
    csv, loaded = new_folder(spark, "csv"), new_folder(spark, "loaded")
    orders = table(spark, sf_dir, "orders")
    orders.write.option("header", True).option("compression", "gzip").csv(csv)
    return bulk.load_csv_bulk(spark, csv, orders.schema, ["o_orderkey"], BUCKETS, loaded)


def _documents(spark, sf_dir):
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("host_id"), F.col("lang").alias("table"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"),
        text.alias("content"), F.octet_length(text).cast("bigint").alias("length"),
    )


ARCHIVED = f"""
with files as (select source as host_id, lang as "table", lang || '/' || doc_id || '.txt' as member, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) as length from documents),
  sized as (select *, greatest(ceil(sum(length) over g / {archives.PACK_BYTES}.0), ceil(count(*) over g / {archives.PACK_FILES}.0), 1) as packs from files window g as (partition by host_id, "table")),
  packed as (select *, cast(('0x' || substr(md5(member), 1, 8)) as bigint) % cast(packs as bigint) as pack_no from sized),
  named as (select member, cast(length as bigint) as length, sha256(text) as sha256,
    'compressed-' || substr(sha256(concat_ws(chr(1), host_id, "table", pack_no)), 1, 32) || '.tar.gz' as archive from packed)
"""


def _packed(spark, sf_dir):
    folder = new_folder(spark, "archives")
    return folder, archives.pack_archives(_documents(spark, sf_dir), ["host_id", "table"], folder)


@query("pack_archives", ARCHIVED + "select archive, member, length, sha256 from named")
def pack_archives(spark, sf_dir):
    return _packed(spark, sf_dir)[1]


@query("unpack_archives", ARCHIVED + "select archive, member, length, sha256, true as accepted from named")
def unpack_archives(spark, sf_dir):
    folder, _ = _packed(spark, sf_dir)
    return archives.unpack_archives(spark, folder).drop("modified")


@query(
    "overlay_members",
    """with members as (select concat('host-', o_custkey % 16) as host_id, concat(o_custkey, '.dat') as member, concat('compressed-', o_orderkey, '.tar.gz') as archive,
        epoch_ms(o_orderdate) // 1000 as modified, cast(floor(o_totalprice * 100) as bigint) as length from orders)
    select * from members qualify row_number() over (partition by host_id, member order by modified desc, archive desc) = 1""",
)
def overlay_members(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("host-"), F.col("o_custkey") % 16).alias("host_id"),
        F.concat("o_custkey", F.lit(".dat")).alias("member"),
        F.concat(F.lit("compressed-"), "o_orderkey", F.lit(".tar.gz")).alias("archive"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("modified"),
        F.floor(F.col("o_totalprice") * 100).alias("length"),
    )
    return archives.overlay_members(members)


@query("change_log_backup", f"select *, '{SNAPSHOT}' as snapshot, 'CL' as backup_type, 'changes' as keyspace, 'log' as \"table\" from events")
def change_log_backup(spark, sf_dir):
    folder = new_folder(spark, "change-log")
    changes = stream(spark, sf_dir, "events")
    jobs.change_log_backup(changes, f"{folder}/backup", f"{folder}/checkpoint", SNAPSHOT).awaitTermination()
    return files.read_backup(spark, f"{folder}/backup", changes.schema, snapshot=SNAPSHOT, backup_type="CL")


@query(
    "mixed_backup",
    VERSIONS + """select backup_type, keyspace, "table", count(*) as n_rows, cast(sum(o_orderkey) as bigint) as keys from placed group by all
      union all select 'CL', 'changes', 'log', count(*), cast(sum(event_id) as bigint) from events""",
)
def mixed_backup(spark, sf_dir):
    """A snapshot, an increment and a change log below one root, each read back."""
    folder, schema = _backed_up(spark, sf_dir)
    changes = stream(spark, sf_dir, "events")
    jobs.change_log_backup(changes, folder, new_folder(spark, "checkpoint"), SNAPSHOT).awaitTermination()
    manifest = backup.backup_manifest(spark, folder).groupBy("backup_type", "keyspace", "table").agg(F.sum("n_rows").alias("n_rows"))
    orders = files.read_backup(spark, folder, schema, backup_type=["SNAP", "SST"]).withColumnRenamed("o_orderkey", "key")
    events = files.read_backup(spark, folder, changes.schema, backup_type="CL").withColumnRenamed("event_id", "key")
    rows = orders.select("backup_type", "key").unionByName(events.select("backup_type", "key"))
    return manifest.join(rows.groupBy("backup_type").agg(F.sum("key").alias("keys")), "backup_type").select(
        "backup_type", "keyspace", "table", "n_rows", "keys"
    )


@query("restore_after_failed_copy", "select *, cast(1 as bigint) as version from orders")
def restore_after_failed_copy(spark, sf_dir):
    """A copy fails half way; it is no snapshot, can't be restored, and is replaced by the next."""
    folder, rows = new_folder(spark, "backup"), _first_version(spark, sf_dir)
    broken = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 7, F.raise_error(F.lit("unreadable"))).otherwise(F.col("o_totalprice")))
    part = {"snapshot": SNAPSHOT, "keyspace": KEYSPACE, "table": "orders"}
    for attempt in (lambda: backup.snapshot_backup(broken, folder, **part), lambda: restore.restore_backup(spark, folder, rows.schema, **part)):
        try:
            attempt()
        except (PySparkException, FileNotFoundError):
            continue
        raise AssertionError("a failed copy passed for a snapshot")
    backup.snapshot_backup(rows, folder, **part)
    return restore.restore_backup(spark, folder, rows.schema, **part)


@query(
    "stream_counters",
    """select date_trunc('hour', ts) as window_start, event_type as name, count(*) as n, round(sum(value), 6) as total, max(value) as largest
    from events group by all""",
)
def stream_counters(spark, sf_dir):
    folder = new_folder(spark, "counters")
    points = stream(spark, sf_dir, "events").select("ts", F.col("event_type").alias("name"), "value")
    jobs.stream_counters(points, folder).awaitTermination()
    counters = jobs.latest_counters(spark, folder)
    return counters.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 6)})


@query("upsert_state_stream", LATEST + "select * from latest", ["v_state"])
def upsert_state_stream(spark, sf_dir):
    state, run = jobs.upsert_state_stream(stream_view(spark, sf_dir, "v_state"), new_folder(spark, "state"))
    run.awaitTermination()
    return state.last(spark)


@query("throttle_progress_stream", THROTTLED, ["v_transfers"], recursive=True)
def throttle_progress_stream(spark, sf_dir):
    transfers = stream_view(spark, sf_dir, "v_transfers")
    state, run = jobs.throttle_progress_stream(transfers, new_folder(spark, "progress"), INTERVAL_MS)
    run.awaitTermination()
    return state.output(spark, view(spark, sf_dir, "v_transfers").schema.add("bytes_done", "long").add("mb", "long"))


@query("admit_exclusive_stream", ADMITTED, ["v_ops"], recursive=True)
def admit_exclusive_stream(spark, sf_dir):
    operations = stream_view(spark, sf_dir, "v_ops")
    state, run = jobs.admit_exclusive_stream(operations, new_folder(spark, "admission"))
    run.awaitTermination()
    decided = operations.schema.add("lock_class", "string").add("admitted", "boolean")
    return state.output(spark, decided).select(*DECIDED)
