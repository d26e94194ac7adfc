"""Change sets, increments with deletions, restores to a time, and what damage a backup shows."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from strongbox.filesystem import delete_folder
from strongbox.operators.changes import change_set
from strongbox.operators.digests import table_digest
from strongbox.plans import backup, changes, manifest
from strongbox.plans.restore import restore_backup
from strongbox.queries.registry import query, stream, table
from strongbox.queries.tables import KEYSPACE, SNAPSHOT
from strongbox.sources import files
from strongbox.streaming import jobs
from strongbox.workspace import new_folder

KEYS = ["o_orderkey"]
PART = {"snapshot": SNAPSHOT, "keyspace": KEYSPACE, "table": "orders"}
FIRST, SECOND = datetime(2000, 2, 1), datetime(2000, 3, 1)

# Three states of the orders: those of the old days; later some are gone, new or dearer; then some are back.
STATES = """
with before as (select * from orders where o_orderdate < timestamp '2000-01-01'),
  after as (select * replace (o_totalprice + case when o_orderkey % 5 = 0 then 1 else 0 end as o_totalprice) from orders where o_orderkey % 7 <> 0),
  later as (select * replace (o_totalprice + case when o_orderkey % 5 = 0 then 1 when o_orderkey % 3 = 0 then 2 else 0 end as o_totalprice) from orders where o_orderkey % 11 <> 0)
"""


def _states(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    dearer = F.when(key % 5 == 0, 1)
    return (
        orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")),
        orders.where(key % 7 != 0).withColumn("o_totalprice", F.col("o_totalprice") + dearer.otherwise(0)),
        orders.where(key % 11 != 0).withColumn("o_totalprice", F.col("o_totalprice") + dearer.when(key % 3 == 0, 2).otherwise(0)),
    )


def _differences(old: str, new: str) -> str:
    columns = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return f"""select coalesce(n.o_orderkey, o.o_orderkey) as o_orderkey, {", ".join(f"n.{c}" for c in columns)},
      case when o.o_orderkey is null then 'insert' when n.o_orderkey is null then 'delete' else 'update' end as change
    from {old} o full join {new} n on o.o_orderkey = n.o_orderkey where o.o_orderkey is null or n.o_orderkey is null or o.o_totalprice <> n.o_totalprice"""


@query("change_set", STATES + _differences("before", "after"))
def changed_rows(spark, sf_dir):
    before, after, _ = _states(spark, sf_dir)
    return change_set(before, after, KEYS)


def _recorded(spark, sf_dir):
    """A snapshot and two increments."""
    folder, (before, after, later) = new_folder(spark, "backup"), _states(spark, sf_dir)
    backup.snapshot_backup(before, folder, **PART)
    changes.change_backup(after, folder, KEYSPACE, "orders", KEYS, FIRST)
    changes.change_backup(later, folder, KEYSPACE, "orders", KEYS, SECOND)
    return folder, before.schema


@query(
    "change_backup",
    STATES + f"select *, 1 as changed_seq, timestamp '{FIRST}' as changed_at from ({_differences('before', 'after')}) union all "
    f"select *, 2, timestamp '{SECOND}' from ({_differences('after', 'later')})",
)
def change_backup(spark, sf_dir):
    folder, schema = _recorded(spark, sf_dir)
    fields = [*schema.fields, *changes.CHANGE]
    rows = files.read_backup(spark, folder, type(schema)(fields), backup_type="SST", **PART).drop(*backup.BACKUP_PARTITIONS)
    return rows.withColumns({"changed_seq": F.col("changed_seq").cast("int"), "changed_at": F.col("changed_at").cast("timestamp_ntz")})


@query("restore_changes", STATES + "select * from later")
def restore_changes(spark, sf_dir):
    folder, schema = _recorded(spark, sf_dir)
    return changes.restore_changes(spark, folder, schema, **PART, keys=KEYS, dest=new_folder(spark, "restored"))


@query("restore_changes_until", STATES + "select * from after")
def restore_changes_until(spark, sf_dir):
    folder, schema = _recorded(spark, sf_dir)
    return changes.restore_changes(spark, folder, schema, **PART, keys=KEYS, until=datetime(2000, 2, 15), dest=new_folder(spark, "restored"))


# The last event of every user; an error removes the user.
TAKEN, RECORDED, LOGGED, UNTIL = "2024-01-08 00:00:00", "2024-01-12 00:00:00", "2024-01-10 00:00:00", "2024-01-20 00:00:00"
USERS = ("event_id", "user_id", "event_type", "value")


def _users(events, at: str):
    last = events.where(F.col("ts") <= F.lit(at).cast("timestamp_ntz")).groupBy("user_id")
    last = last.agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("e.event_id", "user_id", "e.event_type", "e.value").where("event_type <> 'error'")


@query(
    "restore_to_time",
    f"""with last as (select event_id, user_id, event_type, value from events where ts <= timestamp '{UNTIL}'
      qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select * from last where event_type <> 'error'""",
)
def restore_to_time(spark, sf_dir):
    """The users at a time, from an older snapshot, an increment, and a change log that goes on after it."""
    folder, events = new_folder(spark, "backup"), table(spark, sf_dir, "events")
    part = {"snapshot": TAKEN.replace(" ", "-"), "keyspace": KEYSPACE, "table": "users"}
    before = _users(events, TAKEN)
    backup.snapshot_backup(before, folder, **part)
    changes.change_backup(_users(events, RECORDED), folder, KEYSPACE, "users", ["user_id"], datetime.fromisoformat(RECORDED))
    entries = stream(spark, sf_dir, "events").where(F.col("ts") > F.lit(LOGGED).cast("timestamp_ntz")).select(
        *USERS, "ts", F.expr("if(event_type = 'error', 'delete', 'update')").alias("change")
    )
    jobs.change_log_backup(entries, folder, new_folder(spark, "checkpoint"), part["snapshot"]).awaitTermination()
    log = changes.ChangeLog(entries.schema, seq="event_id")
    return changes.restore_changes(
        spark, folder, before.schema, **part, keys=["user_id"], until=datetime.fromisoformat(UNTIL), log=log, dest=new_folder(spark, "restored")
    )


@query(
    "verify_backup",
    """select status, cast(files as bigint) as files, (select count(*) from orders) as backed_up
    from (values ('ok', 4), ('missing', 1), ('unlisted', 1)) v(status, files)""",
)
def verify_backup(spark, sf_dir):
    """A snapshot of five files, of which one is lost; another turns up beside them. A restore refuses it."""
    folder, orders = new_folder(spark, "backup"), table(spark, sf_dir, "orders")
    backup.snapshot_backup(orders.repartition(5), folder, **PART)
    place = manifest.copy_folder(folder, **PART, backup_type="SNAP")
    delete_folder(f"{place}/{manifest.read_manifest(spark, folder).agg(F.min('file')).first()[0]}")
    orders.coalesce(1).write.mode("append").parquet(place)
    try:
        restore_backup(spark, folder, orders.schema, **PART)
    except manifest.DamagedBackup:
        report = manifest.verify_backup(spark, folder, **PART)
        counted = report.groupBy("status").agg(F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"))
        return counted.select("status", "files", F.sum("n_rows").over(Window.partitionBy(F.lit(1))).alias("backed_up"))  # a row per status
    raise AssertionError("a damaged snapshot passed for a whole one")


@query(
    "table_digest",
    """select o_orderstatus, count(*) as n_rows, true as same from orders group by all""",
)
def digests(spark, sf_dir):
    """The digest of a table does not depend on the order of its rows or on how they are dealt."""
    orders = table(spark, sf_dir, "orders")
    one = table_digest(orders, ["o_orderstatus"])
    other = table_digest(orders.repartition(7, "o_custkey").select(*reversed(orders.columns)), ["o_orderstatus"])
    met = one.join(other.withColumnsRenamed({"digest_xor": "x", "digest_sum": "s", "n_rows": "n"}), "o_orderstatus")
    return met.select("o_orderstatus", "n_rows", F.expr("digest_xor = x and digest_sum = s and n_rows = n").alias("same"))
