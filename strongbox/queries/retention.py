"""Expiry, pruning of staged files, and the clustered catalogue."""

from datetime import datetime

from pyspark.sql import functions as F

from strongbox.plans import backup, changes, retention
from strongbox.plans.manifest import read_manifest
from strongbox.queries.registry import query, table, view
from strongbox.queries.tables import KEYSPACE
from strongbox.sources import catalogue
from strongbox.workspace import new_folder

NAMES = ["2024-01-05-00:00:00", "2024-01-31-00:00:00", "2024-02-10-00:00:00", "2024-02-10-18:00:00", "2024-02-11-00:00:00"]
KEEP = retention.Retention(last=1, days=2, months=2)
WHY = ["expired", "month", "expired", "day", "last"]

EXPIRY = " union all ".join(
    f"select '{name}' as snapshot, 'SNAP' as backup_type, count(*) as n_rows, '{'expire' if why == 'expired' else 'keep'}' as action, '{why}' as reason from supplier"
    for name, why in zip(NAMES, WHY)
) + "".join(
    f" union all select '{NAMES[at]}', 'SST', count(*), '{'keep' if reason == 'needed' else 'expire'}', '{reason}' from supplier where s_suppkey % 3 = 0"
    for at, reason in ((0, "expired"), (1, "needed"))
)


def _snapshots(spark, sf_dir):
    """Five snapshots, and an increment below the first two: a third of the rows is gone."""
    folder, rows = new_folder(spark, "backup"), table(spark, sf_dir, "supplier")
    for name in NAMES:
        backup.snapshot_backup(rows, folder, name, KEYSPACE, "supplier")
    for name in NAMES[:2]:
        changes.change_backup(rows.where("s_suppkey % 3 <> 0"), folder, KEYSPACE, "supplier", ["s_suppkey"], datetime(2024, 2, 1), name)
    return folder


@query("expire_backups", EXPIRY)
def expire_backups(spark, sf_dir):
    plan = retention.expire_backups(spark, _snapshots(spark, sf_dir), KEEP, execute=True)
    return plan.select("snapshot", "backup_type", "n_rows", "action", "reason")


@query("kept_after_expiry", f"select snapshot, backup_type, n_rows from ({EXPIRY}) where action = 'keep'")
def kept_after_expiry(spark, sf_dir):
    folder = _snapshots(spark, sf_dir)
    for _ in range(2):  # the second time there is nothing left to do
        retention.expire_backups(spark, folder, KEEP, execute=True)
    return read_manifest(spark, folder).groupBy("snapshot", "backup_type").agg(F.sum("n_rows").alias("n_rows"))


@query(
    "prune_staged",
    """select o_orderstatus as staged, count(*) as n_rows, count(*) filter (o_orderstatus <> 'P' or o_orderkey % 2 = 0) as backed_up,
      if(o_orderstatus = 'P', 'kept', 'removed') as outcome from orders group by all""",
)
def prune_staged(spark, sf_dir):
    """Three staged files; the backup has all rows of two of them."""
    folder, orders = new_folder(spark, "backup"), table(spark, sf_dir, "orders")
    for status in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == status).coalesce(1).write.parquet(f"{folder}/staged/{status}")
    part = {"snapshot": NAMES[0], "keyspace": KEYSPACE, "table": "orders"}
    backup.snapshot_backup(orders.where("o_orderstatus <> 'P' or o_orderkey % 2 = 0"), f"{folder}/b", **part)
    retention.plan_prune(spark, f"{folder}/b", f"{folder}/staged", orders.schema, f"{folder}/plan", **part, backup_type="SNAP")
    retention.execute_prune(spark, f"{folder}/plan")
    done = retention.execute_prune(spark, f"{folder}/plan")
    return done.select(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("staged"), "n_rows", "backed_up", "outcome")


@query(
    "read_catalogue",
    """select object_id, object_key, length + if(object_id % 10 = 0 and object_id % 97 <> 0, 1, 0) as length from v_objects
      where (object_key = 'backups/main/host-3' or object_key like 'backups/main/host-3/%') and (object_id % 10 <> 1 or object_id % 97 = 0)""",
    ["v_objects"],
)
def read_catalogue(spark, sf_dir):
    """Objects of one host from the catalogue after an update: some have changed, some are gone."""
    folder = new_folder(spark, "catalogue")
    objects = view(spark, sf_dir, "v_objects").select("object_id", "object_key", "length")
    whole = objects.where("object_id % 97 <> 0")  # keys that broke off repeat, and stay as they are
    catalogue.write_catalogue(objects, folder)
    changed = whole.where("object_id % 10 = 0").withColumn("length", F.col("length") + 1)
    catalogue.update_catalogue(spark, folder, objects.schema, changed, whole.where("object_id % 10 = 1"))
    return catalogue.read_catalogue(spark, folder, objects.schema, "backups/main/host-3")
