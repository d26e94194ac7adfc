"""Runs over hosts, keyspaces and tables that fail on the way and go on; what they leave behind."""

from datetime import datetime

from pyspark.sql import functions as F

from strongbox.functions.status import backup_age_minutes
from strongbox.operators.digests import table_digest
from strongbox.plans import runs
from strongbox.queries.registry import query, table
from strongbox.queries.tables import SNAPSHOT
from strongbox.workspace import new_folder

HOSTS = {"host-0": 0, "host-1": 1}
OWNED = {"sales": {"orders": ("orders", "o_custkey"), "lineitem": ("lineitem", "l_suppkey")}, "crm": {"customer": ("customer", "c_custkey")}}
STATES = "host_id string, keyspace string, `table` string"
RUN, NEXT = "2000-01-01", "2000-01-02"
KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"]}
LATER = datetime(2000, 1, 1, 12)


def _units(spark):
    rows = [(host, keyspace, name) for host in HOSTS for keyspace, owned in OWNED.items() for name in owned]
    return spark.createDataFrame([*rows, ("host-0", "system", "local"), ("host-1", "OpsCenter", "any")], STATES)


def _source(spark, sf_dir, change=lambda name, rows: rows):
    """The rows of a host's table: those whose key is dealt to the host."""

    def rows(host, keyspace, name):
        given, key = OWNED[keyspace][name]
        return change(name, table(spark, sf_dir, given).where(F.pmod(F.col(key), F.lit(len(HOSTS))) == HOSTS[host]))

    return rows


def _run(spark, sf_dir):
    """A first run in which two units can't be read, and a second call that goes on with those."""
    root = new_folder(spark, "hosts")
    requests = spark.createDataFrame([("host-0", "*"), ("host-1", "sales"), ("host-1", "crm")], "host_id string, keyspace string")
    failing = _source(spark, sf_dir, lambda name, rows: rows.where(F.raise_error(F.lit("unreadable")).isNotNull()) if name == "lineitem" else rows)
    try:
        runs.run_backup(spark, root, RUN, requests, _units(spark), failing, snapshot=SNAPSHOT)
    except runs.BackupRunFailed:
        return root, requests, runs.run_backup(spark, root, RUN, requests, _units(spark), _source(spark, sf_dir), snapshot=SNAPSHOT)
    raise AssertionError("a run that failed in part passed for complete")


COUNTED = " union all ".join(
    f"select '{host}' as host_id, '{keyspace}' as keyspace, '{name}' as \"table\", count(*) as n_rows from {given} where {key} % {len(HOSTS)} = {at}"
    for host, at in HOSTS.items() for keyspace, owned in OWNED.items() for name, (given, key) in owned.items()
)


@query("resumable_run", f"select *, 'complete' as status, cast(if(\"table\" = 'lineitem', 2, 1) as bigint) as attempt from ({COUNTED})")
def resumable_run(spark, sf_dir):
    return _run(spark, sf_dir)[2].select(*runs.UNIT, "n_rows", "status", "attempt")


@query(
    "run_service_state",
    f"""select host_id, '{SNAPSHOT}/complete' as last_snap_backup, cast(1440 as bigint) as last_snap_backup_age_mins,
      '{SNAPSHOT}/2000-01-01-12:00:00' as last_sst_backup, cast(720 as bigint) as last_sst_backup_age_mins, '(null)' as last_cl_backup,
      cast(sum(n_rows) as bigint) as n_rows from ({COUNTED}) group by host_id""",
)
def run_service_state(spark, sf_dir):
    """Ages by the states that a run of snapshots and one of increments left."""
    root, requests, _ = _run(spark, sf_dir)
    dearer = _source(spark, sf_dir, lambda name, rows: rows.where("o_orderkey % 4 <> 0") if name == "orders" else rows)
    runs.run_backup(
        spark, root, NEXT, requests, _units(spark), dearer, snapshot=SNAPSHOT, backup_type="SST", keys=lambda keyspace, name: KEYS[name], at=LATER
    )
    states = runs.run_states(spark, root)
    ages = backup_age_minutes(runs.service_state(states), "2000-01-02 00:00:00")
    copied = runs.last_states(states).where(F.col("backup_type") == "SNAP").groupBy("host_id").agg(F.sum("n_rows").alias("n_rows"))
    return ages.join(copied, "host_id").select(
        "host_id", "last_snap_backup", "last_snap_backup_age_mins", "last_sst_backup", "last_sst_backup_age_mins", "last_cl_backup", "n_rows"
    )


@query(
    "restore_keyspace",
    f"select 'host-1' as host_id, \"table\", n_rows, true as same from ({COUNTED.replace('from orders where', 'from orders where o_orderkey % 4 <> 0 and')}) "
    "where host_id = 'host-1' and keyspace = 'sales'",
)
def restore_keyspace(spark, sf_dir):
    """All tables of a host's keyspace, after a run of snapshots and one of increments with deletions."""
    root, requests, _ = _run(spark, sf_dir)
    fewer = _source(spark, sf_dir, lambda name, rows: rows.where("o_orderkey % 4 <> 0") if name == "orders" else rows)
    runs.run_backup(spark, root, NEXT, requests, _units(spark), fewer, snapshot=SNAPSHOT, backup_type="SST", keys=lambda k, name: KEYS[name], at=LATER)
    dest = new_folder(spark, "restored")
    tables = runs.restore_keyspace(spark, root, "host-1", "host-1", SNAPSHOT, "sales", dest, KEYS)
    out = None
    for name, rows in tables.items():
        meant = table_digest(fewer("host-1", "sales", name)).withColumnsRenamed({"n_rows": "n", "digest_xor": "x", "digest_sum": "s"})
        same = table_digest(rows).join(meant, F.expr("n_rows = n"), "left").select(
            F.lit("host-1").alias("host_id"), F.lit(name).alias("table"), "n_rows", F.expr("coalesce(digest_xor = x and digest_sum = s, false)").alias("same")
        )
        out = same if out is None else out.unionByName(same)
    return out
