"""Runs that fail on the way, are killed, and go on; keyspaces that come back whole."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_backups import content

from strongbox.functions.status import backup_age_minutes
from strongbox.plans import runs
from strongbox.plans.manifest import DamagedBackup

SNAPSHOT, UNITS = "2024-01-01-00:00:00", "host_id string, keyspace string, `table` string"
NAMES = [("h/1", "a", "t1"), ("h/1", "a", "t2"), ("h/1", "b", "t1"), ("h2", "a", "t1"), ("h2", "system", "peers"), ("h2", "system", "kept")]


@pytest.fixture
def world(spark, tmp_path):
    calls, broken = [], set()

    def source(host, keyspace, table):
        calls.append((host, keyspace, table))
        if (host, keyspace, table) in broken:
            raise OSError("disk is gone\nmore")
        return spark.range(20).selectExpr("id as k", f"'{host}{keyspace}{table}' as v")

    tables = spark.createDataFrame([*NAMES, NAMES[0]], UNITS)
    everything = spark.createDataFrame([("h/1", "*"), ("h2", "*"), ("h2", "a"), ("h3", "*"), ("h2", "none")], "host_id string, keyspace string")

    def run(name="r1", requests=everything, **more):
        return runs.run_backup(spark, str(tmp_path / "root"), name, requests, tables, source, **{"snapshot": SNAPSHOT} | more)

    return run, calls, broken, str(tmp_path / "root")


def test_a_run_goes_on_where_it_stopped(spark, world):
    run, calls, broken, root = world
    broken |= {NAMES[1], NAMES[3]}
    with pytest.raises(runs.BackupRunFailed, match="h/1/a/t2: disk is gone.*h2/a/t1"):
        run()
    assert sorted(calls) == sorted([*NAMES[:4], NAMES[5]])  # the denied table is not asked for
    states = {(r.host_id, r.keyspace, r.table): (r.status, r.attempt) for r in runs.last_states(runs.run_states(spark, root)).collect()}
    assert states[NAMES[1]] == ("failed", 1) and states[NAMES[0]] == ("complete", 1)
    service = {(r.host_id, r.name): r.value for r in runs.service_state(runs.run_states(spark, root)).collect()}
    assert service["h/1", "last_snapshot_status"] == "inprogress" and service["h/1", "last_snapshot_name"] == SNAPSHOT
    calls.clear(), broken.clear()
    done = run()
    assert sorted(calls) == [NAMES[1], NAMES[3]]
    assert {(r.status, r.attempt, r.n_rows) for r in done.collect()} == {("complete", 1, 20), ("complete", 2, 20)} and done.count() == 5
    calls.clear()
    assert run().count() == 5 and calls == []
    ages = backup_age_minutes(runs.service_state(runs.run_states(spark, root)), "2024-01-01 01:00:00")
    assert {(r.host_id, r.last_snap_backup, r.last_snap_backup_age_mins) for r in ages.collect()} == {(h, f"{SNAPSHOT}/complete", 60) for h in ("h/1", "h2")}


def test_a_copy_that_was_finished_before_the_run_died_is_taken_over(spark, world, monkeypatch):
    run, calls, _, root = world
    real = runs.read_manifest

    def dies(*given, **parts):
        if parts["table"] == "t2":
            raise KeyboardInterrupt
        return real(*given, **parts)

    monkeypatch.setattr(runs, "read_manifest", dies)
    with pytest.raises(KeyboardInterrupt):
        run()
    monkeypatch.setattr(runs, "read_manifest", real)
    calls.clear()
    states = {r.table: r.status for r in runs.last_states(runs.run_states(spark, root)).where("host_id = 'h/1' and keyspace = 'a'").collect()}
    assert states["t2"] == "inprogress"
    assert {r.status for r in run().collect()} == {"complete"} and NAMES[1] not in calls


def test_runs_of_increments_and_a_restored_keyspace(spark, world, tmp_path):
    run, calls, _, root = world
    run()
    later = {"backup_type": "SST", "keys": lambda keyspace, table: ["k"], "at": datetime(2024, 1, 2)}
    run("r2", **later)  # nothing has changed
    assert {r.files_count for r in runs.last_states(runs.run_states(spark, root)).where("run = 'r2'").collect()} == {0}

    def fewer(host, keyspace, table):
        return spark.range(5, 25).selectExpr("id as k", "'new' as v")

    tables = spark.createDataFrame(NAMES, UNITS)
    third = {**later, "at": datetime(2024, 1, 3), "snapshot": SNAPSHOT}
    only = spark.createDataFrame([("h/1", "a")], "host_id string, keyspace string")
    done = runs.run_backup(spark, root, "r3", only, tables, fewer, **third)
    assert sorted((r.table, r.status, r.n_rows) for r in done.collect()) == [("t1", "complete", 25), ("t2", "complete", 25)]  # 5 gone, 15 changed, 5 new
    dest = str(tmp_path / "restored")
    with pytest.raises(ValueError, match="can't be restored on"):
        runs.restore_keyspace(spark, root, "h/1", "h2", SNAPSHOT, "a", dest)
    with pytest.raises(ValueError, match="keys"):
        runs.restore_keyspace(spark, root, "h/1", "h/1", SNAPSHOT, "a", dest)
    with pytest.raises(FileNotFoundError):
        runs.restore_keyspace(spark, root, "h/1", "h/1", SNAPSHOT, "none", dest)
    got = runs.restore_keyspace(spark, root, "h/1", "h/1", SNAPSHOT, "a", dest, {"t1": ["k"], "t2": ["k"]})
    assert list(got) == ["t1", "t2"] and all(content(g) == content(fewer("", "", "")) for g in got.values())
    with pytest.raises(FileExistsError):
        runs.restore_keyspace(spark, root, "h/1", "h/1", SNAPSHOT, "a", dest, {"t1": ["k"], "t2": ["k"]})
    early = runs.restore_keyspace(spark, root, "h/1", "h/1", SNAPSHOT, "a", f"{dest}-2", {"t1": ["k"], "t2": ["k"]}, until=datetime(2024, 1, 2, 12))
    assert {r.v for r in early["t1"].collect()} == {"h/1at1"} and early["t1"].count() == 20
    next(p for p in Path(root).rglob("*.parquet") if "increment-" in str(p) and "_manifests" not in str(p)).unlink()
    with pytest.raises(DamagedBackup):
        runs.restore_keyspace(spark, root, "h/1", "h/1", SNAPSHOT, "a", f"{dest}-3", {"t1": ["k"], "t2": ["k"]})
    for wrong in ({"backup_type": "CL"}, {"backup_type": "SST"}):
        with pytest.raises(ValueError):
            run("r9", **wrong)
    with pytest.raises(ValueError, match="host"):
        runs.host_backup(root, " ")
