"""Small inputs around the limits of each rule."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strongbox.functions import keys, status
from strongbox.operators import backups, catalog, checks, runs, state, transfer, validate
from strongbox.schemas import MAX_INCREMENT


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def objects(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "object_key string")


FULL = "b/main/Host-1/s/snap/ks/t/f.dat"
SHORT = "b/main/Host-1/s/CL/log.tar.gz"


def test_key_parts(spark):
    out = keys.parse_object_key(objects(spark, FULL, SHORT, "b/main/h", "b/c/h/s/SNAP/k/t/", "b/c/h/s/CL/", "", None))
    found = {r.object_key: r for r in out.collect()}
    assert (found[FULL].keyspace, found[FULL].table, found[FULL].file_name) == ("ks", "t", "f.dat")
    assert (found[SHORT].keyspace, found[SHORT].file_name, found[SHORT].valid) == (None, "log.tar.gz", True)
    assert [found[k].valid for k in ("b/main/h", "b/c/h/s/SNAP/k/t/", "b/c/h/s/CL/", "", None)] == [False] * 5


def test_key_ignores_case_of_host_and_type(spark):
    out = validate.validate_object_keys(objects(spark, FULL, SHORT, "x"), "HOST-1", "SNAP")
    assert values(out.select("object_key", "reason")) == sorted([(FULL, None), (SHORT, "type"), ("x", "parts")], key=repr)
    with pytest.raises(PySparkException, match="invalid object key"):
        validate.validate_object_keys(objects(spark, "x"), "HOST-1", "SNAP", strict=True).collect()


def test_key_needs_its_first_parts(spark):
    fields = "cluster string, host_id string, snapshot string, backup_type string, keyspace string, `table` string, file_name string"
    ok = spark.createDataFrame([("c", "h", "s", "CL", " ", None, "f")], fields)
    assert keys.build_object_key(ok, "b").first().object_key == "b/c/h/s/CL/f"
    for blank in ("", "  ", None):
        with pytest.raises(PySparkException, match="object key needs"):
            keys.build_object_key(spark.createDataFrame([("c", blank, "s", "CL", "k", "t", "f")], fields), "b").collect()


def test_prefix_ends_at_a_part(spark):
    found = catalog.list_backup_objects(objects(spark, "b/a/1", "b/ab/1", "b/a"), "b/a")
    assert values(found) == [("b/a",), ("b/a/1",)]


def test_change_log_folder(spark):
    files = spark.createDataFrame([("/data/x", 1)], "path string, length bigint")
    assert catalog.discover_change_log(files, "/log").count() == 0
    with pytest.raises(ValueError):
        catalog.discover_change_log(files, "/log", required=True)


def test_denied_tables(spark):
    files = spark.createDataFrame(
        [("OpsCenter", "x"), ("system", "local"), ("system", "hints"), ("sales", "local"), (None, None)], "keyspace string, `table` string"
    )
    assert values(validate.drop_denied_tables(files)) == sorted([("system", "hints"), ("sales", "local"), (None, None)], key=repr)


def test_scope_needs_keyspace_and_host(spark):
    with pytest.raises(ValueError):
        validate.check_restore_scope(objects(spark), " ", "h")


def test_unknown_backup_type(spark):
    files = spark.createDataFrame([("SST",), ("X",)], "backup_type string")
    assert values(validate.classify_backup_type(files)) == [("SST", "incremental", True), ("X", None, False)]
    with pytest.raises(PySparkException, match="unknown backup type"):
        validate.classify_backup_type(files, strict=True).collect()


def test_long_keyspace_list(spark, monkeypatch):
    monkeypatch.setattr(validate, "SHARES", 3)
    known = spark.createDataFrame([(f"k{i}",) for i in range(20)], "keyspace string")
    requests = spark.createDataFrame([(1, "*"), (2, "k1"), (3, "other"), (4, None)], "id int, keyspace string")
    expected = [(1, f"k{i}") for i in range(20)] + [(2, "k1"), (3, "other"), (4, None)]
    assert values(validate.expand_keyspaces(requests, known)) == sorted(expected, key=repr)


def test_counters_at_the_limit(spark):
    points = spark.createDataFrame([(0,), (MAX_INCREMENT,), (MAX_INCREMENT + 1,), (2 * MAX_INCREMENT,)], "value bigint")
    found = [(r.value, r.increment) for r in status.split_counter(points).collect()]
    assert sorted(found) == [(0, 0), (MAX_INCREMENT, MAX_INCREMENT), (MAX_INCREMENT + 1, 1), (MAX_INCREMENT + 1, MAX_INCREMENT),
                             (2 * MAX_INCREMENT, MAX_INCREMENT), (2 * MAX_INCREMENT, MAX_INCREMENT)]


def test_ages(spark):
    rows = [("a", "last_snapshot_name", "2024-01-01-00:00:59"), ("a", "last_snapshot_status", "complete"), ("a", "last_snapshot_filecount", "3"),
            ("a", "last_sst_name", "snap/"), ("a", "last_cl_name", "(null)"), ("b", "last_sst_name", "s/2024-01-01-00:00:00"), ("b", "last_cl_name", "junk")]
    out = status.backup_age_minutes(spark.createDataFrame(rows, "host_id string, name string, value string"), "2024-01-01 00:02:58")
    assert values(out) == [("a", "2024-01-01-00:00:59/complete", 3, 1, "(null)", -1, -1, "(null)", -1, -1),
                           ("b", "(null)", -1, -1, "s/2024-01-01-00:00:00", -1, 2, "(null)", -1, -1)]


def test_heap_without_limit(spark):
    out = status.heap_usage(spark.createDataFrame([(1, 0)], "heap_used_bytes bigint, heap_max_bytes bigint")).first()
    assert out.heap_usage_perc is None and out.heap_usage == "0.00/0.00"


def test_nested_metric(spark):
    docs = spark.createDataFrame([('{"WriteLatency":{"mean":"1.5"}}',), ('{"WriteLatency":{}}',), ("no json",)], "d string")
    assert [r[0] for r in docs.select(status.metric_from_json("d", "WriteLatency.mean")).collect()] == [1.5, None, None]


def test_attempts(spark):
    attempts = [(1, i, i == 4) for i in range(1, 5)] + [(2, i, i == 5) for i in range(1, 6)] + [(3, 1, True), (3, 1, True), (3, 2, False), (4, 1, False)]
    out = runs.attempt_outcomes(spark.createDataFrame(attempts, "upload_id int, attempt_no int, ok boolean"))
    assert values(out) == [(1, 4, 4, 3, False, "uploaded"), (2, None, 4, 3, True, "failed"), (3, 1, 1, 0, False, "uploaded"), (4, None, 1, 0, False, "unfinished")]


def at(second, micro=0):
    return datetime(2024, 1, 1, 0, second // 60, second % 60, micro)


def test_admission_at_the_previous_end(spark):
    ops = [(1, "h", "SNAP", at(0), 10), (2, "h", "RESTORE", at(9), 5), (3, "h", "RESTORE", at(10), 0), (4, "h", "SNAP", at(10), 5),
           (5, "h", "SST", at(1), 5), (6, "h", "NONE", at(1), 5)]
    df = spark.createDataFrame(ops, "op_id bigint, host_id string, op_type string, started timestamp_ntz, secs bigint")
    assert values(runs.admit_exclusive(df).select("op_id", "admitted")) == [(1, True), (2, False), (3, True), (4, True), (5, True)]
    conflicts = runs.conflicting_operations(df).select("op_id", "blocker_op_id", "n_running", "blocked_secs")
    assert values(conflicts) == [(2, 1, 1, 1), (3, 2, 1, 4), (4, 2, 1, 4)]


def test_snapshot_must_be_complete(spark):
    increments = spark.createDataFrame([("h", 1, at(5)), ("h", 2, at(10)), ("g", 3, at(10))], "host_id string, op_id bigint, started timestamp_ntz")
    snaps = spark.createDataFrame([("h", "s1", at(1), at(10)), ("h", "s2", at(4), None)], "host_id string, snapshot string, started timestamp_ntz, finished timestamp_ntz")
    complete = runs.attach_to_snapshot(increments, snaps).select("op_id", "snapshot", "accepted")
    assert values(complete) == [(1, None, False), (2, "s1", True), (3, None, False)]
    started = runs.attach_to_snapshot(increments, snaps, complete_only=False).select("op_id", "snapshot")
    assert values(started) == [(1, "s2"), (2, "s2"), (3, None)]


def test_progress_interval(spark):
    rows = [(1, "STARTED", at(0), 0), (2, "BYTES", at(2), 1), (3, "BYTES", at(2, 1000), 2), (4, "PART", at(3), 4), (5, "BYTES", at(4, 1000), 8),
            (6, "BYTES", at(4, 2000), 16), (7, "COMPLETED", at(5), 0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "file_id bigint, seq bigint, kind string, ts timestamp_ntz, bytes bigint")
    shown = transfer.throttle_progress(df).select("seq", "bytes_done")
    assert values(shown) == [(1, 0), (3, 3), (4, 7), (6, 31), (7, 31)]
    assert values(transfer.throttle_progress(df, count_parts=False).select("seq", "bytes_done"))[-1] == (7, 27)


def test_last_write_wins(spark):
    fields = "name string, value string, date_modified timestamp_ntz, seq bigint"
    old = spark.createDataFrame([("a", "1", at(1), 1), ("b", "1", at(1), 2)], fields)
    new = spark.createDataFrame([("a", "2", at(1), 3), ("c", None, at(0), 4)], fields)
    after = state.upsert_state(old, new)
    assert values(after.select("name", "value")) == sorted([("a", "2"), ("b", "1"), ("c", None)], key=repr)
    assert state.point_lookup(after, "z").count() == 0


def test_lists_of_a_large_group_are_split(spark):
    rows = spark.createDataFrame([("k", f"f{i}") for i in range(100)] + [(None, "x")], "k string, f string")
    lists = backups.bounded_lists(rows, ["k"], "f", limit=10).collect()
    assert sorted(f for r in lists for f in r["items"] if r.k) == sorted(f"f{i}" for i in range(100))
    assert len(lists) > 8 and {r.n_items for r in lists if r.k} == {100} and [r["items"] for r in lists if r.k is None] == [["x"]]


def test_expiry_of_one_keyspace(spark):
    staged = spark.createDataFrame([("h", "a", "1"), ("h", "a", "2"), ("h", "b", "1"), ("h", "b", "3")], "host_id string, keyspace string, snapshot string")
    assert values(backups.expire_snapshots(staged, "a").select("keyspace", "snapshot")) == [("a", "1")]


def test_removal_deletes_listed_increments_only(spark, tmp_path):
    names = {"sst-new": "SST", "sst-old": "SST", "snap-old": "SNAP"}
    for name in names:
        (tmp_path / name).write_text("x")
    files = spark.createDataFrame([(str(tmp_path / n), t) for n, t in names.items()], "path string, backup_type string")
    manifest = files.where(F.col("path").endswith("old")).select("path")
    assert backups.prune_backed_up(files, manifest, "path", execute=True).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["snap-old", "sst-new"]


def test_thresholds(spark):
    ages = spark.createDataFrame([(-1,), (0,), (9,), (10,), (20,), (None,)], "last_sst_backup_age_mins bigint")
    states = [r.state for r in checks.check_sst_backup_age(ages, 10, 20).collect()]
    assert states == ["CRITICAL", "OK", "OK", "WARNING", "CRITICAL", "UNKNOWN"]
    nodes = spark.createDataFrame([(3,), (4,), (5,), (6,)], "live_nodes bigint")
    assert [r.state for r in checks.check_live_nodes(nodes, 5, 3).collect()] == ["CRITICAL", "WARNING", "WARNING", "OK"]
    heap = spark.createDataFrame([(79.99,), (80.0,)], "heap_usage_perc double")
    assert [(r.code, r.message) for r in checks.check_heap_usage(heap, 50, 80).collect()] == [
        (1, "WARNING: heap_usage_perc: 79/50"), (2, "CRITICAL: heap_usage_perc: 80/80")]
    tables = spark.createDataFrame([("", "t", 9.0), ("k", " ", 9.0), ("k", "t", None), ("k", "t", 9.0)], "keyspace string, cf string, WriteLatency_mean double")
    assert [r.code for r in checks.check_write_latency(tables, 5, 8).collect()] == [3, 3, 3, 2]


def test_no_threshold_is_unknown(spark):
    rows = spark.createDataFrame([(1, 5, 3, 5.0, 5, "k", "c")], "live_nodes bigint, last_sst_backup_age_mins bigint, last_snap_backup_age_mins bigint, heap_usage_perc double, last_cl_backup_age_mins bigint, keyspace string, cf string")
    rows = rows.withColumns({"WriteLatency_mean": F.lit(1.0), "ReadLatency_mean": F.lit(1.0), "low": F.lit(None).cast("bigint"), "high": F.lit(9).cast("bigint")})
    for check in (checks.check_live_nodes, checks.check_sst_backup_age, checks.check_snap_backup_age, checks.check_cl_backup_age,
                  checks.check_heap_usage, checks.check_write_latency, checks.check_read_latency):
        for warn, crit in (("low", "high"), ("high", "low")):
            row = check(rows, warn, crit).first()
            assert (row.state, row.code) == ("UNKNOWN", 3) and row.message.startswith("UNKNOWN: ")


def test_unfinished_snapshots_have_no_age(spark):
    rows = spark.createDataFrame([("a", "last_snapshot_name", "2024-01-01-00:00:00"), ("a", "last_snapshot_status", "inprogress")], "host_id string, name string, value string")
    shown = [status.backup_age_minutes(rows, "2024-01-01 00:02:00", complete_only=c).first().last_snap_backup_age_mins for c in (True, False)]
    assert shown == [-1, 2]
