"""Change sets, deletions, manifests and restores to a time, against brute force and with damaged files."""

import random
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_backups import content

from strongbox.operators.changes import change_set
from strongbox.operators.digests import DIGEST, row_hash, table_digest
from strongbox.plans import backup, changes, manifest, restore
from strongbox.queries.registry import table
from strongbox.sources import files

PART = {"snapshot": "2024-01-02-03:04:05", "keyspace": "007", "table": "t/1"}
DAY = datetime(2024, 1, 3)
FIELDS = "k int, v string, n double"


def frame(spark, rows, fields=FIELDS):
    return spark.createDataFrame(rows, fields)


def restored(spark, place, schema, **more):
    return changes.restore_changes(spark, place, schema, **PART, keys=["k"], **more)


def record(rows, place, day=0):
    return changes.change_backup(rows, place, PART["keyspace"], PART["table"], ["k"], DAY + timedelta(days=day))


def test_what_shrinks_comes_back_shrunk(spark, tmp_path):
    rows, place = spark.range(1000).selectExpr("cast(id as int) as k", "cast(id as string) as v", "id / 2 as n"), str(tmp_path / "b")
    backup.snapshot_backup(rows, place, **PART)
    found = record(rows.where("k >= 500"), place)
    assert found.agg(F.sum("n_rows")).first()[0] == 500
    assert content(restored(spark, place, rows.schema, dest=str(tmp_path / "r"))) == content(rows.where("k >= 500"))
    assert record(rows.where("k >= 500"), place, 1).count() == 0  # nothing has changed
    record(rows.where("k < 100"), place, 2)
    assert content(restored(spark, place, rows.schema)) == content(rows.where("k < 100"))
    assert content(restored(spark, place, rows.schema, until=DAY + timedelta(days=1))) == content(rows.where("k >= 500"))
    record(rows.limit(0), place, 3)
    assert restored(spark, place, rows.schema, dest=str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="at or after"):
        record(rows, place, 3)
    with pytest.raises(ValueError, match="restore_changes"):
        restore.restore_backup(spark, place, rows.schema, **PART)


def test_keys_that_are_null_or_repeat_or_are_hot(spark, tmp_path):
    before = [(1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (None, "x", 0.0), (2, None, 1.0), (3, "c", None), (4, "same", 0.0), (4, "same", 0.0)]
    after = [(1, "a", 1.0), (1, "b", 2.0), (1, "b", 2.0), (None, "y", 0.0), (2, "1", None), (5, None, None), (4, "same", 0.0), (4, "same", 0.0)]
    before += [(7, str(i), float(i)) for i in range(500)] + [(8, str(i), 0.0) for i in range(500)]
    after += [(7, str(i), float(i)) for i in range(499)] + [(8, str(499 - i), 0.0) for i in range(500)]
    found = content(change_set(frame(spark, before), frame(spark, after), ["k"]).where("k is null or k <> 7").select("change", "k", "v", "n"))
    assert found == sorted([("update", 1, 1.0, "a"), ("update", 1, 2.0, "b"), ("update", 1, 2.0, "b"), ("update", None, 0.0, "y"),
                            ("update", 2, None, "1"), ("delete", 3, None, None), ("insert", 5, None, None)], key=repr)
    place = str(tmp_path / "b")
    backup.snapshot_backup(frame(spark, before), place, **PART)
    record(frame(spark, after), place)
    assert content(restored(spark, place, frame(spark, after).schema, dest=str(tmp_path / "r"))) == content(frame(spark, after))


def test_hashes_tell_where_a_null_is(spark):
    fields = "id int, a string, b string, l array<int>, s struct<x int, y int>, m map<string, int>"
    rows = frame(spark, [
        (0, "v", None, None, None, None), (1, None, "v", None, None, None), (2, None, None, [None, 1], None, None), (3, None, None, [1, None], None, None),
        (4, None, None, None, (1, None), None), (5, None, None, None, (None, 1), None), (6, None, None, None, None, {"x": None}), (7, None, None, None, None, {}),
        (8, None, None, [], None, None), (9, "", None, None, None, None),
    ], fields)
    hashed = [r[0] for r in rows.select(row_hash(rows.drop("id").schema).alias("h")).collect()]
    assert len(set(hashed)) == 10
    assert rows.select(*reversed(rows.columns)).select(row_hash(rows.schema)).collect() == rows.select(row_hash(rows.schema)).collect()
    twice = frame(spark, [(1, "a", 0.0), (1, "a", 0.0)]), frame(spark, [(1, "b", 0.0), (1, "b", 0.0)])
    assert content(change_set(*twice, ["k"])) == [("update", 1, 0.0, "b")] * 2
    assert table_digest(twice[0].limit(0)).select(*DIGEST).first()[0:] == (0, 0, 0)
    with pytest.raises(ValueError, match="other columns"):
        change_set(twice[0], twice[1].drop("n"), ["k"])
    with pytest.raises(ValueError, match="needs keys"):
        change_set(*twice, [])


def parquet_files(place):
    return sorted(p for p in Path(place).rglob("*.parquet") if "_manifests" not in str(p))


@pytest.fixture
def saved(spark, sf, tmp_path):
    place, orders = str(tmp_path / "b"), table(spark, sf, "orders").withColumn("version", F.lit(1).cast("bigint"))
    backup.snapshot_backup(orders.where("o_orderkey % 9 <> 0").repartition(4), place, **PART)
    backup.incremental_backup(orders, place, PART["keyspace"], PART["table"], ["o_orderkey"], "version")
    return place, orders


def restore_saved(spark, place, orders, dest=None, schema=None):
    return restore.restore_backup(spark, place, schema or orders.schema, **PART, keys=["o_orderkey"], version="version", one_row_per_key=True, dest=dest)


def test_a_whole_backup_passes(spark, saved, tmp_path):
    place, orders = saved
    assert content(restore_saved(spark, place, orders, str(tmp_path / "r"))) == content(orders)
    report = manifest.verify_backup(spark, place)
    assert {r.status for r in report.collect()} == {"ok"} and report.agg(F.sum("n_rows"), F.sum("found_rows")).first()[0:] == (orders.count(),) * 2
    fewer = orders.drop("o_orderpriority")
    assert content(restore_saved(spark, place, fewer, str(tmp_path / "r2"))) == content(fewer)  # verified in a pass of its own


@pytest.mark.parametrize("damage", ["lost", "cut", "added", "changed", "increment lost"])
def test_damage_is_named(spark, saved, tmp_path, damage):
    place, orders = saved
    snapshot, increment = ([p for p in parquet_files(place) if ("increment-" in str(p)) == i] for i in (False, True))
    named = snapshot[1]
    if damage == "lost":
        named.unlink()
    elif damage == "cut":
        named.write_bytes(named.read_bytes()[:-100])
    elif damage == "added":
        named = named.with_name("part-9.parquet")
        named.write_bytes(snapshot[0].read_bytes())
    elif damage == "increment lost":
        (named := increment[0]).unlink()
    else:  # other rows in a file of the same name and length
        data, other = bytearray(named.read_bytes()), snapshot[2].read_bytes()
        size = len(data)
        other = other[:size] if len(other) >= size else other + bytes(size - len(other))
        named.write_bytes(other)
        checksum = named.with_name(f".{named.name}.crc")
        if checksum.exists():
            checksum.unlink()
    for crc in Path(place).rglob(f".{named.name}.crc"):
        crc.unlink()
    status = {"lost": "missing", "cut": "resized", "added": "unlisted", "changed": "changed", "increment lost": "missing"}[damage]
    report = manifest.verify_backup(spark, place).where("status <> 'ok'")
    assert [(r.file, r.status) for r in report.collect()] == [(named.name, status)]
    if damage != "changed":
        with pytest.raises(manifest.DamagedBackup, match=f"{named.name} {status}"):
            restore_saved(spark, place, orders)
        with pytest.raises(manifest.DamagedBackup, match=named.name):
            restore_saved(spark, place, orders, str(tmp_path / "r"))
        assert not (tmp_path / "r").exists()


def test_other_content_of_the_same_length(spark, tmp_path):
    """The restore finds in its own pass that rows are not those that were backed up, and takes them back."""
    place, rows = str(tmp_path / "b"), frame(spark, [(i, f"v{i:03d}", 1.0) for i in range(100)]).coalesce(1)
    backup.snapshot_backup(rows, place, **PART, compression="none")
    (file,) = parquet_files(place)
    data = file.read_bytes()
    assert data.count(b"v042") >= 1
    file.write_bytes(data.replace(b"v042", b"v999"))
    file.with_name(f".{file.name}.crc").unlink()
    with pytest.raises(manifest.DamagedBackup, match=f"{file.name} changed"):
        restore.restore_backup(spark, place, rows.schema, **PART, dest=str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()
    with pytest.raises(manifest.DamagedBackup, match="changed"):
        restored(spark, place, rows.schema, dest=str(tmp_path / "r"))


def test_a_failed_increment_is_no_part_of_the_backup(spark, tmp_path, monkeypatch):
    place, rows = str(tmp_path / "b"), frame(spark, [(i, "a", 0.0) for i in range(50)])
    backup.snapshot_backup(rows, place, **PART)
    more = rows.withColumn("v", F.lit("b"))
    real = manifest._total
    monkeypatch.setattr(manifest, "_total", lambda m: {})
    with pytest.raises(manifest.DamagedBackup, match="was written"):
        record(more, place)
    monkeypatch.setattr(manifest, "_total", real)
    import shutil

    shutil.move(str(next(Path(place).rglob("copy=increment*"))), str(tmp_path / "lost"))  # as if the writer had died before
    assert content(restored(spark, place, rows.schema)) == content(rows)
    record(more.where("k < 25"), place)
    assert content(restored(spark, place, rows.schema, dest=str(tmp_path / "r"))) == content(more.where("k < 25"))
    assert len({p.parent for p in parquet_files(place)}) == 2


def log_frame(spark, entries):
    return frame(spark, entries, "k int, v string, n double, change string, ts timestamp, seq long")


def write_log(spark, tmp_path, place, entries, name):
    from strongbox.streaming import jobs

    source = str(tmp_path / f"source-{name}")
    log_frame(spark, entries).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log_frame(spark, []).schema).parquet(source)
    jobs.change_log_backup(stream, place, str(tmp_path / f"checkpoint-{name}"), PART["snapshot"]).awaitTermination()
    return changes.ChangeLog(stream.schema)


def at(hours):
    return DAY.replace(tzinfo=UTC) + timedelta(hours=hours)


def test_restore_to_any_time(spark, tmp_path):
    """Random writes; increments are taken in between, the log has every write."""
    draw, place = random.Random(4), str(tmp_path / "b")
    live = {k: (k, "start", 0.0) for k in range(0, 40)} | {None: (None, "start", 0.0)}
    backup.snapshot_backup(frame(spark, list(live.values())), place, **PART)
    entries, states = [], {0: dict(live)}
    for hour in range(1, 9):
        for seq in range(12):
            k = draw.choice([*range(50), None])
            row = (k, f"{hour}.{seq}", draw.choice([None, 1.0]))
            kind = draw.choice(["insert", "update", "DELETE"])
            entries.append((*(row if kind != "DELETE" else (k, None, None)), kind, at(hour), seq))
            live.pop(k, None)
            if kind != "DELETE":
                live[k] = row
        states[hour] = dict(live)
        if hour in (3, 6):
            changes.change_backup(frame(spark, list(live.values())), place, PART["keyspace"], PART["table"], ["k"], at(hour + 0.5))
    entries += entries[50:60]  # logged twice
    log = write_log(spark, tmp_path, place, entries, "all")
    schema = frame(spark, []).schema
    for hour in (0, 2, 4, 7, 8):
        got = restored(spark, place, schema, until=at(hour + 0.7), log=log, dest=str(tmp_path / f"r{hour}"))
        assert content(got) == content(frame(spark, list(states[hour].values()), FIELDS))
    assert content(restored(spark, place, schema, log=log)) == content(frame(spark, list(live.values())))
    assert content(restored(spark, place, schema, until=(DAY + timedelta(hours=6.7)))) == content(frame(spark, list(states[6].values())))
    with pytest.raises(ValueError, match="taken after"):
        restored(spark, place, schema, until=datetime(2024, 1, 1), log=log)
    lost = next(p for p in parquet_files(place) if "batch-" in str(p))
    lost.unlink()
    with pytest.raises(manifest.DamagedBackup, match=f"{lost.name} missing"):
        restored(spark, place, schema, log=log)


def test_misuse(spark, tmp_path):
    place, rows = str(tmp_path / "b"), frame(spark, [(1, "a", 0.0)])
    with pytest.raises(ValueError, match="take a snapshot"):
        record(rows, place)
    with pytest.raises(FileNotFoundError):
        restored(spark, place, rows.schema)
    backup.snapshot_backup(rows, place, **PART)
    with pytest.raises(ValueError, match="named like"):
        record(rows.withColumn("change", F.lit(1)), place)
    with pytest.raises(ValueError, match="keys"):
        changes.restore_changes(spark, place, rows.schema, **PART, keys=[])
    versioned = rows.withColumn("version", F.lit(1))
    backup.snapshot_backup(versioned, place, "2024-01-09-00:00:00", "ks", "versioned")
    backup.incremental_backup(versioned.withColumn("version", F.lit(2)), place, "ks", "versioned", ["k"], "version")
    with pytest.raises(ValueError, match="restore_backup"):
        changes.restore_changes(spark, place, versioned.schema, snapshot="2024-01-09-00:00:00", keyspace="ks", table="versioned", keys=["k"])
    broken = rows.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(PySparkException):
        record(broken, place)
    assert files.read_backup(spark, place, rows.schema, backup_type="SST", **PART).count() == 0
    assert content(restored(spark, place, rows.schema)) == content(rows)


def test_few_changes_leave_the_snapshot_unshuffled(spark, tmp_path):
    place, rows = str(tmp_path / "b"), spark.range(2000).selectExpr("cast(id as int) as k", "cast(id as string) as v", "0D as n")
    backup.snapshot_backup(rows, place, **PART)
    record(rows.where("k <> 5"), place)
    plan = restored(spark, place, rows.schema)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ReadSchema: struct<k:int,v:string,n:double>" in plan
