"""Expiry by reference, two-phase pruning, and the clustered catalogue."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_backups import content

from strongbox.plans import backup, changes, manifest, restore, retention
from strongbox.plans.retention import Retention
from strongbox.sources import catalogue

KS = "ks"


def named(at):
    return at.strftime("%Y-%m-%d-%H:%M:%S")


def kept(names, keep):
    """Which snapshots of one table stay, and why."""
    times, why = sorted((datetime.strptime(n, "%Y-%m-%d-%H:%M:%S") for n in names), reverse=True), {}
    for kind, period, n in (("month", lambda t: (t.year, t.month), keep.months), ("day", lambda t: t.date(), keep.days)):
        first = {}
        for t in times:
            first.setdefault(period(t), t)
        why |= {named(t): kind for t in list(first.values())[:n]}
    return why | {named(t): "last" for t in times[: max(1, keep.last)]}


@pytest.mark.parametrize("keep", [Retention(), Retention(2, 3, 0), Retention(0, 2, 4), Retention(1, 0, 2)])
def test_retention_by_table(spark, tmp_path, keep, monkeypatch):
    draw, rows = random.Random(1), []
    names = {t: sorted({named(datetime(2024, 1, 1) + timedelta(hours=draw.randrange(24 * 120))) for _ in range(25)}) for t in ("a", "b")}
    for t, found in names.items():
        rows += [("f", 1, 1, 0, 0, "", n, kind, KS, t, "whole") for n in found for kind in ("SNAP", "SST")]
    rows += [("f", 1, 1, 0, 0, "", n, "CL", "changes", "log", "batch-1") for n in {*names["a"], *names["b"], "2020-01-01-00:00:00"}]
    rows += [("f", 1, 1, 0, 0, "", "by hand", "SNAP", KS, "a", "whole"), ("f", 1, 1, 0, 0, "", "2019-01-01-00:00:00", "SST", KS, "a", "increment-000000001")]
    frame = spark.createDataFrame(rows, "file string, length long, n_rows long, digest_xor long, digest_sum long, schema string, snapshot string, backup_type string, keyspace string, table string, copy string")
    monkeypatch.setattr(retention, "read_manifest", lambda *a, **b: frame)
    got = {(r.snapshot, r.backup_type, r.table): (r.action, r.reason) for r in retention.plan_expiry(spark, "", keep).collect()}
    stay = {t: kept(n, keep) for t, n in names.items()}
    for t, found in names.items():
        for n in found:
            assert got[n, "SNAP", t] == (("keep", stay[t][n]) if n in stay[t] else ("expire", "expired"))
            assert got[n, "SST", t] == (("keep", "needed") if n in stay[t] else ("expire", "expired"))
    for n in {*names["a"], *names["b"]}:
        assert got[n, "CL", "log"] == (("keep", "needed") if n in stay["a"] or n in stay["b"] else ("expire", "expired"))
    assert got["2020-01-01-00:00:00", "CL", "log"] == ("keep", "unknown") and got["by hand", "SNAP", "a"] == ("keep", "unnamed")
    assert got["2019-01-01-00:00:00", "SST", "a"] == ("keep", "unknown")


def test_what_expires_is_deleted_and_the_rest_restores(spark, tmp_path, monkeypatch):
    place, rows = str(tmp_path / "b"), spark.range(50).selectExpr("cast(id as int) as k", "cast(id as string) as v")
    names = ["2024-01-01-00:00:00", "2024-01-02-00:00:00", "2024-01-03-00:00:00"]
    for n in names:
        backup.snapshot_backup(rows, place, n, KS, "t")
        changes.change_backup(rows.where("k > 9"), place, KS, "t", ["k"], datetime(2024, 1, 9), n)
    assert content(retention.expire_backups(spark, place, Retention()).select("action")) == [("expire",)] * 4 + [("keep",)] * 2
    assert len(list(Path(place).rglob("snapshot=2024-01-01*"))) == 2  # nothing was deleted yet
    real, calls = retention.delete_folder, []

    def dies(path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("gone")
        real(path)

    monkeypatch.setattr(retention, "delete_folder", dies)
    with pytest.raises(OSError):
        retention.expire_backups(spark, place, Retention(), execute=True)
    monkeypatch.setattr(retention, "delete_folder", real)
    done = retention.expire_backups(spark, place, Retention(), execute=True)
    assert done.where("action = 'expire'").count() > 0
    assert {r.snapshot for r in manifest.read_manifest(spark, place).collect()} == {names[2]}
    assert backup.last_snapshot(place, KS, "t") == names[2]
    part = {"snapshot": names[2], "keyspace": KS, "table": "t"}
    assert content(changes.restore_changes(spark, place, rows.schema, **part, keys=["k"], dest=str(tmp_path / "r"))) == content(rows.where("k > 9"))
    with pytest.raises(FileNotFoundError):
        restore.restore_backup(spark, place, rows.schema, snapshot=names[0], keyspace=KS, table="t")
    assert retention.expire_backups(spark, place, Retention(), execute=True).where("action = 'expire'").count() == 0


def test_pruning_in_two_phases(spark, tmp_path):
    rows, place, staged = spark.range(90).selectExpr("id as k", "if(id % 30 = 0, null, 'v') as v"), str(tmp_path / "b"), tmp_path / "staged=a b%+ü"
    for i in range(3):
        rows.where(f"k div 30 = {i}").coalesce(1).write.parquet(str(staged / f"p{i}"))
    rows.limit(0).coalesce(1).write.parquet(str(staged / "empty"))
    part = {"snapshot": "2024-01-01-00:00:00", "keyspace": KS, "table": "t", "backup_type": "SNAP"}
    backup.snapshot_backup(rows.where("k <> 31"), place, "2024-01-01-00:00:00", KS, "t")
    plan = retention.plan_prune(spark, place, str(staged), rows.schema, str(tmp_path / "plan"), **part)
    assert sorted((r.n_rows, r.backed_up, r.action) for r in plan.collect()) == [(30, 29, "keep"), (30, 30, "remove"), (30, 30, "remove")]
    (changed,) = (staged / "p2").glob("*.parquet")
    rows.where("k > 1000").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "other"))
    changed.write_bytes(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    for _ in range(2):
        done = retention.execute_prune(spark, str(tmp_path / "plan"))
        assert sorted(r.outcome for r in done.collect()) == ["changed", "kept", "removed"]
    assert sorted(p.parent.name for p in staged.rglob("*.parquet")) == ["empty", "p1", "p2"]
    next(p for p in Path(place).rglob("*.parquet") if "_manifests" not in str(p)).unlink()
    with pytest.raises(manifest.DamagedBackup):
        retention.plan_prune(spark, place, str(staged), rows.schema, str(tmp_path / "plan2"), **part)


def test_a_prefix_reads_few_files(spark, tmp_path):
    folder = str(tmp_path / "c")
    objects = spark.range(20_000).selectExpr("concat('base/h', id % 50, '/', lpad(id, 6, '0')) as object_key", "id as length")
    assert catalogue.write_catalogue(objects, folder, rows_per_file=1000) == 1
    got = catalogue.read_catalogue(spark, folder, objects.schema, "base/h7/")
    assert content(got) == content(objects.where("length % 50 = 7"))
    files = {r[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 3 and len(list((tmp_path / "c/version-000000001").glob("*.parquet"))) == 20
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(object_key,base/h7/),LessThan(object_key," in plan
    exact = catalogue.read_catalogue(spark, folder, objects.schema, "base/h7/000007")
    assert [r.length for r in exact.collect()] == [7]
    added = objects.where("length = 8").withColumn("length", F.lit(-8).cast("long"))
    assert catalogue.update_catalogue(spark, folder, objects.schema, added, objects.where("length = 9")) == 2
    assert catalogue.read_catalogue(spark, folder, objects.schema).agg(F.sum("length"), F.count("*")).first()[0:] == (199990000 - 16 - 9, 19999)
    for _ in range(2):
        catalogue.write_catalogue(objects, folder)
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["version-000000003", "version-000000004"]
    (tmp_path / "c/version-000000004/_SUCCESS").unlink()  # as if the writer had died
    assert catalogue.read_catalogue(spark, folder, objects.schema).count() == 20_000 and catalogue.write_catalogue(objects.limit(5), folder) == 4
    assert catalogue.read_catalogue(spark, folder, objects.schema).count() == 5
    assert catalogue.read_catalogue(spark, str(tmp_path / "none"), objects.schema, "x").count() == 0


def test_lists_keep_their_shape(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) as k", "concat('f', id) as f", "id as size")
    heads, items = catalogue.listed(rows, ["k"], "f", "size")
    assert heads.where("k = 'hot'").collect()[0][1:] == (1000, sum(range(0, 3000, 3)))
    assert items.columns == ["k", "f", "size"] and items.count() == 3000
    parts = items.withColumn("p", F.spark_partition_id()).where("k = 'hot'").select("p").distinct().count()
    assert parts > 1 or items.rdd.getNumPartitions() == 1
