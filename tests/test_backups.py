"""Backups and restores give back what was there, by content."""

import io
import tarfile

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strongbox.plans import backup, restore
from strongbox.queries.registry import table
from strongbox.sources import archives, bulk, files


def content(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture
def orders(spark, sf):
    return table(spark, sf, "orders").withColumn("version", F.lit(1).cast("bigint"))


PART = {"snapshot": "2024-01-02-03:04:05", "keyspace": "007", "table": "orders"}


def test_snapshot_comes_back(spark, orders, tmp_path):
    manifest = backup.snapshot_backup(orders, str(tmp_path / "b"), PART["snapshot"], "007", "orders")
    assert manifest.agg(F.sum("n_rows")).first()[0] == orders.count()
    assert content(restore.restore_backup(spark, str(tmp_path / "b"), orders.schema, **PART)) == content(orders)
    with pytest.raises(FileExistsError):
        backup.snapshot_backup(orders, str(tmp_path / "b"), PART["snapshot"], "007", "orders")


def test_partitions_are_pruned(spark, orders, tmp_path):
    backup.snapshot_backup(orders, str(tmp_path / "b"), PART["snapshot"], "007", "orders")
    plan = files.read_backup(spark, str(tmp_path / "b"), orders.schema, **PART).select("o_orderkey")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_manifest_reads_no_column(spark, orders, tmp_path):
    manifest = backup.snapshot_backup(orders, str(tmp_path / "b"), PART["snapshot"], "007", "orders")
    assert "ReadSchema: struct<>" in manifest._jdf.queryExecution().toString()


def test_failed_backup_stays_in_progress(spark, orders, tmp_path):
    place, log = str(tmp_path / "b"), str(tmp_path / "log")
    copy = lambda: backup.snapshot_backup(orders, place, "s1", "ks", "t/1")
    backup.recorded_backup(spark, log, "s1", "SNAP", "ks", copy)
    with pytest.raises(FileExistsError):
        backup.recorded_backup(spark, log, "s1", "SNAP", "ks", copy)
    states = [(r.status, r.files_count > 0) for r in backup.backup_states(spark, log).orderBy("written").collect()]
    assert states == [("inprogress", False), ("complete", True), ("inprogress", False)]
    assert backup.last_snapshot(place, "ks", "t/1") == "s1" and backup.last_snapshot(place, "ks", "t") is None


@pytest.mark.parametrize("unique", [True, False])
def test_increments_replace_and_add(spark, orders, tmp_path, unique):
    place, keys = str(tmp_path / "b"), ["o_orderkey"]
    old = orders.where("o_orderkey % 3 <> 0")
    changed = orders.where("o_orderkey % 5 = 0").withColumns({"o_totalprice": F.lit(1.0), "version": F.lit(2).cast("bigint")})
    stale = orders.where("o_orderkey % 7 = 1").withColumns({"o_totalprice": F.lit(-1.0), "version": F.lit(0).cast("bigint")})
    with pytest.raises(ValueError):
        backup.incremental_backup(orders, place, "007", "orders", keys, "version")
    backup.snapshot_backup(old, place, PART["snapshot"], "007", "orders")
    first = backup.incremental_backup(orders.unionByName(stale), place, "007", "orders", keys, "version")
    assert first.agg(F.sum("n_rows")).first()[0] == orders.where("o_orderkey % 3 = 0").count() + stale.count()
    backup.incremental_backup(orders.unionByName(changed), place, "007", "orders", keys, "version")
    backup.incremental_backup(orders.unionByName(changed), place, "007", "orders", keys, "version")
    assert files.read_backup(spark, place, orders.schema, **PART).count() == orders.count() + stale.count() + changed.count()
    restored = restore.restore_backup(
        spark, place, orders.schema, **PART, keys=keys, version="version", one_row_per_key=unique, dest=str(tmp_path / "r")
    )
    expected = changed.unionByName(orders.join(changed, keys, "left_anti").select(*orders.columns))
    assert content(restored) == content(expected)
    with pytest.raises(PySparkException, match="already exists"):
        restore.restore_backup(spark, place, orders.schema, **PART, dest=str(tmp_path / "r"))
    with pytest.raises(ValueError):
        restore.restore_backup(spark, place, orders.schema, snapshot=" ", keyspace="007", table="orders")


def test_missing_version_is_the_lowest(spark, tmp_path):
    place, fields = str(tmp_path / "b"), "k int, version int, v string"
    base = spark.createDataFrame([(1, None, "s"), (2, 5, "s"), (3, None, "s"), (4, 1, "s")], fields)
    more = spark.createDataFrame([(1, 1, "i"), (2, None, "i"), (3, None, "i"), (5, None, "i")], fields)
    backup.snapshot_backup(base, place, "s", "ks", "t")
    more.withColumns({n: F.lit(v) for n, v in (("snapshot", "s"), ("backup_type", "SST"), ("keyspace", "ks"), ("table", "t"))}).write.mode(
        "append").partitionBy("snapshot", "backup_type", "keyspace", "table").parquet(place)
    rows = restore.restore_backup(spark, place, base.schema, snapshot="s", keyspace="ks", table="t", keys=["k"], version="version", one_row_per_key=True)
    assert sorted((r.k, r.v) for r in rows.collect()) == [(1, "i"), (2, "s"), (3, "i"), (4, "s"), (5, "i")]


def test_empty_table_and_null_keys(spark, tmp_path):
    place, fields = str(tmp_path / "b"), "k int, version int, v string"
    empty = spark.createDataFrame([], fields)
    backup.snapshot_backup(empty, place, "s", "ks", "t")
    assert restore.restore_backup(spark, place, empty.schema, snapshot="s", keyspace="ks", table="t").count() == 0
    rows = spark.createDataFrame([(1, None, "a"), (None, 1, "b"), (2, 1, "c"), (2, 1, "c")], fields)
    for _ in range(2):
        backup.incremental_backup(rows, place, "ks", "t", ["k"], "version", compression="gzip")
    assert content(files.read_backup(spark, place, rows.schema).select(*rows.columns)) == content(rows)
    with pytest.raises(ValueError, match="partitions"):
        backup.snapshot_backup(rows.withColumnRenamed("v", "table"), place, "s2", "ks", "t")


def test_small_increments_leave_the_snapshot_unshuffled(spark, orders, tmp_path):
    place, keys = str(tmp_path / "b"), ["o_orderkey"]
    backup.snapshot_backup(orders.where("o_orderkey % 3 <> 0"), place, PART["snapshot"], "007", "orders")
    backup.incremental_backup(orders, place, "007", "orders", keys, "version")
    restored = restore.restore_backup(spark, place, orders.schema, **PART, keys=keys, version="version", one_row_per_key=True)
    plan = restored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
    assert content(restored) == content(orders)


def test_listing(spark, tmp_path):
    for name in ("r1/ks/t1/a", "r1/ks/t1/snapshots/s/b", "r1/ksx/t1/c", "r2/ks/t2/d", "r2/ks/t2/x/y/_hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "hidden" in name else name)
    roots = [str(tmp_path / r) for r in ("r1", "r2", "absent")]
    listed = files.list_table_files(spark, roots, "ks")
    assert sorted((r.keyspace, r.table, r.path.split("/")[-1], r.length) for r in listed.collect()) == [
        ("ks", "t1", "a", 10), ("ks", "t1", "b", 22), ("ks", "t2", "_hidden", 0), ("ks", "t2", "d", 10)]
    assert files.list_table_files(spark, roots).count() == 5
    assert files.list_table_files(spark, roots[2:], "ks").count() == 0
    with pytest.raises(ValueError):
        files.list_table_files(spark, roots, " ")
    loaded = files.read_backup_objects(listed)
    assert sorted(bytes(r.content).decode() for r in loaded.collect()) == ["", "r1/ks/t1/a", "r1/ks/t1/snapshots/s/b", "r2/ks/t2/d"]


def test_bulk_load_of_one_key(spark, tmp_path):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)], "k bigint, v bigint")
    rows.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "csv"))
    loaded = bulk.load_csv_bulk(spark, str(tmp_path / "csv"), rows.schema, ["k"], 6, str(tmp_path / "t"), rows_per_file=100)
    assert content(loaded.drop("bucket")) == content(rows)
    sizes = [r["count"] for r in loaded.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 100
    hot = loaded.where("k = 1").groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).count()
    assert hot.count() > 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.csv").write_text("k,v\n1,x\n")
    with pytest.raises(Exception, match="x.csv"):
        bulk.load_csv_bulk(spark, str(tmp_path / "bad"), rows.schema, ["k"], 6, str(tmp_path / "t2"))


def make_archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))


def test_unpacking(spark, tmp_path):
    make_archive(tmp_path / "a.tar.gz", [("d", None), ("d/x", b"1"), ("empty", None), ("../out", b"2"), ("/abs", b"3")])
    make_archive(tmp_path / "b.tar.gz", [("d/x", b"44")])
    members = archives.unpack_archives(spark, str(tmp_path), str(tmp_path / "out"))
    found = sorted((r.archive, r.member, r.length, r.accepted) for r in members.collect())
    assert found == [("a.tar.gz", "../out", 1, False), ("a.tar.gz", "/abs", 1, False), ("a.tar.gz", "d/x", 1, True), ("b.tar.gz", "d/x", 2, True)]
    written = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert written == ["a.tar.gz/d/x", "b.tar.gz/d/x"]
    last = archives.overlay_members(members.where("accepted").withColumn("host_id", F.lit("h")))
    assert [(r.member, r.archive) for r in last.collect()] == [("d/x", "b.tar.gz")]


def test_archives_forget_the_members_they_are_done_with(tmp_path, monkeypatch):
    held, add, step = [], tarfile.TarFile.addfile, tarfile.TarFile.next

    def seen(of):
        return lambda tar, *given: (held.append(len(tar.members)), of(tar, *given))[1]

    monkeypatch.setattr(tarfile.TarFile, "addfile", seen(add))
    monkeypatch.setattr(tarfile.TarFile, "next", seen(step))
    writer = archives._ArchiveWriter(f"file:{tmp_path}", "a.tar.gz", 0)
    for i in range(200):
        writer.add(f"m{i}", pa.py_buffer(b"x" * i), False)
    writer.close()
    read = [(member, length) for _, member, length, *_ in archives._members(f"file:{tmp_path}/a.tar.gz", None)]
    assert read == [(f"m{i}", i) for i in range(200)]
    assert len(held) > 400 and max(held) <= 1


def test_packs_of_a_hot_group(spark, sf, tmp_path):
    data = tmp_path / "ks/t"
    (data / "nested").mkdir(parents=True)
    for i in range(60):
        (data / ("nested" if i % 2 else "") / f"f{i}").write_bytes(bytes([i]) * (i * 1000))
    listed = files.list_table_files(spark, [str(tmp_path)], "ks").withColumn("member", F.regexp_extract("path", r"/ks/t/(.*)$", 1))
    manifest = archives.pack_archives(listed, ["keyspace", "table"], str(tmp_path / "packs"), pack_bytes=200_000)
    assert len(list((tmp_path / "packs").glob("compressed-*.tar.gz"))) > 5
    unpacked = archives.unpack_archives(spark, str(tmp_path / "packs"))
    columns = ["archive", "member", "length", "sha256"]
    assert content(unpacked.select(*columns)) == content(manifest.select(*columns))
    assert manifest.select("member").distinct().count() == 60 == manifest.count()
    again = archives.pack_archives(listed, ["keyspace", "table"], str(tmp_path / "packs"), pack_bytes=200_000)
    assert content(again) == content(unpacked.select(*columns))
    assert not [p for p in (tmp_path / "packs").iterdir() if p.name.startswith("_compressed")]


def test_a_failed_copy_is_no_snapshot(spark, orders, tmp_path):
    place, part = str(tmp_path / "b"), PART
    broken = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 7, F.raise_error(F.lit("no"))).otherwise(1.0))
    with pytest.raises(PySparkException):
        backup.snapshot_backup(broken, place, **part)
    assert backup.last_snapshot(place, "007", "orders") is None
    with pytest.raises(FileNotFoundError, match="no complete snapshot"):
        restore.restore_backup(spark, place, orders.schema, **part)
    with pytest.raises(ValueError):
        backup.incremental_backup(orders, place, "007", "orders", ["o_orderkey"], "version")
    backup.snapshot_backup(orders, place, **part)
    assert content(restore.restore_backup(spark, place, orders.schema, **part)) == content(orders)
    with pytest.raises(FileNotFoundError):
        restore.restore_backup(spark, place, orders.schema, snapshot="never", keyspace="007", table="orders")


def test_change_logs_leave_snapshots_readable(spark, sf, orders, tmp_path):
    from strongbox.queries.registry import stream
    from strongbox.streaming import jobs

    place = str(tmp_path / "b")
    backup.snapshot_backup(orders, place, **PART)
    for _ in range(2):  # the second run has nothing left to copy
        changes = stream(spark, sf, "events")
        jobs.change_log_backup(changes, place, str(tmp_path / "c"), PART["snapshot"]).awaitTermination()
    assert files.read_backup(spark, place, orders.schema, backup_type="SNAP").count() == orders.count()
    assert files.read_backup(spark, place, changes.schema, snapshot=PART["snapshot"], backup_type="CL").count() == table(spark, sf, "events").count()
    assert {r.backup_type for r in backup.backup_manifest(spark, place).collect()} == {"SNAP", "CL"}


def test_paths_mean_what_they_mean_to_spark(spark, tmp_path):
    from strongbox import filesystem

    spark.range(3).write.parquet(str(tmp_path / "t"))
    for path in (f"{tmp_path}/t", f"file:{tmp_path}/t", f"file://{tmp_path}/t"):
        assert filesystem.exists(path) and filesystem.qualified(path) == f"file:{tmp_path}/t"
    assert filesystem.folders(str(tmp_path)) == [f"file:{tmp_path}/t"] and filesystem.folders(f"{tmp_path}/none") == []
    for path in ("/x", "hdfs:/x", "dbfs:/x"):
        with pytest.raises(ValueError, match="URI"):
            filesystem.resolve(path)
    assert filesystem.within("hdfs://n:1/", "/x") == "hdfs://n:1/x" and filesystem.within("hdfs://n:1/", "s3://b/x") == "s3://b/x"
