"""Documents of mixed values, and counters that need no state."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strongbox.operators import documents
from strongbox.queries.documents import STATUS, node_status
from strongbox.schemas import TABLE_METRICS
from strongbox.streaming import counters


def test_offsets_grow_by_a_fifth():
    offsets = documents.bucket_offsets()
    assert offsets[:14] == [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 24] and len(offsets) == 90 and offsets == sorted(set(offsets))


def test_documents_hold_every_metric(spark):
    draw = random.Random(2)
    rows = [("t", m, i, i, draw.random() * 1000) for m in ("ReadLatency", "WriteTotalLatency", "LiveScannedHistogram") for i in range(50)]
    rows += [("u", "ReadLatency", 1, 1, 5.0), ("u", "other", 1, 1, 5.0), ("u", "MinRowSize", 1, 1, None), ("t", "LiveScannedHistogram", 99, 99, 1e12)]
    samples = spark.createDataFrame(rows, "cf string, metric string, ts long, sample_id long, value double")
    made = {r.cf: json.loads(r.document) for r in documents.metric_documents(samples).collect()}
    assert all(list(d) == TABLE_METRICS for d in made.values())
    scanned = sorted(r[4] for r in rows if r[1] == "LiveScannedHistogram")
    offsets = documents.bucket_offsets()
    assert made["t"]["LiveScannedHistogram"] == [sum((o < v <= p) for v in scanned) for o, p in zip([-1, *offsets], [*offsets, 1e99])]
    assert made["t"]["ReadLatency"]["count"] == 50 and made["t"]["WriteTotalLatency"] == rows[99][4] and made["u"]["MinRowSize"] is None
    read = {(r.cf, r.metric): r for r in documents.read_metric_documents(documents.metric_documents(samples)).collect()}
    assert len(read) == 60
    hist = read["t", "LiveScannedHistogram"]
    assert hist.kind == "histogram" and hist.p50 == min(o for o in offsets if o >= scanned[25]) and hist.p99 == offsets[-1]
    assert read["u", "ReadLatency"].mean == 5.0 and read["u", "ReadLatency"].number == 5.0 and read["u", "MinRowSize"].kind == "none"


def test_documents_of_others_are_read(spark):
    given = [("a", '{"x": 1, "y": "text", "z": {"mean": 2.5}, "h": [0, 0, 0], "n": null, "big": 1e300}'), ("b", "not json"), ("c", None), ("d", "{}")]
    read = documents.read_metric_documents(spark.createDataFrame(given, "cf string, document string"))
    got = {(r.cf, r.metric): (r.kind, r.number, r.text, r["mean"], r.p50) for r in read.collect()}
    assert got["a", "x"] == ("number", 1.0, None, None, None) and got["a", "y"] == ("text", None, "text", None, None)
    assert got["a", "z"] == ("latency", None, None, 2.5, None) and got["a", "h"] == ("histogram", None, None, None, None)
    assert got["a", "n"][0] == "none" and got["a", "big"][1] == 1e300
    assert got["b", None][0] == "unreadable" == got["c", None][0]


def points(spark, folder):
    return spark.readStream.schema("ts timestamp, name string, value double").option("maxFilesPerTrigger", 1).parquet(folder)


def test_counters_of_many_batches(spark, tmp_path):
    draw, source, place, every = random.Random(3), str(tmp_path / "in"), str(tmp_path / "out"), []
    start = datetime(2024, 1, 1, tzinfo=UTC)

    def run(n):
        for _ in range(n):
            rows = [(start + timedelta(minutes=draw.randrange(60 * 24 * (1 + len(every) // 40))), draw.choice("ab"), float(draw.randrange(9))) for _ in range(40)]
            every.extend(rows)
            spark.createDataFrame(rows, "ts timestamp, name string, value double").coalesce(1).write.mode("append").parquet(source)
        counters.windowed_counters(points(spark, source), place, "6 hours", lateness="1 day").awaitTermination()

    def expected():
        frame = spark.createDataFrame(every, "ts timestamp, name string, value double")
        sums = frame.groupBy(F.window("ts", "6 hours").start.alias("w"), "name").agg(F.count("*"), F.sum("value"), F.max("value"))
        return sorted(tuple(r) for r in sums.collect())

    def found():
        return sorted(tuple(r) for r in counters.read_counters(spark, place).collect())

    assert found() == [] if not (tmp_path / "out").exists() else True
    run(4)
    assert found() == expected()
    assert counters.compact_counters(spark, place) == 3 and found() == expected()
    assert counters.compact_counters(spark, place) == 0
    run(3)
    assert found() == expected()
    assert counters.compact_counters(spark, place) == 3 and found() == expected()
    for kind, n in (("sums", 1), ("compact", 1), ("marks", 2)):
        assert len(list((tmp_path / "out" / kind).iterdir())) == n
    late = counters.late_points(spark, place)
    assert late.count() > 0 and late.agg(F.min("behind_secs")).first()[0] > 86_400
    commits = sorted((tmp_path / "out/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for stale in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        stale.unlink(missing_ok=True)
    before = late.count()
    run(0)  # the last batch is run again
    assert found() == expected() and counters.late_points(spark, place).count() == before


@pytest.mark.parametrize("broken", ["compact", "sums"])
def test_a_compaction_that_broke_off(spark, tmp_path, broken, monkeypatch):
    source, place = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([(datetime(2024, 1, 1, i), "a", 1.0)], "ts timestamp, name string, value double").coalesce(1).write.mode("append").parquet(source)
    counters.windowed_counters(points(spark, source), place).awaitTermination()
    real = counters.delete_folder
    monkeypatch.setattr(counters, "delete_folder", lambda path: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        counters.compact_counters(spark, place)
    monkeypatch.setattr(counters, "delete_folder", real)
    if broken == "compact":  # it died while it wrote
        (tmp_path / "out/compact/batch-000000000001/_SUCCESS").unlink()
    assert counters.read_counters(spark, place).agg(F.sum("n")).first()[0] == 3
    counters.compact_counters(spark, place)
    assert counters.read_counters(spark, place).agg(F.sum("n")).first()[0] == 3
    assert len(list((tmp_path / "out/sums").iterdir())) == 1


def test_no_shuffle_carries_the_lists_of_nodes(spark):
    names = "cluster string, dc string, rack string, host_id string, live boolean, heap_used_bytes bigint, heap_max_bytes bigint"
    nodes = spark.createDataFrame([("a", "d", 'r"1', "h1", True, 1 << 20, 1 << 22), ("a", "d", None, "h2", False, 0, 0), ("b", "e", "r}", "h3", True, 0, 1)], names)
    spaces = spark.createDataFrame([("a", "k2"), ("a", "k1")], "cluster string, keyspace string")
    kinds = {f"last_{kind}_backup{part}": "string" if part == "" else "bigint" for kind in ("snap", "sst", "cl") for part in ("", "_filecount", "_age_mins")}
    ages = spark.createDataFrame([("h1", *[str(7) if of == "string" else 7 for of in kinds.values()])], ", ".join(["host_id string", *map(" ".join, kinds.items())]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with many hosts
    try:
        made = documents.node_status(nodes, spaces, ages, "2024-02-01 00:00:00")
        plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
        found = {r.host_id: json.loads(r.status) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    last = next(i for i, line in enumerate(plan) if "Join" in line)
    assert "Broadcast" in plan[last] and not [line for line in plan[:last] if "Exchange" in line]
    assert list(found["h1"])[:6] == ["cluster", "rack", "dc", "host_id", "host_id_map", "keyspaces"] and all(len(s) == 26 for s in found.values())
    assert found["h1"]["host_id_map"] == {"h1": 'd/r"1', "h2": "d"} == found["h2"]["host_id_map"]
    assert (found["h1"]["live_nodes"], found["h2"]["unreachable_nodes"], found["h3"]["live_nodes"]) == (["h1"], ["h2"], ["h3"])
    assert (found["h1"]["keyspaces"], found["h3"]["keyspaces"], found["h2"]["rack"]) == (["k1", "k2"], None, None)
    assert (found["h1"]["last_sst_backup"], found["h2"]["last_sst_backup"], found["h3"]["last_cl_backup_age_mins"]) == ("7", "(null)", -1)


def test_the_lists_of_nodes_are_parsed_once(spark, sf):
    plan = node_status(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    whole = [i for i, line in enumerate(plan) if "from_json(" in line and "status#" in line]
    assert whole and all("Limit 1" in "".join(plan[i + 1 : i + 4]) for i in whole)
    assert not [line for line in plan if "json_object_keys(status#" in line]


def test_status_records_are_read_as_they_stand(spark):
    names = "cluster string, dc string, rack string, host_id string, live boolean, heap_used_bytes bigint, heap_max_bytes bigint"
    hosts = ['h"1', "h\\2", "live_nodes", '"live_nodes":["h"]', "é{", ',"keyspaces":', "host_id_map"]
    nodes = spark.createDataFrame([(c, "d,", f'r"{i}', h, i % 3 > 0, 1 << 20, i) for i, h in enumerate(hosts) for c in ("a", "b") if c == "a" or i % 2], names)
    nodes = nodes.withColumn("host_id", F.when(F.col("cluster") == "b", F.concat("host_id", F.lit("\n"))).otherwise(F.col("host_id")))
    spaces = spark.createDataFrame([("a", "k2"), ("a", "live_nodes")], "cluster string, keyspace string")
    kinds = {f"last_{kind}_backup{part}": "string" if part == "" else "bigint" for kind in ("snap", "sst", "cl") for part in ("", "_filecount", "_age_mins")}
    ages = spark.createDataFrame([], ", ".join(["host_id string", *map(" ".join, kinds.items())]))
    made = [(r.host_id, r.status) for r in documents.node_status(nodes, spaces, ages, "2024-02-01 00:00:00").collect()]
    given = json.loads(made[0][1])
    for lists in ({"live_nodes": []}, {"host_id_map": {}, "keyspaces": []}, {"live_nodes": given["unreachable_nodes"], "unreachable_nodes": given["live_nodes"], "keyspaces": None}):
        made += [(made[0][0], json.dumps(given | lists)), (made[0][0], json.dumps(given | lists, separators=(",", ":")))]
    made += [("other", made[0][1]), (None, made[1][1]), ("none", None), ("bare", '{"keyspaces":["k2","live_nodes"]}')]
    plain = ["cluster", "rack", "dc", "heap_usage", "heap_usage_perc", "last_sst_backup_filecount"]
    expected = []
    for host, status in made:
        v = json.loads(status or "{}")
        sizes = [None if v.get(n) is None else len(v[n]) for n in documents.LISTS]
        expected.append((host, *[v.get(n) for n in plain], *sizes, (v.get("host_id_map") or {}).get(host), len(v) if status else None))
    for first in (*range(0, len(made), 3), len(made) - 1):  # whichever record it learns the lists from
        shown = made[first:] + made[:first]
        frame = spark.createDataFrame(shown, "host_id string, status string").coalesce(1)
        got = documents.read_node_status(frame, STATUS).select("host_id", *plain, *documents.LISTS, "own_address", "fields").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    with pytest.raises(Exception, match="MALFORMED"):
        documents.read_node_status(spark.createDataFrame([made[0], ("h", '{"cluster": ')], "host_id string, status string").coalesce(1), STATUS).collect()
