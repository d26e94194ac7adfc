"""Ordered operators give the same result however finely hot keys are cut."""

import random

import pytest
from pyspark.sql import functions as F

from strongbox.operators import metrics, runs, transfer
from strongbox.operators.ordered import admit, running, slice_hot_keys
from strongbox.queries.registry import view


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hot_rows(spark, seed=1, n=600):
    """A third of the rows on one key, a third of those in one instant, and a null key."""
    rng = random.Random(seed)
    data = []
    for seq in range(n):
        key = rng.choice(["hot", "hot", "a", "b", None, "c"])
        t = 500_000 if key == "hot" and rng.random() < 0.33 else rng.randrange(1_000_000)
        data.append((key, t, seq, rng.randrange(100)))
    return spark.createDataFrame(data, "k string, t bigint, seq bigint, v bigint"), data


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("include_current", [False, True])
def test_running_against_brute_force(spark, descending, include_current):
    df, data = hot_rows(spark)
    measures = {"s": ("sum", F.col("v")), "hi": ("max", F.struct("v", "seq")), "lo": ("min", F.col("t"))}
    out = running(df, ["k"], ["t", "seq"], measures, include_current=include_current, descending=descending, max_rows=10)
    expected = []
    for k, t, seq, v in data:
        before = [r for r in data if r[0] == k and ((r[1:3] > (t, seq)) if descending else (r[1:3] < (t, seq)))]
        if include_current:
            before.append((k, t, seq, v))
        s = sum(r[3] for r in before) if before else None
        hi = max(((r[3], r[2]) for r in before), default=None)
        lo = min((r[1] for r in before), default=None)
        expected.append((k, t, seq, v, s, hi, lo))
    assert rows_of(out) == sorted(expected, key=repr)


def test_slices_follow_the_order_and_are_small(spark):
    df, _ = hot_rows(spark)
    sliced = slice_hot_keys(df, ["k"], ["t", "seq"], 10)
    assert len(sliced.slices) > 1
    assert sliced.rows.groupBy(*sliced.group).count().agg(F.max("count")).first()[0] <= 10
    ordered = [tuple(r) for r in sliced.rows.where("k = 'hot'").orderBy("t", "seq").select(*sliced.slices).collect()]
    assert ordered == sorted(ordered)


def test_no_hot_key_means_no_slices(spark):
    df, _ = hot_rows(spark)
    assert slice_hot_keys(df, ["k"], ["t", "seq"], 1000).slices == []


def walk(rows, after, busy):
    """Admission one row at a time."""
    admitted, held = [], {}
    for k, start, seq, hold, exempt in sorted(rows, key=lambda r: (r[1], r[2])):
        if exempt:
            admitted.append((k, start, seq, True))
            continue
        until = held.get(k, busy.get(k))
        free = until is None or (start > until if after else start >= until)
        if free:
            held[k] = hold
        admitted.append((k, start, seq, free))
    return sorted(admitted, key=repr)


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("seed,longest", [(1, 2_000), (2, 50_000), (3, 900_000), (4, 0)])
def test_admission_against_brute_force(spark, after, seed, longest):
    rng = random.Random(seed)
    _, data = hot_rows(spark, seed)
    rows = [(k, t, seq, t + (rng.randrange(longest) if longest else 0), rng.random() < 0.1) for k, t, seq, _ in data]
    busy = {"hot": 100_000, "a": 400_000}
    df = spark.createDataFrame([(*r, busy.get(r[0])) for r in rows], "k string, t bigint, seq bigint, hold bigint, exempt boolean, busy bigint")
    for max_rows in (10, 100_000):
        out = admit(df, ["k"], "t", "hold", "seq", after=after, busy="busy", exempt="exempt", max_rows=max_rows)
        assert rows_of(out.select("k", "t", "seq", "admitted")) == walk(rows, after, busy)


@pytest.mark.parametrize("max_rows", [7, 60])
def test_operators_do_not_depend_on_the_cut(spark, sf, max_rows):
    ops, transfers = view(spark, sf, "v_ops"), view(spark, sf, "v_transfers")
    points = ops.withColumn("elapsed_ms", F.col("secs") * 1000)
    finished = F.timestamp_add("SECOND", F.col("secs"), F.col("started").cast("timestamp")).cast("timestamp_ntz")
    timed = ops.withColumns({"finished": F.when(F.col("finishes"), finished), "snapshot": F.col("started").cast("string")})
    increments, snapshots = timed.where("op_type in ('SST', 'CL')").select("op_id", "host_id", "started"), timed.where("op_type = 'SNAP'")
    states = ops.select("host_id", F.when(F.col("finishes"), "complete").otherwise("inprogress").alias("status"), F.col("started").alias("ts"), F.col("op_id").alias("seq"))
    for plain, cut in [
        (runs.conflicting_operations(ops), runs.conflicting_operations(ops, max_rows=max_rows)),
        (runs.admit_exclusive(ops), runs.admit_exclusive(ops, max_rows=max_rows)),
        (runs.attach_to_snapshot(increments, snapshots), runs.attach_to_snapshot(increments, snapshots, max_rows=max_rows)),
        (runs.backup_runs(states, ["host_id"]), runs.backup_runs(states, ["host_id"], max_rows=max_rows)),
        (transfer.transfer_progress(transfers), transfer.transfer_progress(transfers, max_rows=max_rows)),
        (transfer.throttle_progress(transfers, 3_600_000), transfer.throttle_progress(transfers, 3_600_000, max_rows=max_rows)),
        (metrics.execution_times(points, ["op_type"]), metrics.execution_times(points, ["op_type"], max_rows=max_rows)),
    ]:
        assert rows_of(plain.select(*plain.columns)) == rows_of(cut.select(*plain.columns))
