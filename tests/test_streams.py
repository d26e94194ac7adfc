"""Streams over several files, and over a restart, give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from strongbox.operators import runs, state, transfer
from strongbox.queries.registry import stream_view, table, view
from strongbox.streaming import jobs

FILES = 4


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def parts(spark, sf, tmp_path):
    """The events in time order, cut into files; the later ones are added by the test."""
    events = table(spark, sf, "events").toPandas().sort_values(["ts", "event_id"])
    cut = -(-len(events) // FILES)

    def add(i):
        part = events.iloc[i * cut : (i + 1) * cut].reset_index(drop=True)
        part["ts"] = part["ts"].astype("datetime64[us]")
        part.to_parquet(tmp_path / f"events{i}.parquet")

    return add


def run_all(parts, start):
    """Two files, then a restart from the checkpoint with the others."""
    for group in ([0, 1], [2, 3]):
        for i in group:
            parts(i)
        out = start()
        (out[1] if isinstance(out, tuple) else out).awaitTermination()
    return out


def test_state(spark, sf, tmp_path, parts):
    parts(0)
    result, _ = run_all(parts, lambda: jobs.upsert_state_stream(stream_view(spark, str(tmp_path), "v_state", 1), str(tmp_path / "s")))
    assert rows_of(result.last(spark)) == rows_of(state.latest_state(view(spark, sf, "v_state")))
    assert len(list((tmp_path / "s/state").iterdir())) == 2


def test_throttling(spark, sf, tmp_path, parts):
    parts(0)
    start = lambda: jobs.throttle_progress_stream(stream_view(spark, str(tmp_path), "v_transfers", 1), str(tmp_path / "s"), 7_200_000)
    result, _ = run_all(parts, start)
    expected = transfer.throttle_progress(view(spark, sf, "v_transfers"), 7_200_000)
    assert rows_of(result.output(spark, expected.schema)) == rows_of(expected)


def test_admission(spark, sf, tmp_path, parts):
    parts(0)
    result, _ = run_all(parts, lambda: jobs.admit_exclusive_stream(stream_view(spark, str(tmp_path), "v_ops", 1), str(tmp_path / "s")))
    expected = runs.admit_exclusive(view(spark, sf, "v_ops"))
    assert rows_of(result.output(spark, expected.schema)) == rows_of(expected)


def test_a_repeated_batch_changes_nothing(spark, sf, tmp_path, parts):
    parts(0)
    start = lambda: jobs.upsert_state_stream(stream_view(spark, str(tmp_path), "v_state", 1), str(tmp_path / "s"))
    result, _ = run_all(parts, start)
    before = rows_of(result.last(spark))
    commits = sorted((tmp_path / "s/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for stale in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        stale.unlink(missing_ok=True)
    result, run = start()
    run.awaitTermination()
    assert rows_of(result.last(spark)) == before


def test_counters_and_change_log(spark, sf, tmp_path, parts):
    from pyspark.sql import functions as F

    from strongbox.queries.registry import stream

    parts(0)
    points = lambda: stream(spark, str(tmp_path), "events", 1).select("ts", F.col("event_type").alias("name"), "value")
    run_all(parts, lambda: jobs.stream_counters(points(), str(tmp_path / "c")))
    run_all(parts, lambda: jobs.change_log_backup(stream(spark, str(tmp_path), "events", 1), str(tmp_path / "b"), str(tmp_path / "cp"), "s1"))
    events = table(spark, sf, "events")
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("w"), F.col("event_type").alias("name")).count()
    found = jobs.latest_counters(spark, str(tmp_path / "c")).select("window_start", "name", "n")
    assert rows_of(found) == rows_of(batch)
    copied = spark.read.parquet(str(tmp_path / "b"))
    assert rows_of(copied.select(*events.columns)) == rows_of(events)
    assert rows_of(copied.select("snapshot", "backup_type").distinct()) == [("s1", "CL")]
    with pytest.raises(ValueError):
        jobs.change_log_backup(points(), "x", "y", " ")


def test_counters_in_any_order(spark, sf, tmp_path, parts):
    """The newest file first, one file a batch: no point is too late."""
    for i in reversed(range(FILES)):
        parts(i)
        points = stream_view_of(spark, tmp_path)
        jobs.stream_counters(points, str(tmp_path / "out")).awaitTermination()
    events = table(spark, sf, "events")
    found = jobs.latest_counters(spark, str(tmp_path / "out"))
    assert found.agg(F.sum("n")).first()[0] == events.count()
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").count()
    assert found.count() == hours.count()


def stream_view_of(spark, folder):
    from strongbox.queries.registry import stream

    return stream(spark, str(folder), "events").select("ts", F.col("event_type").alias("name"), "value")
