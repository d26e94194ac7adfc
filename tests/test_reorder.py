"""Throttled progress of events that come out of order, against one batch of all of them."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from strongbox.operators import transfer
from strongbox.streaming.reorder import Progress, progress_lines, reordered_progress_stream

FIELDS = "file_id bigint, seq bigint, ts timestamp, kind string, bytes bigint"
START = datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_events_in_any_order_within_the_delay(spark, tmp_path):
    draw, source, place = random.Random(6), str(tmp_path / "in"), str(tmp_path / "out")
    events = []
    for seq in range(300):  # one file has a third of the events
        kind = draw.choice(["STARTED", "BYTES", "BYTES", "BYTES", "PART", "COMPLETED"])
        events.append((draw.choice([1, 1, 2, 3, 4]), seq, START + timedelta(seconds=seq * 7 + draw.randrange(3)), kind, draw.randrange(10**7) if kind in ("BYTES", "PART") else None))
    arrived = sorted(events, key=lambda e: e[2] + timedelta(seconds=draw.randrange(-200, 200)))
    closing = [(99, 10**6, START + timedelta(days=1), "STARTED", None)]

    def run():
        stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(source)
        reordered_progress_stream(stream, place, "10 minutes", 20_000).awaitTermination()

    for at in range(0, 300, 100):
        for part in (arrived[at : at + 50], arrived[at + 50 : at + 100]):
            spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(source)
        run()  # and a restart
    spark.createDataFrame(closing, FIELDS).coalesce(1).write.mode("append").parquet(source)
    run()
    found = progress_lines(spark, place).where("file_id <> 99")
    expected = transfer.throttle_progress(spark.createDataFrame(events, FIELDS), 20_000)
    names = ["file_id", "seq", "ts", "kind", "bytes", "bytes_done", "mb"]
    assert rows_of(found.select(*names)) == rows_of(expected.select(*names)) and 0 < found.count() < 300
    late = [(1, 5000, START, "STARTED", None)]  # a day behind: not shown, and nothing else changes
    spark.createDataFrame(late, FIELDS).coalesce(1).write.mode("append").parquet(source)
    run()
    assert progress_lines(spark, place).where("file_id <> 99").count() == found.count()
    assert progress_lines(spark, place).agg(F.countDistinct("file_id")).first()[0] >= 4


class Calls:
    """A handle and the state of one file, which count the calls."""

    def __init__(self):
        self.calls, self.timers, self.blocks = 0, [], []

    def getValueState(self, name, schema):
        return Value()

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def appendValue(self, block):
        self.calls += 1
        self.blocks.append(block)

    def get(self):
        self.calls += 1
        return iter(self.blocks)

    def clear(self):
        self.calls, self.blocks = self.calls + 1, []

    def getCurrentWatermarkInMs(self):
        return 15_000


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_many_events_of_a_file_take_few_calls_of_the_state():
    state, progress, wait = Calls(), Progress(10**7, ("BYTES",)), 10**7
    progress.init(state)
    events = [Row(t=i * 1000, seq=i, kind="BYTES" if i % 5 else "PART", bytes=None if i % 7 == 0 else 1) for i in range(25_000)]
    again = Row(t=3000, seq=3, kind="STARTED", bytes=5)  # replaces the event before
    arrived = [*random.Random(2).sample(events, len(events)), again]
    assert list(progress.handleInputRows((8,), iter(arrived), state)) == []
    assert state.timers == [0] and state.calls <= 4
    lines = list(progress.handleExpiredTimer((8,), state, None))
    moved, until, expected = 0, wait, []
    for e in (again if e.seq == 3 else e for e in events[:15_001]):
        moved += (e.bytes or 0) if e.kind == "BYTES" else 0
        if e.kind != "BYTES" or e.t > until:
            expected.append((8, e.seq, e.t, e.kind, e.bytes, moved))
            until = e.t + wait if e.kind == "BYTES" else until
    assert [tuple(line) for line in lines] == expected and any(line[3] == "BYTES" for line in expected)
    assert state.timers == [0, 15_001] and state.calls <= 8
    assert [t for block in state.blocks for t in block[0]] == [e.t for e in events[15_001:]]
