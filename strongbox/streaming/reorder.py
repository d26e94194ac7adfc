"""Throttled progress of files whose events come out of order: one stateful processor per file.

Events wait until the watermark has passed them and are then taken in time order, so the result does not
depend on the order of arrival within the delay. What is kept of a file is the bytes moved, until when
lines are held back, and the events that wait; all of it is Spark's own state, with a timer on the
earliest event that waits.
"""

from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strongbox.functions.status import bytes_to_mb
from strongbox.operators.ordered import micros
from strongbox.schemas import PROGRESS_INTERVAL_MS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINES = "file_id bigint, seq bigint, t bigint, kind string, bytes bigint, bytes_done bigint"
WAITING = "t array<bigint>, seq array<bigint>, kind array<string>, bytes array<bigint>"
BLOCK = 10_000  # events


class Progress(StatefulProcessor):
    """Shows BYTES only when the interval has passed since the last one shown, other kinds always.

    Every call of the state goes through a socket, so events wait in blocks: up to BLOCK events of a file
    that come together are one value of the state.
    """

    def __init__(self, wait: int, counted: tuple[str, ...]):
        self.wait, self.counted = wait, counted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "moved bigint, until bigint")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        earliest, rows = None, iter(rows)
        while events := [(r["t"], r["seq"], r["kind"], r["bytes"]) for r in islice(rows, BLOCK)]:
            self._wait(events)
            first = min(t for t, *_ in events)
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        # An event that came again replaces the one before.
        held = {(t, seq): (kind, size) for block in self.waiting.get() for t, seq, kind, size in zip(*block, strict=True)}
        events = [(*event, *held[event]) for event in sorted(held)]
        taken = bisect_right(events, passed, key=lambda e: e[0] // 1000)
        if not taken:  # an earlier timer took them; those that are left have one of their own
            return
        moved, until = self.file.get() if self.file.exists() else (0, None)
        lines = []
        for t, seq, kind, size in events[:taken]:
            until = t + self.wait if until is None else until
            moved += (size or 0) if kind in self.counted else 0
            if kind != "BYTES" or t > until:
                lines.append(Row(file_id=key[0], seq=seq, t=t, kind=kind, bytes=size, bytes_done=moved))
                until = t + self.wait if kind == "BYTES" else until
        self.file.update((moved, until))
        self.waiting.clear()
        if taken < len(events):
            self._wait(events[taken:])
            self.handle.registerTimer(events[taken][0] // 1000)
        yield from lines

    def _wait(self, events: list[tuple]) -> None:
        for a in range(0, len(events), BLOCK):
            self.waiting.appendValue(tuple(map(list, zip(*events[a : a + BLOCK], strict=True))))


def reordered_progress_stream(
    stream: DataFrame, folder: str, delay: str, interval_ms: int = PROGRESS_INTERVAL_MS, count_parts: bool = True, trigger: dict | None = None
) -> StreamingQuery:
    """Progress lines (file_id, seq, ts, kind, bytes, bytes_done, mb) of a stream of transfer events, written
    to ``<folder>/lines``: the same as of all events in one batch.

    Events may come up to ``delay`` (an interval) behind the newest one; those that come later are not
    shown. A line is put out once the newest event is ``delay`` past it. A repeated micro-batch replaces
    its own lines. The state of this stream is kept in RocksDB, as Spark demands of such processors.
    """
    counted = ("BYTES", "PART") if count_parts else ("BYTES",)
    events = stream.select("file_id", F.col("seq").cast("bigint").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "kind", "bytes")
    keyed = events.withColumn("t", micros("ts")).withWatermark("ts", delay).groupBy("file_id")
    lines = keyed.transformWithState(Progress(interval_ms * 1000, counted), LINES, "Append", "EventTime")

    def write(batch: DataFrame, n: int) -> None:
        shown = bytes_to_mb(batch, "bytes_done").withColumn("ts", F.timestamp_micros("t"))
        shown.select("file_id", "seq", "ts", "kind", "bytes", "bytes_done", "mb").write.mode("overwrite").parquet(f"{folder}/lines/batch-{n:012d}")

    writer = lines.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    conf, before = stream.sparkSession.conf, stream.sparkSession.conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:  # a stream takes the settings over when it starts
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


SHOWN = "file_id bigint, seq bigint, ts timestamp, kind string, bytes bigint, bytes_done bigint, mb bigint"


def progress_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that have been put out."""
    return spark.read.schema(SHOWN).option("recursiveFileLookup", True).parquet(f"{folder}/lines")
