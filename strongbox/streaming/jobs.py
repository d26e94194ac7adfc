"""Streams: change-log copies, counters, state, throttled progress and exclusive admission."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strongbox.operators.ordered import micros
from strongbox.operators.runs import admit_exclusive, lock_class
from strongbox.operators.state import upsert_state
from strongbox.operators.transfer import throttle_progress
from strongbox.plans.manifest import write_copy
from strongbox.schemas import CL, PROGRESS_INTERVAL_MS
from strongbox.streaming.versioned import VersionedState

ONCE = {"availableNow": True}


def change_log_backup(
    stream: DataFrame, backup: str, checkpoint: str, snapshot: str, keyspace: str = "changes", table: str = "log", trigger: dict | None = None
) -> StreamingQuery:
    """Copies a change log below the last snapshot. Each change is copied once; the source stays.

    The copy is a partition like any other of the backup. A micro-batch is a copy of its own in it, with
    its manifest, and replaces that if it is repeated; the stream keeps its own records at ``checkpoint``
    only.
    """
    if not (snapshot or "").strip():
        raise ValueError("take a snapshot before a change-log backup")

    def copy(batch: DataFrame, n: int) -> None:
        write_copy(batch, backup, f"batch-{n:09d}", snapshot=snapshot, backup_type=CL, keyspace=keyspace, table=table)

    return stream.writeStream.foreachBatch(copy).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def stream_counters(stream: DataFrame, folder: str, window: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Count, sum and largest value of each metric and window, as they change.

    ``stream`` has ts, name and value, in any order: no point is too late, so windows stay open.
    Each batch puts out the windows it changed; ``latest_counters`` reads the last of each.
    """
    counters = (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy(F.window("ts", window).alias("w"), "name")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))
    ).select(F.col("w.start").alias("window_start"), "name", "n", "total", "largest")

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/output/batch={n:09d}")

    return (
        counters.writeStream.outputMode("update").foreachBatch(each)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or ONCE)).start()
    )


COUNTERS = "window_start timestamp, name string, n bigint, total double, largest double, batch bigint"


def latest_counters(spark, folder: str) -> DataFrame:
    """The last state of every window and metric."""
    changes = spark.read.schema(COUNTERS).parquet(f"{folder}/output")
    row = F.max_by(F.struct("n", "total", "largest"), "batch").alias("r")
    return changes.groupBy("window_start", "name").agg(row).select("window_start", "name", "r.*")


def upsert_state_stream(stream: DataFrame, folder: str, trigger: dict | None = None) -> tuple[VersionedState, StreamingQuery]:
    """Keeps the last write of every name as the stream goes on."""
    state = VersionedState(folder, stream.schema)

    def carry(batch: DataFrame, before: DataFrame, output: None) -> DataFrame:
        return upsert_state(before, batch)

    return state, state.run(stream, carry, trigger=trigger)


def throttle_progress_stream(
    stream: DataFrame, folder: str, interval_ms: int = PROGRESS_INTERVAL_MS, trigger: dict | None = None
) -> tuple[VersionedState, StreamingQuery]:
    """Progress lines of a stream whose events arrive in time order, file by file.

    What is kept of a file is the bytes moved and until when BYTES lines are held back.
    """
    state = VersionedState(folder, T.StructType.fromDDL("file_id bigint, bytes_before bigint, busy bigint"))
    wait, none = interval_ms * 1000, F.lit(0).cast("bigint")

    def emit(batch: DataFrame, before: DataFrame) -> DataFrame:
        return throttle_progress(batch, interval_ms, earlier=before)

    def carry(batch: DataFrame, before: DataFrame, lines: DataFrame) -> DataFrame:
        moved = F.sum(F.when(F.col("kind").isin("BYTES", "PART"), F.col("bytes"))).alias("moved")
        seen = batch.groupBy("file_id").agg(moved, F.min(micros("ts")).alias("first"))
        last = lines.where(F.col("kind") == "BYTES").groupBy("file_id").agg(F.max(micros("ts")).alias("shown"))
        known = seen.join(last, "file_id", "left").join(before, "file_id", "full_outer")
        return known.select(
            "file_id",
            (F.coalesce("bytes_before", none) + F.coalesce("moved", none)).alias("bytes_before"),
            F.coalesce(F.col("shown") + wait, F.col("busy"), F.col("first") + wait).alias("busy"),
        )

    return state, state.run(stream, carry, emit, trigger)


def admit_exclusive_stream(stream: DataFrame, folder: str, trigger: dict | None = None) -> tuple[VersionedState, StreamingQuery]:
    """Admission of operations that arrive in order of their start.

    What is kept is until when each host and lock class is held.
    """
    state = VersionedState(folder, T.StructType.fromDDL("host_id string, lock_class string, busy bigint"))

    def emit(batch: DataFrame, before: DataFrame) -> DataFrame:
        known = batch.withColumn("lock_class", lock_class("op_type")).join(before, ["host_id", "lock_class"], "left")
        return admit_exclusive(known, busy="busy").drop("busy")

    def carry(batch: DataFrame, before: DataFrame, decided: DataFrame) -> DataFrame:
        ends = F.max(micros("started") + F.col("secs") * 1_000_000).alias("held")
        held = decided.where("admitted").groupBy("host_id", "lock_class").agg(ends)
        return held.join(before, ["host_id", "lock_class"], "full_outer").withColumn("busy", F.coalesce("held", "busy"))

    return state, state.run(stream, carry, emit, trigger)
