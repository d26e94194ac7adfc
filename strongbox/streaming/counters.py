"""Counters of a stream that need no state: each micro-batch leaves its own sums, which add up.

Counts, sums and largest values of a window can be put together from those of its parts, so a batch writes
what it has and nothing is kept open: a point may come at any time. Compaction puts the batches together
that can no longer be repeated, so that reading does not take longer as the stream goes on. Points that
are later than ``lateness`` are counted as well, and put aside to be looked at.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strongbox.filesystem import delete_folder, exists, folders

SUMS = "window_start timestamp, name string, n bigint, total double, largest double"
LATE = "ts timestamp, name string, value double, behind_secs bigint"
MARKS = "newest timestamp"
ONCE = {"availableNow": True}


def windowed_counters(stream: DataFrame, folder: str, window: str = "1 hour", lateness: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Count, sum and largest value of each metric and window. ``stream`` has ts, name and value, in any order.

    A repeated micro-batch replaces what it wrote. With ``lateness`` (an interval), points that lie
    further than that behind the newest point of earlier batches are also written to ``late_points``.
    """
    points = stream.select(F.col("ts").cast("timestamp").alias("ts"), "name", F.col("value").cast("double").alias("value"))

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        sums = batch.groupBy(F.window("ts", window).start.alias("window_start"), "name")
        _write(sums.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest")), f"{folder}/sums", n)
        if lateness is not None:
            newest = _newest(spark, folder, n)
            if newest is not None:
                mark = F.lit(newest).cast("timestamp")
                behind = batch.where(F.col("ts") < mark - F.expr(f"interval {lateness}"))
                _write(behind.withColumn("behind_secs", F.timestamp_diff("SECOND", "ts", mark)), f"{folder}/late", n)
        _write(batch.agg(F.max("ts").alias("newest")), f"{folder}/marks", n)
        batch.unpersist()

    return points.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or ONCE)).start()


def _write(rows: DataFrame, place: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{place}/batch-{batch:012d}")


def _batches(place: str) -> dict[int, str]:
    """The batches that were written to their end."""
    found = {int(f.rstrip("/").rsplit("-", 1)[-1]): f for f in folders(place)}
    return {n: f for n, f in sorted(found.items()) if exists(f"{f}/_SUCCESS")}


def _newest(spark: SparkSession, folder: str, before: int) -> str | None:
    """The time of the newest point of earlier batches, as text. Marks of compacted batches are one."""
    places = [f for n, f in _batches(f"{folder}/marks").items() if n < before]
    return spark.read.schema(MARKS).parquet(*places).agg(F.max("newest").cast("string")).first()[0] if places else None


def _together(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window_start", "name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest"))


def read_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of every window and metric, from the last compaction and the batches since."""
    compact = _batches(f"{folder}/compact")
    upto = max(compact, default=-1)
    places = [f for n, f in _batches(f"{folder}/sums").items() if n > upto] + ([compact[upto]] if compact else [])
    return _together(spark.read.schema(SUMS).parquet(*places)) if places else spark.createDataFrame([], SUMS)


def late_points(spark: SparkSession, folder: str) -> DataFrame:
    """The points that came later than the lateness, and by how much."""
    places = list(_batches(f"{folder}/late").values())
    return spark.read.schema(LATE).parquet(*places) if places else spark.createDataFrame([], LATE)


def compact_counters(spark: SparkSession, folder: str) -> int:
    """Puts all batches but the newest, which may be repeated, into one table; returns how many. What was
    put together is deleted after the table is complete: a compaction that broke off is done again, and
    readers take either the batches or the table that replaces them."""
    sums, compact = _batches(f"{folder}/sums"), _batches(f"{folder}/compact")
    done = max(compact, default=-1)
    ready = [n for n in sums if done < n < max(sums)]
    if ready:
        places = [sums[n] for n in ready] + ([compact[done]] if compact else [])
        _write(_together(spark.read.schema(SUMS).parquet(*places)), f"{folder}/compact", max(ready))
        done = max(ready)
    for place in [f for n, f in sums.items() if n <= done] + [f for n, f in compact.items() if n < done]:
        delete_folder(place)
    marks = {n: f for n, f in _batches(f"{folder}/marks").items() if n <= done}
    if len(marks) > 1:  # the mark of the last of them stands for all
        newest = spark.read.schema(MARKS).parquet(*marks.values()).agg(F.max("newest").alias("newest"))
        rows = spark.createDataFrame(newest.collect(), MARKS)
        _write(rows, f"{folder}/marks", max(marks))
        for n, place in marks.items():
            if n < max(marks):
                delete_folder(place)
    return len(ready)
