"""Progress of file transfers."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongbox.functions.status import bytes_to_mb
from strongbox.operators.ordered import MAX_GROUP_ROWS, MAX_ROWS, Sliced, admit_in, micros, running_in, slice_hot_keys
from strongbox.schemas import PROGRESS_INTERVAL_MS


def _measured(transfers: DataFrame, count_parts: bool, max_rows: int) -> Sliced:
    counted = ["BYTES", "PART"] if count_parts else ["BYTES"]
    moved = F.when(F.col("kind").isin(counted), F.col("bytes")).otherwise(F.lit(0).cast("bigint"))
    measures = {
        "bytes_done": ("sum", moved),
        "_done": ("max", (F.col("kind") == "COMPLETED").cast("int")),
        "_first": ("min", F.col("_t")),
    }
    order = ["_t", "seq"]
    sliced = slice_hot_keys(transfers.withColumn("_t", micros("ts")), ["file_id"], order, max_rows)
    return running_in(sliced, order, measures)


def transfer_progress(transfers: DataFrame, count_parts: bool = True, max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds the bytes and whole MB moved so far, and whether the file is completed.

    A finished part repeats bytes that were reported while it moved; ``count_parts=False`` leaves
    parts out.
    """
    rows = _measured(transfers, count_parts, max_rows).rows.withColumn("completed", F.col("_done") == 1)
    return bytes_to_mb(rows, "bytes_done").select(*transfers.columns, "bytes_done", "completed", "mb")


def throttle_progress(
    transfers: DataFrame,
    interval_ms: int = PROGRESS_INTERVAL_MS,
    count_parts: bool = True,
    earlier: DataFrame | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The progress lines of each file: BYTES only if more than the interval has passed.

    The interval runs from the last BYTES line, or from the first event of the file. Other kinds
    are always shown and do not restart it. ``earlier`` holds what former batches left behind:
    file_id, bytes_before and busy (microseconds).
    """
    sliced = _measured(transfers, count_parts, max_rows)
    rows = sliced.rows
    wait = interval_ms * 1000
    if earlier is None:
        rows = rows.withColumn("_wait_until", F.col("_first") + wait)
    else:
        rows = rows.join(earlier, "file_id", "left").withColumns(
            {
                "bytes_done": F.col("bytes_done") + F.coalesce("bytes_before", F.lit(0).cast("bigint")),
                "_wait_until": F.coalesce("busy", F.col("_first") + wait),
            }
        ).drop("bytes_before", "busy")
    rows = rows.withColumns({"_next": F.col("_t") + wait, "_always": F.col("kind") != "BYTES"})
    shown = admit_in(replace(sliced, rows=rows), "_t", "_next", "seq", after=True, busy="_wait_until", exempt="_always")
    return bytes_to_mb(shown, "bytes_done").where("admitted").select(*transfers.columns, "bytes_done", "mb")
