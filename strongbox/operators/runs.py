"""What happened to operations: retries, runs, conflicts, the snapshot they belong to."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.operators.ordered import MAX_GROUP_ROWS, MAX_ROWS, admit, micros, running
from strongbox.schemas import CL, MAX_ATTEMPTS, SNAP, SST

# Operations that exclude one another share a lock class.
LOCK_CLASSES = {SNAP: "SNAP+RESTORE", "RESTORE": "SNAP+RESTORE", SST: SST, CL: CL}


def lock_class(op_type: str) -> Column:
    return F.coalesce(*[F.when(F.col(op_type) == t, F.lit(c)) for t, c in LOCK_CLASSES.items()])


def attempt_outcomes(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per upload: the attempt that won, retries before it, and whether all were used up.

    Attempts stop at the first success; attempts beyond the limit do not count. An attempt that
    was logged twice counts once.
    """
    counted = F.col("attempt_no") <= max_attempts
    won = F.min(F.when(counted & F.col("ok"), F.col("attempt_no"))).cast("bigint")
    seen = F.max(F.when(counted, F.col("attempt_no"))).cast("bigint")
    made = attempts.groupBy("upload_id").agg(won.alias("won_at"), seen.alias("seen"))
    attempts_made = F.coalesce("won_at", "seen", F.lit(0).cast("bigint"))
    exhausted = F.col("won_at").isNull() & (F.col("seen") >= max_attempts)
    return made.select(
        "upload_id",
        "won_at",
        attempts_made.alias("attempts_made"),
        F.greatest(attempts_made - 1, F.lit(0).cast("bigint")).alias("retries"),
        F.coalesce(exhausted, F.lit(False)).alias("exhausted"),
        F.when(F.col("won_at").isNotNull(), "uploaded").when(exhausted, "failed").otherwise("unfinished").alias("outcome"),
    )


def backup_runs(states: DataFrame, keys: Sequence[str], run: str | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per started backup: when it started and finished, or that it is incomplete.

    ``states`` has the keys, status, ts and seq. With a ``run`` id, states of one run belong
    together. Without one, a run is complete if the next state of its keys says so.
    """
    if run is not None:
        by = [*keys, run]
        ends = states.groupBy(*by).agg(
            F.min(F.when(F.col("status") == "inprogress", F.col("ts"))).alias("started"),
            F.min(F.when(F.col("status") == "complete", F.col("ts"))).alias("finished"),
        ).where(F.col("started").isNotNull())
    else:
        by = [*keys, "seq"]
        following = {"_next": ("max", F.struct(-F.col("_t"), -F.col("seq"), F.col("status"), F.col("ts")))}
        ends = running(
            states.withColumn("_t", micros("ts")), keys, ["_t", "seq"], following,
            include_current=False, descending=True, max_rows=max_rows,
        ).where(F.col("status") == "inprogress").select(
            *by, F.col("ts").alias("started"), F.when(F.col("_next.status") == "complete", F.col("_next.ts")).alias("finished")
        )
    seconds = F.floor((micros("finished") - micros("started")) / 1_000_000)
    outcome = F.when(F.col("finished").isNull(), "incomplete").otherwise("complete")
    return ends.withColumns({"seconds": seconds, "outcome": outcome})


def attach_to_snapshot(
    increments: DataFrame, snapshots: DataFrame, complete_only: bool = True, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Adds the snapshot that each increment belongs to: the latest one of its host.

    ``increments`` has host_id, op_id, started; ``snapshots`` has host_id, snapshot, started and
    finished. A snapshot counts from when it finished, or with ``complete_only=False`` from when
    it started, finished or not. Without one the increment is not ``accepted``.
    """
    usable = F.col("finished" if complete_only else "started")
    since = snapshots.select("host_id", usable.alias("_at"), "snapshot").where(usable.isNotNull())
    names = since.groupBy("host_id", "_at").agg(F.max("snapshot").alias("_snapshot"))
    rows = (
        increments.withColumn("_at", F.col("started"))
        .withColumns({"_is_op": F.lit(1), "_seq": F.col("op_id").cast("bigint")})
        .unionByName(names.withColumns({"_is_op": F.lit(0), "_seq": F.lit(0).cast("bigint")}), allowMissingColumns=True)
        .withColumn("_t", micros("_at"))
    )
    latest = {"_latest": ("max", F.when(F.col("_is_op") == 0, F.struct("_t", "_snapshot")))}
    found = running(rows, ["host_id"], ["_t", "_is_op", "_seq"], latest, max_rows=max_rows)
    snapshot = F.col("_latest._snapshot")
    return found.where(F.col("_is_op") == 1).select(
        *increments.columns, snapshot.alias("snapshot"), snapshot.isNotNull().alias("accepted")
    )


def _timed(operations: DataFrame) -> DataFrame:
    """Operations that take a lock, with start and end in microseconds."""
    return operations.withColumns(
        {"lock_class": lock_class("op_type"), "_start": micros("started"), "_end": micros("started") + F.col("secs") * 1_000_000}
    ).where(F.col("lock_class").isNotNull())


def conflicting_operations(operations: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Operations that started while another of their host and lock class was still running.

    One row per such operation, however many it met: how many were running, and the one that
    ends last. Pairs are never formed: starts and ends are swept in time order.
    """
    ops = _timed(operations)
    sweep = ops.withColumn(
        "_point",
        F.explode(
            F.array(
                F.struct(F.col("_start").alias("at"), F.lit(1).alias("begins")),
                F.struct(F.col("_end").alias("at"), F.lit(0).alias("begins")),
            )
        ),
    ).withColumns({"_at": F.col("_point.at"), "_begins": F.col("_point.begins")}).drop("_point")
    sweep = sweep.where((F.col("_begins") == 1) | (F.col("_end") > F.col("_start")))
    lasting = F.col("_end") > F.col("_start")
    measures = {
        "n_running": ("sum", F.when(~lasting, 0).when(F.col("_begins") == 1, 1).otherwise(-1).cast("bigint")),
        "_blocker": ("max", F.when(lasting & (F.col("_begins") == 1), F.struct("_end", "op_id"))),
    }
    met = running(sweep, ["host_id", "lock_class"], ["_at", "_begins", "op_id"], measures, include_current=False, max_rows=max_rows)
    return met.where((F.col("_begins") == 1) & (F.col("n_running") > 0)).select(
        "op_id",
        "host_id",
        "lock_class",
        "started",
        "n_running",
        F.col("_blocker.op_id").alias("blocker_op_id"),
        F.floor((F.col("_blocker._end") - F.col("_start")) / 1_000_000).alias("blocked_secs"),
    )


def admit_exclusive(operations: DataFrame, busy: str | None = None, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Adds ``admitted``: per host and lock class one operation at a time, others are rejected.

    ``busy`` names a column with the microsecond until which earlier batches hold the lock.
    """
    ops = _timed(operations)
    return admit(ops, ["host_id", "lock_class"], "_start", "_end", "op_id", busy=busy, max_rows=max_rows).drop("_start", "_end")
