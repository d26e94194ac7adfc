"""Backup runs over hosts, keyspaces and tables that go on where they stopped, and restores of a keyspace.

The unit of a run is a table of a host. Below the root, every host has a backup of its own (``host=<id>``),
and ``_runs`` has the states that units went through. A run that is started again skips what the states say
is complete, takes over a copy that was finished just before the run died, and copies the rest. The service
state that ages and checks are taken from is derived from the same states.
"""

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.filesystem import exists, folders
from strongbox.operators.validate import drop_denied_tables, expand_keyspaces
from strongbox.plans.backup import TABLES_AT_A_TIME, complete, snapshot_backup
from strongbox.plans.changes import change_backup, increment_at, restore_changes
from strongbox.plans.manifest import read_manifest, schemas
from strongbox.plans.restore import restore_backup
from strongbox.schemas import CL_STATE, SNAP, SNAPSHOT_STATE, SST, SST_STATE, UNKNOWN_NUMBER
from strongbox.sources.files import _escaped

UNIT = ["host_id", "keyspace", "table"]
INPROGRESS, COMPLETE, FAILED = "inprogress", "complete", "failed"
Source = Callable[[str, str, str], DataFrame]

STATES = T.StructType(
    [
        T.StructField("backup_type", T.StringType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("files_count", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("problem", T.StringType()),
        T.StructField("taken", T.TimestampType()),
        T.StructField("written", T.TimestampType()),
        *[T.StructField(n, T.StringType()) for n in ("run", *UNIT)],
    ]
)


class BackupRunFailed(Exception):
    """Some units of a run could not be copied; the others were."""


def _aware(at: datetime | None) -> datetime | None:
    """A time without a zone is in UTC."""
    return at.replace(tzinfo=UTC) if at is not None and at.tzinfo is None else at


def host_backup(root: str, host_id: str) -> str:
    """The backup of one host."""
    if not (host_id or "").strip():
        raise ValueError("a backup needs a host")
    return f"{root}/host={_escaped(host_id)}"


def run_states(spark: SparkSession, root: str) -> DataFrame:
    """All states that units of runs went through, one row each."""
    place = f"{root}/_runs"
    if not exists(place):
        return spark.createDataFrame([], STATES)
    return spark.read.schema(STATES).option("basePath", place).parquet(place)


def last_states(states: DataFrame) -> DataFrame:
    """The last state of every unit of every run."""
    rest = [c for c in states.columns if c not in ("run", *UNIT)]
    last = states.groupBy("run", *UNIT).agg(F.max_by(F.struct(*rest), F.struct("attempt", F.col("status") != INPROGRESS, "written")).alias("s"))
    return last.select("run", *UNIT, "s.*")


def units_to_do(states: DataFrame, run: str, requests: DataFrame, tables: DataFrame) -> DataFrame:
    """The units of a run that are not complete, with the attempts made so far: host_id, keyspace, table,
    attempts. ``requests`` has host_id and keyspace, where ``*`` stands for every keyspace that the host
    has; ``tables`` has the known units. Tables that are never backed up are left out."""
    known = drop_denied_tables(tables.select(*UNIT).distinct())
    wanted = expand_keyspaces(requests.select("host_id", "keyspace").distinct(), known).distinct()
    done = last_states(states.where(F.col("run") == run)).select(*UNIT, "status", "attempt")
    left = known.join(wanted, ["host_id", "keyspace"], "left_semi").join(done, UNIT, "left")
    return left.where(~F.col("status").eqNullSafe(COMPLETE)).select(*UNIT, F.coalesce("attempt", F.lit(0)).alias("attempts"))


def run_backup(
    spark: SparkSession, root: str, run: str, requests: DataFrame, tables: DataFrame, source: Source, *,
    snapshot: str, backup_type: str = SNAP, keys: Callable[[str, str], Sequence[str]] | None = None, at: datetime | None = None,
) -> DataFrame:
    """Copies every unit that the run has not completed; returns the last state of each of its units.

    ``source(host_id, keyspace, table)`` gives the rows of a unit as they are now. A run of type SNAP takes
    ``snapshot``, one of type SST records changes below it, by ``keys(keyspace, table)``, for the time
    ``at``, which a run that is started again must repeat. Some units are copied at a time, and one that
    fails does not stop the others; the failures are raised at the end, and the run may be called again.
    """
    if backup_type not in (SNAP, SST) or (backup_type == SST and (keys is None or at is None)):
        raise ValueError("a run takes snapshots, or increments by keys and time")

    def copy(host_id: str, keyspace: str, table: str) -> dict[str, str]:
        place, parts = host_backup(root, host_id), {"snapshot": snapshot, "backup_type": backup_type, "keyspace": keyspace, "table": table}
        if backup_type == SNAP:
            if not complete(place, **parts):
                snapshot_backup(source(host_id, keyspace, table), place, snapshot, keyspace, table)
            return parts | {"copy": "whole"}
        taken = increment_at(spark, place, at, **parts)
        if taken is None:
            change_backup(source(host_id, keyspace, table), place, keyspace, table, keys(keyspace, table), at, snapshot)
            taken = increment_at(spark, place, at, **parts)
        return parts | {"copy": taken or "none"}  # no change is no increment

    def attempt(unit: Row) -> str | None:
        number, names = unit["attempts"] + 1, [unit[n] for n in UNIT]
        record(names, INPROGRESS, number, UNKNOWN_NUMBER, UNKNOWN_NUMBER, UNKNOWN_NUMBER, None)
        try:
            parts = copy(*names)
            files = read_manifest(spark, host_backup(root, names[0]), **{n: v for n, v in parts.items() if n != "copy"}).where(F.col("copy") == parts["copy"])
            sizes = files.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_rows", "length")]).first()
        except Exception as problem:  # whatever stops one unit must not stop the others; it is recorded and raised below
            record(names, FAILED, number, UNKNOWN_NUMBER, UNKNOWN_NUMBER, UNKNOWN_NUMBER, str(problem)[:1000])
            return f"{'/'.join(names)}: {str(problem).splitlines()[0] if str(problem) else type(problem).__name__}"
        record(names, COMPLETE, number, *sizes, None)
        return None

    def record(names: Sequence[str], status: str, number: int, files: int, rows: int, length: int, problem: str | None) -> None:
        # A unit has a folder of its own: states are written at the same time.
        now = datetime.now(UTC)
        row = (backup_type, snapshot, status, number, files, rows, length, problem, _aware(at) or now, now)
        place = "/".join([f"{root}/_runs", *[f"{n}={_escaped(v)}" for n, v in zip(("run", *UNIT), (run, *names), strict=True)]])
        spark.createDataFrame([row], T.StructType(STATES.fields[:10])).coalesce(1).write.mode("append").parquet(place)

    todo = units_to_do(run_states(spark, root), run, requests, tables).orderBy(*UNIT)
    with ThreadPoolExecutor(TABLES_AT_A_TIME) as pool:  # a row per table, not of tables
        failures = [f for f in pool.map(attempt, todo.collect()) if f]
    if failures:
        raise BackupRunFailed(f"run {run}: {'; '.join(failures[:20])}{' and more' if len(failures) > 20 else ''}")
    return last_states(run_states(spark, root).where(F.col("run") == run))


def service_state(states: DataFrame) -> DataFrame:
    """The service state that runs leave on every host: host_id, name, value, date_modified.

    The last run of each type counts, by the time it was taken for. It is complete when all its units are;
    its files are those of its complete units. Increments are named by snapshot and time.
    """
    units = last_states(states)
    files = F.sum(F.when(F.col("status") == COMPLETE, F.col("files_count")).otherwise(0))
    runs = units.groupBy("host_id", "backup_type", "run").agg(
        F.max("snapshot").alias("snapshot"), F.min("taken").alias("taken"), F.max("written").alias("date_modified"), files.alias("files"),
        F.every(F.col("status") == COMPLETE).alias("whole"),
    )
    rest = ["snapshot", "taken", "date_modified", "files", "whole"]
    last = runs.groupBy("host_id", "backup_type").agg(F.max_by(F.struct(*rest), F.struct("taken", "run")).alias("r")).select("host_id", "backup_type", "r.*")
    at = F.concat_ws("/", "snapshot", F.date_format("taken", "yyyy-MM-dd-HH:mm:ss"))
    status = F.when(F.col("whole"), COMPLETE).otherwise(INPROGRESS)
    names = {SNAP: (SNAPSHOT_STATE, ["snapshot", status, "files"]), SST: (SST_STATE, [at, "files"]), "CL": (CL_STATE, [at, "files"])}
    rows = []
    for kind, (state, values) in names.items():
        entries = [
            F.struct(F.lit(n).alias("name"), (F.col(v) if isinstance(v, str) else v).cast("string").alias("value")) for n, v in zip(state, values, strict=True)
        ]
        rows.append(F.when(F.col("backup_type") == kind, F.array(*entries)))
    return last.select("host_id", F.explode(F.coalesce(*rows)).alias("s"), "date_modified").select("host_id", "s.name", "s.value", "date_modified")


def restore_keyspace(
    spark: SparkSession, root: str, host_id: str, local_host: str, snapshot: str, keyspace: str, dest: str,
    keys: Mapping[str, Sequence[str]] | None = None, versions: Mapping[str, str] | None = None, until: datetime | None = None,
) -> dict[str, DataFrame]:
    """Every table of a keyspace, restored to ``dest/<table>`` with the schema it was backed up with.

    The backup of another host than ``local_host`` is refused, and so is a ``dest`` that holds anything.
    Tables with increments need their ``keys``, and ``versions`` where increments are by version. Files
    and content are checked as for one table; the first damaged table stops the restore.
    """
    if host_id != local_host:
        raise ValueError(f"the backup of {host_id} can't be restored on {local_host}")
    place = host_backup(root, host_id)
    if exists(dest) and folders(dest):
        raise FileExistsError(f"{dest} is not empty")
    held = read_manifest(spark, place, snapshot=snapshot, backup_type=SNAP, keyspace=keyspace)
    tables = sorted(r["table"] for r in held.select("table").distinct().collect())  # names of tables
    if not tables:
        raise FileNotFoundError(f"no snapshot {snapshot} of keyspace {keyspace} of host {host_id}")

    def one(table: str) -> DataFrame:
        parts = {"snapshot": snapshot, "keyspace": keyspace, "table": table}
        (schema,), increments = (schemas(spark, place, backup_type=t, **parts) for t in (SNAP, SST))
        own, to = (keys or {}).get(table), f"{dest}/{_escaped(table)}"
        if increments and not own:
            raise ValueError(f"table {table} has increments: its keys are needed")
        if any("changed_seq" in s.names for s in increments):
            return restore_changes(spark, place, schema, **parts, keys=own, until=until, dest=to)
        if until is not None and increments:
            raise ValueError(f"table {table} has increments by version, which have no time")
        return restore_backup(spark, place, schema, **parts, keys=own or (), version=(versions or {}).get(table), dest=to)

    with ThreadPoolExecutor(TABLES_AT_A_TIME) as pool:
        return dict(zip(tables, pool.map(one, tables), strict=True))
