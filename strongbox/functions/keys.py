"""Object keys, snapshot names and state names as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.schemas import BACKUP_TYPES, FULL_KEY_PARTS, NAME_FORMAT, SHORT_KEY_PARTS


def present(column: str | Column) -> Column:
    """The value, or null where it is blank."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.trim(column) != "", column)


def object_key(base: str, cluster, host, snapshot, backup_type, *optional) -> Column:
    """``base/cluster/host/snapshot/type`` and then the optional parts that are not blank."""
    required = [present(c) for c in (cluster, host, snapshot, backup_type)]
    key = F.concat_ws("/", F.lit(base), *required, *[present(c) for c in optional])
    complete = required[0].isNotNull()
    for part in required[1:]:
        complete = complete & part.isNotNull()
    problem = F.lit("an object key needs a cluster, a host, a snapshot and a backup type")
    return F.when(complete, key).otherwise(F.raise_error(problem).cast("string"))


def build_object_key(df: DataFrame, base: str) -> DataFrame:
    """Adds ``object_key``. Keyspace, table and file may be blank, the other parts may not."""
    key = object_key(base, "cluster", "host_id", "snapshot", "backup_type", "keyspace", "table", "file_name")
    return df.withColumn("object_key", key)


def parse_object_key(objects: DataFrame) -> DataFrame:
    """Splits ``object_key`` into its parts. ``valid`` is false unless there are 8 parts, or 6
    parts (no keyspace and table), and the last one is not empty."""
    split = objects.withColumn("_parts", F.split("object_key", "/"))
    n = F.size("_parts")
    full = n == FULL_KEY_PARTS
    last = F.element_at("_parts", -1)
    valid = F.coalesce((full | (n == SHORT_KEY_PARTS)) & (last != ""), F.lit(False))

    def part(i: int) -> Column:
        return F.when(valid, F.get("_parts", F.lit(i)))

    fields = {
        "cluster": part(1),
        "host_id": part(2),
        "snapshot": part(3),
        "backup_type": part(4),
        "keyspace": F.when(full, part(5)),
        "table": F.when(full, part(6)),
        "file_name": F.when(valid, last),
        "n_parts": n.cast("bigint"),
        "valid": valid,
    }
    # As rows of a one-element array: a filter on a part then tests the part. On plain columns it
    # would be moved below them, and split the key again for every part it mentions.
    parts = F.inline(F.array(F.struct(*[c.alias(name) for name, c in fields.items()])))
    return split.select(*[c for c in objects.columns if c not in fields], parts)


def snapshot_name(ts: str | Column) -> Column:
    return F.date_format(ts, NAME_FORMAT)


def name_time(name: str | Column) -> Column:
    """The time a name stands for, or null where it is not one."""
    return F.try_to_timestamp(name, F.lit(NAME_FORMAT))


def split_state_name(state: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Adds the snapshot a state value refers to and the text of its backup time.

    A snapshot is its own time; increments and change logs are stored as ``snapshot/time``.
    """
    parts = F.split(value, "/")
    own = F.col(name).startswith("last_snapshot")
    return state.withColumns(
        {
            "snapshot": F.get(parts, F.lit(0)),
            "backup_time": F.when(own, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1))),
        }
    )


def archive_id(*parts: str) -> Column:
    """A compact id without dashes, the same whenever the same archive is written again.

    Parts are kept apart, and a missing one differs from an empty one.
    """
    text = F.concat_ws("\x01", *[F.coalesce(F.col(p).cast("string"), F.lit("\x02")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 32)


def metric_name(backup_type: str | Column) -> Column:
    backup_type = F.col(backup_type) if isinstance(backup_type, str) else backup_type
    return _by_type(backup_type, 0)


def removable(backup_type: str | Column) -> Column:
    backup_type = F.col(backup_type) if isinstance(backup_type, str) else backup_type
    return _by_type(backup_type, 1)


def _by_type(backup_type: Column, field: int) -> Column:
    return F.coalesce(*[F.when(backup_type == t, F.lit(v[field])) for t, v in BACKUP_TYPES.items()])


def hash_part(column: str | Column, parts: str | Column) -> Column:
    """A number from 0 to ``parts`` - 1 that depends on the text only."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    number = F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("bigint")
    return F.when(parts > 1, number % parts).otherwise(F.lit(0).cast("bigint"))
