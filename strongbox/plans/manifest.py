"""Manifests: what the files of a backup hold, and whether they still do.

Every copy (a snapshot of a table, one increment, one batch of a change log) has a manifest below
``<backup>/_manifests``, outside of what readers of the backup list: a row per file with its length, its
number of rows and their order-free digest, and the schema these were taken with. The digest of all rows
is observed in the pass that writes them; the manifest is made by reading the files back and must agree
with it, so a copy is known to be whole when it is made. A copy without a manifest was not finished.
"""

import json
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.filesystem import exists, folders
from strongbox.operators.digests import DIGEST, combined, digest, row_hash
from strongbox.schemas import BACKUP_PARTITIONS
from strongbox.sources.files import read_backup, table_folder

#: The name of the copy that fills its partition.
WHOLE = "whole"
#: Files named in an error.
NAMED = 20

MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("digest_xor", T.LongType()),
        T.StructField("digest_sum", T.LongType()),
        T.StructField("schema", T.StringType()),
    ]
)
PLACE = [*BACKUP_PARTITIONS, "copy"]


class DamagedBackup(Exception):
    """Files of a backup are missing, changed, or were never part of it."""


def _manifests(backup: str) -> str:
    return f"{backup}/_manifests"


def copy_folder(backup: str, copy: str = WHOLE, **parts: str) -> str:
    """Where the rows of a copy are."""
    return table_folder(backup, **parts) + ("" if copy == WHOLE else f"/{copy}")


def _manifest_folder(backup: str, copy: str = WHOLE, **parts: str) -> str:
    return f"{table_folder(_manifests(backup), **parts)}/copy={copy}"


def finished(backup: str, copy: str = WHOLE, **parts: str) -> bool:
    """Whether a copy was written to its end, and its manifest too."""
    return all(exists(f"{f}/_SUCCESS") for f in (copy_folder(backup, copy, **parts), _manifest_folder(backup, copy, **parts)))


def copies(backup: str, **parts: str) -> list[str]:
    """The finished copies in a table's partition, in the order of their names."""
    names = [f.rstrip("/").rsplit("/copy=", 1)[-1] for f in folders(table_folder(_manifests(backup), **parts))]
    return sorted(n for n in names if finished(backup, n, **parts))


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and an observation of their digest in whatever pass is made over them."""
    seen = Observation()
    return rows.observe(seen, *digest(row_hash(rows.schema))), seen


def found(seen: Observation) -> dict[str, int]:
    """What was observed. Of a plan that turns out to have no rows Spark drops the observation, and its
    empty result is none that can be read."""
    try:
        got = seen.get
    except Py4JJavaError:
        got = {}
    return {n: got.get(n) or 0 for n in DIGEST}


def write_copy(rows: DataFrame, backup: str, copy: str = WHOLE, options: dict | None = None, **parts: str) -> None:
    """Writes a copy and its manifest. What an unfinished attempt left behind is replaced."""
    spark, folder, place = rows.sparkSession, copy_folder(backup, copy, **parts), _manifest_folder(backup, copy, **parts)
    passed, seen = observed(rows)
    passed.write.mode("overwrite").options(**(options or {})).parquet(folder)
    stored = [*MANIFEST.names[:-1], F.lit(rows.schema.json()).alias("schema")]
    digests = _file_digests(spark.read.schema(rows.schema).parquet(folder))
    named = _listing(spark, [folder]).join(digests, "file", "left").fillna(0, DIGEST)  # files without rows count as well
    named.select(*stored).write.mode("overwrite").parquet(place)
    held, meant = _total(spark.read.schema(MANIFEST).parquet(place)), found(seen)
    if held != meant:
        raise DamagedBackup(f"{folder} holds {held} where {meant} was written")


def _file_digests(rows: DataFrame) -> DataFrame:
    """Rows read from files as a row per file with its digest."""
    hashed = rows.select(F.col("_metadata.file_name").alias("file"), row_hash(rows.schema).alias("_hash"))
    return hashed.groupBy("file").agg(*digest(F.col("_hash")))


def _listing(spark: SparkSession, places: Sequence[str]) -> DataFrame:
    """file and length of what lies in the folders; nothing is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(list(places))
    return listed.select(F.col("_metadata.file_name").alias("file"), "length")


def _total(manifest: DataFrame) -> dict[str, int]:
    return manifest.agg(*combined()).first().asDict()


def read_manifest(spark: SparkSession, backup: str, **parts: str | Sequence[str]) -> DataFrame:
    """The manifests of finished copies: a row per file, with the partitions of the copy and its name."""
    whole = T.StructType([*MANIFEST.fields, T.StructField("copy", T.StringType())])
    return read_backup(spark, _manifests(backup), whole, **parts)


def verify_backup(spark: SparkSession, backup: str, content: bool = True, **parts: str | Sequence[str]) -> DataFrame:
    """Whether the files of a backup are those of its manifests: a row per file with the partitions of its
    copy, copy, file, status, n_rows (by the manifest) and found_rows.

    Status is *ok*, *missing*, *resized*, *unlisted* (a file that no manifest names) or, with
    ``content``, *changed*: its rows, read again, have another digest, or can't be read. Without
    ``content`` files are listed and not opened, and found_rows is null. The driver sees a row per copy.
    """
    manifest = read_manifest(spark, backup, **parts)
    held = [r.asDict() for r in manifest.select(*PLACE, "schema").distinct().collect()]
    listed, read = [], []
    for one in held:
        folder = copy_folder(backup, one["copy"], **{n: one[n] for n in BACKUP_PARTITIONS})
        at = [F.lit(one[n]).alias(n) for n in PLACE]
        if exists(folder):
            listed.append(_listing(spark, [folder]).select(*at, "file", F.col("length").alias("_length")))
            if content:
                schema = T.StructType.fromJson(json.loads(one["schema"]))
                rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(folder)
                read.append(_file_digests(rows).select(*at, "file", *[F.col(n).alias(f"_{n}") for n in DIGEST]))
    empty = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in PLACE) + ", file string, _length bigint")
    met = manifest.join(reduce(DataFrame.unionByName, listed, empty), [*PLACE, "file"], "full")
    status = F.when(F.col("length").isNull(), "unlisted").when(F.col("_length").isNull(), "missing").when(F.col("length") != F.col("_length"), "resized")
    if content:
        empty = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in PLACE) + ", file string, " + ", ".join(f"_{n} bigint" for n in DIGEST))
        met = met.join(reduce(DataFrame.unionByName, read, empty), [*PLACE, "file"], "left")
        same = reduce(lambda a, b: a & b, [F.col(n) == F.coalesce(f"_{n}", F.lit(0)) for n in DIGEST])
        status = status.when(~same, "changed")
    rows = F.when(F.col("_length").isNotNull(), F.coalesce("_n_rows", F.lit(0))) if content else F.lit(None)
    return met.select(*PLACE, "file", status.otherwise("ok").alias("status"), "n_rows", rows.cast("bigint").alias("found_rows"))


def refuse_damaged(spark: SparkSession, backup: str, content: bool = False, **parts: str | Sequence[str]) -> None:
    """An error that names the files of a backup that are not as its manifests say."""
    wrong = verify_backup(spark, backup, content, **parts).where("status <> 'ok'").select("table", "copy", "file", "status").limit(NAMED + 1).collect()
    if wrong:
        names = [f"{r['table']}/{r['copy']}/{r['file']} {r['status']}" for r in wrong[:NAMED]] + ["and more"] * (len(wrong) > NAMED)
        raise DamagedBackup(f"{backup}: {', '.join(names)}")


def schemas(spark: SparkSession, backup: str, **parts: str | Sequence[str]) -> list[T.StructType]:
    """The schemas that copies were written with."""
    stored = read_manifest(spark, backup, **parts).select("schema").distinct().collect()
    return [T.StructType.fromJson(json.loads(r["schema"])) for r in stored]


def agree(schema: T.StructType, stored: Sequence[T.StructType]) -> bool:
    """Whether a digest taken with this schema can be compared with those of the manifests."""

    def fields(of: T.StructType) -> set[tuple[str, str]]:
        return {(f.name, f.dataType.simpleString()) for f in of.fields}

    return all(fields(s) == fields(schema) for s in stored)


def refuse_others(spark: SparkSession, backup: str, seen: Observation, **parts: str | Sequence[str]) -> None:
    """An error unless the rows that were observed are those of the manifests; it names the files."""
    meant = _total(read_manifest(spark, backup, **parts))
    if found(seen) != meant:
        refuse_damaged(spark, backup, True, **parts)
        raise DamagedBackup(f"{backup} {parts}: read {found(seen)} where {meant} was backed up")
