"""Listing data files and reading backed-up rows."""

import re
from collections.abc import Iterator, Sequence
from itertools import product
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.filesystem import children, exists, folders as folders_in, qualified, resolve, within
from strongbox.schemas import BACKUP_PARTITIONS, with_partitions


LISTING = "path string, is_folder boolean, length bigint, modified bigint"


def list_files(folders: DataFrame) -> DataFrame:
    """All files below the folders in the column ``path``, with the other columns of their row.

    Spark's own readers leave out empty and hidden files, a backup must not. Tasks list the
    folders, and what lies below a folder is handed out again, so that one folder with many
    others in it is not left to one task.
    """
    others = [c for c in folders.columns if c != "path"]
    schema = T.StructType([folders.schema[c] for c in others] + T.StructType.fromDDL(LISTING).fields)
    names, base = schema.names, qualified("/")

    def look(batches: Iterator[pd.DataFrame], deep: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch[[*others, "path"]].itertuples(index=False, name=None):
                pending = [within(base, row[-1])]
                while pending:
                    found = children(pending.pop())
                    if deep:
                        pending += [f[0] for f in found if f[1]]
                        found = [f for f in found if not f[1]]
                    yield pd.DataFrame([(*row[:-1], *f) for f in found], columns=names).astype({"length": "Int64", "modified": "Int64"})

    def spread(df: DataFrame) -> DataFrame:
        return df.select(*others, "path").repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1), "path")

    first = spread(folders).mapInPandas(lambda batches: look(batches, False), schema)
    deeper = spread(first.where("is_folder")).mapInPandas(lambda batches: look(batches, True), schema)
    files = first.where("not is_folder").unionByName(deeper)
    return files.select(*others, "path", "length", F.timestamp_micros("modified").alias("modified"))


def list_table_files(spark: SparkSession, roots: Sequence[str], keyspace: str | None = None) -> DataFrame:
    """Files below ``<root>/<keyspace>/<table>``: keyspace, table, path, length, modified.

    The driver looks up keyspaces and tables, the tasks list the tables. A root that does not
    exist, or does not have the keyspace, adds nothing.
    """
    if keyspace is not None and not keyspace.strip():
        raise ValueError("keyspace must not be blank")
    tables = [
        (_name(space), _name(table), table)
        for root in roots
        for space in folders_in(root)
        if keyspace in (None, _name(space))
        for table in folders_in(space)
    ]
    return list_files(spark.createDataFrame(tables, "keyspace string, `table` string, path string"))


def _name(folder: str) -> str:
    """The name of a folder, which may be written as ``keyspace=name`` or ``table=name``."""
    return unquote(re.sub(r"^(keyspace|table)=", "", folder.rsplit("/", 1)[-1]))


def table_folder(backup: str, **parts: str) -> str:
    """The folder of a partition; ``parts`` are the first of the partition columns."""
    return "/".join([backup, *[f"{n}={_escaped(parts[n])}" for n in BACKUP_PARTITIONS if n in parts]])


def _escaped(value: str) -> str:
    """A partition value as it is written in a path."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" or ord(c) < 32 else c for c in value)


def read_backup(spark: SparkSession, backup: str, schema: T.StructType, **parts: str | Sequence[str]) -> DataFrame:
    """Rows of a backup, read from the partitions named by ``parts`` only.

    Only the folders of these partitions are listed, so the planner knows the size of what is
    read and not that of the whole backup. The schema is given, so partition values stay text.
    """
    unknown = set(parts) - set(BACKUP_PARTITIONS)
    if unknown:
        raise ValueError(f"no such backup partition: {sorted(unknown)}")
    wanted = {n: [v] if isinstance(v, str) else list(v) for n, v in parts.items()}
    leading = [n for i, n in enumerate(BACKUP_PARTITIONS) if set(BACKUP_PARTITIONS[: i + 1]) <= set(wanted)]
    folders = [table_folder(backup, **dict(zip(leading, values))) for values in product(*[wanted[n] for n in leading])]
    folders = [f for f in folders if exists(f)]
    whole = with_partitions(schema, BACKUP_PARTITIONS)
    if not folders:
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).option("basePath", backup).parquet(*folders)
    for name, values in wanted.items():
        rows = rows.where(F.col(name).isin(values))
    return rows


def read_backup_objects(objects: DataFrame) -> DataFrame:
    """Adds the ``content`` of opaque objects (``path``); every task opens its own share of them."""
    schema, base = T.StructType(objects.schema.fields + [T.StructField("content", T.BinaryType())]), qualified("/")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.iloc[i : i + 1]
                store, inner = resolve(within(base, one["path"].iloc[0]))
                with store.open_input_stream(inner, compression=None) as stream:
                    yield one.assign(content=[stream.read()])

    return objects.mapInPandas(load, schema)
