"""Reading, writing down and streaming tables: what the operators of this folder share."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strongbox.workspace import new_folder

#: Whether Spark deletes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the session's shared folder and read from there: what follows starts from
    files that outlive the executors which made them. The shuffle files of the writing job go."""
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns doc_id and text, null texts as empty ones, and those named."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(F.col(c) for c in more)
    )


def one_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``chosen`` (doc_id, once each, few enough to broadcast) with the smallest text of their
    document: an id that many rows share counts as one document."""
    given = texts(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    return given.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id")


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that is never learnt from: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker process and key, which its tasks share one after another. Modules of
    this package are rebuilt for every task, so it is held in a module of its own."""
    name = "_strongbox_of_this_worker"
    held = sys.modules.setdefault(name, ModuleType(name)).__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches, one at a time; a batch is turned into objects in slices."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


#: A key is hot when it holds more than one row in so many; there can be no more hot keys than this.
HOT_KEYS = 10_000


def with_hot(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``keyed``, which has a row per key and, in ``n``, how many rows
    have that key. Rows of hot keys meet it by broadcast and are not shuffled; only others are. A null
    key meets nothing."""
    total = keyed.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(keyed.where(F.col("n") * HOT_KEYS > total))  # fewer than HOT_KEYS rows
    cold = keyed.where(F.col("n") * HOT_KEYS <= total)
    return rows.join(hot, key).drop("n").unionByName(rows.join(hot, key, "left_anti").join(cold, key, how).drop("n"))


class Rows:
    """Collects output rows and gives them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, *row, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= self.most or self.bytes >= self.most_bytes

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def arrow_schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))
