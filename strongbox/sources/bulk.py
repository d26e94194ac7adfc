"""Bulk load of CSV files into files placed by key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.schemas import BULK_ROWS_PER_FILE

TOKEN_BITS = 32


def key_token(keys: Sequence[str]) -> Column:
    """A token from 0 to 2^32 - 1 that depends on the key only."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def token_bucket(keys: Sequence[str], n_buckets: int) -> Column:
    """The token range of a key: equal, contiguous shares of all tokens."""
    width = -(-(2**TOKEN_BITS) // n_buckets)
    return F.floor(key_token(keys) / width)


def read_csv_bulk(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], n_buckets: int) -> DataFrame:
    """Typed rows of (gzipped) CSV files with their ``bucket``. A malformed row is an error."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.withColumn("bucket", token_bucket(keys, n_buckets))


def load_csv_bulk(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    n_buckets: int,
    dest: str,
    rows_per_file: int = BULK_ROWS_PER_FILE,
) -> DataFrame:
    """Loads CSV files into a table of files that hold contiguous, sorted token ranges.

    Rows are placed by range of token and key, with a hash of the whole row behind the key, so a
    key that fills a large share of the input is spread over several tasks.
    """
    rows = read_csv_bulk(spark, path, schema, keys, n_buckets).withColumn("_token", key_token(keys))
    rows = rows.withColumn("_row", F.xxhash64(*schema.names))
    placed = rows.repartitionByRange(n_buckets, "_token", *keys, "_row").sortWithinPartitions("_token", *keys)
    placed.drop("_token", "_row").write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(dest)
    return spark.read.schema(T.StructType(schema.fields + [T.StructField("bucket", T.LongType())])).parquet(dest)
