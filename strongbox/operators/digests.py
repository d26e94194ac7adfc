"""Order-free digests of rows: of a file, a table, or all rows of a key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a digest consists of. Two sets of rows, repeats included, are taken as equal when all three agree.
DIGEST = ["n_rows", "digest_xor", "digest_sum"]

#: So many bits of a hash are added up: 2**32 rows fit into a sum.
SUMMED = (1 << 31) - 1


def row_hash(schema: T.StructType) -> Column:
    """A 64-bit hash of a whole row. It tells a null from its neighbours' values, also inside lists and
    structs, which a plain hash of the columns does not. Columns count by name, in any order."""

    def parts(field: T.StructField) -> list[Column]:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType):
            value = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
        return [F.lit(field.name), value, value.isNull()]

    return F.xxhash64(*[p for field in sorted(schema.fields, key=lambda f: f.name) for p in parts(field)])


def digest(hashed: Column) -> list[Column]:
    """The aggregates of a digest over hashes of rows; all are combined on the map side. Rows whose hash is
    null do not count."""
    return [
        F.count(hashed).alias("n_rows"),
        F.coalesce(F.bit_xor(hashed), F.lit(0)).cast("bigint").alias("digest_xor"),
        F.coalesce(F.sum(hashed.bitwiseAND(F.lit(SUMMED))), F.lit(0)).cast("bigint").alias("digest_sum"),
    ]


def combined() -> list[Column]:
    """The digest of all rows from those of their parts."""
    return [
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.bit_xor("digest_xor"), F.lit(0)).cast("bigint").alias("digest_xor"),
        F.coalesce(F.sum("digest_sum"), F.lit(0)).cast("bigint").alias("digest_sum"),
    ]


def table_digest(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The digest of all rows, or of the rows of each group."""
    hashed = rows.select(*by, row_hash(T.StructType([f for f in rows.schema.fields if f.name not in by])).alias("_hash"))
    return hashed.groupBy(*by).agg(*digest(F.col("_hash")))
