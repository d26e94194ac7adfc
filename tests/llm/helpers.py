"""What the tests of this folder share."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, *rows: tuple, more: str = "") -> DataFrame:
    """Documents from (doc_id, text) or whole rows."""
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) if not more else r for r in rows], DOCS + more)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in df.select(*columns).collect()]


def words(start: int, n: int) -> str:
    """n different words."""
    return " ".join(f"w{i}" for i in range(start, start + n))
