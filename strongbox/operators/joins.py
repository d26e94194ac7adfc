"""Joins on keys that may be null."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 100_000  # a few short columns each, about 10 MB


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """``left`` with the other columns of ``right``; a null key meets a null key.

    ``small`` says that the caller has bounded the rows of ``right``, so it can be broadcast.
    """
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if small:
        renamed = F.broadcast(renamed)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_k_{k}" for k in keys])
