"""Compares queries with their SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "binary": "BLOB"}


def session(cpus: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("strongbox")
        .config("spark.ui.enabled", False).config("spark.ui.showConsoleProgress", False).config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def compare(spark_df, relation) -> str | None:
    """Why the results differ, or None."""
    expected_columns = dict(zip(relation.columns, [str(t) for t in relation.types]))
    found_columns = {n: TYPES.get(t, t) for n, t in spark_df.dtypes}
    if expected_columns != found_columns:
        return f"columns {sorted(found_columns.items() ^ expected_columns.items())}"
    names = sorted(expected_columns)
    expected = sorted(relation.select(*[f'"{n}"' for n in names]).fetchall(), key=repr)
    found = sorted((tuple(r) for r in spark_df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    if len(expected) != len(found):
        return f"{len(found)} rows instead of {len(expected)}"
    for a, b in zip(found, expected):
        if a != b:
            return f"{names}\n  {a} instead of\n  {b}"
    return None


def main() -> None:
    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, bad = session(), database(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, run in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            start = time.time()
            df = run(spark, sf_dir)
            sql = e.oracle_sql().get(name)
            problem = compare(df, con.sql(sql)) if sql else f"no SQL, {df.count()} rows"
            n = df.count()
        except Exception as error:
            problem, n = "".join(traceback.format_exception_only(error))[:1500], -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {n} rows {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
